"""Jaccard join, suffix dedup, FLAC, language, URLs, pipeline: edge cases and brute force."""

import hashlib
import os
import random
import shutil
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold import common
from quirefold.llm import flac, jaccard, language, registry, sufdedup, textcore, urls
from quirefold.llm.components import connected_components
from tests.llm.test_text_ops import DOC, WORD, empty, odd

PAIR = "doc_id long, text string"


def slow_jaccard(rows):
    """{id: (size, links, component)} of rows (id, text)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    n = len(rows)
    root = list(range(n))
    links = [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 90 * (len(sets[i]) + len(sets[j]) - k):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low_id = {}
    for i, (d, _) in enumerate(rows):
        low_id[find(i)] = min(low_id.get(find(i), d), d)
    return sorted((d, len(sets[i]), links[i], low_id[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=120):
    """Copies, chains of near copies, texts of common passages, short texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passages = [" ".join(r.choice(words) for _ in range(30)) for _ in range(3)]
    out = []
    for i in range(n):
        kind = r.random()
        if kind < 0.35 and out:
            w = r.choice(out).split()
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        elif kind < 0.55:
            t = " ".join(r.sample(passages, r.randint(1, 3)) + [r.choice(words) for _ in range(r.randint(0, 4))])
        elif kind < 0.7:
            t = " ".join(r.choice(["a", "B", "c"]) for _ in range(r.randint(0, 9)))
        else:
            t = " ".join(r.choice(words) for _ in range(r.randint(5, 200)))
        out.append(t)
    return out


@pytest.mark.parametrize(("hot", "block"), [(64, 256), (2, 3), (1, 2), (5, 7)])
def test_jaccard(spark, hot, block):
    rows = list(enumerate(corpus(hot * 10 + block)))
    got = jaccard.jaccard_join(spark.createDataFrame(rows, PAIR), hot=hot, block=block)
    assert sorted(map(tuple, got.collect())) == slow_jaccard(rows)


def near_copies(seed, n):
    """One cluster: copies of a text, each with a few words changed."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def boilerplate(seed, n):
    """Texts of which 80 % are a common notice: no links."""
    r = random.Random(seed)
    notice = " ".join(f"w{r.randrange(5000)}" for _ in range(240))
    return [notice + " " + " ".join(f"x{r.randrange(10**6)}" for _ in range(60)) for _ in range(n)]


@pytest.mark.parametrize("make", [near_copies, boilerplate, lambda seed, n: near_copies(seed, n // 2) + boilerplate(seed, n // 2)])
def test_jaccard_large_groups(spark, make):
    rows = list(enumerate(make(3, 260)))
    got = jaccard.jaccard_join(spark.createDataFrame(rows, PAIR), hot=20, block=32)
    assert sorted(map(tuple, got.collect())) == slow_jaccard(rows)


def count_candidates(spark, texts):
    """(rows of candidate pairs, classes sent to cells) of texts with other ids."""
    df = spark.createDataFrame(list(enumerate(texts)), PAIR)
    keyed = jaccard._keyed(df, "doc_id", "text")
    docs = jaccard.materialize(keyed.mapInArrow(jaccard._heads(5, 90), "key long, n long, p long, k1 long, k2 long, hh long, head array<long>"), "heads")
    classes = docs.groupBy("k1", "k2", "n").agg(F.min("key").alias("cls"), F.count("*").alias("copies"), F.min("hh").alias("hh"), F.min("p").alias("p"))
    members, pairs, wide = jaccard.candidates(classes, docs, keyed, 5, 90, jaccard.HOT)
    return pairs.count() + wide.count(), jaccard._cell_rows(members, pairs, wide, jaccard.BLOCK).count()


def test_jaccard_candidates_are_few(spark):
    """A cluster of near copies and texts with a common notice have fewer candidate pairs than texts."""
    for n in (500, 2000):
        pairs, sent = count_candidates(spark, near_copies(4, n))
        assert 0 < pairs < n and sent <= n * (n // jaccard.BLOCK + 6)
    assert count_candidates(spark, boilerplate(5, 500)) == count_candidates(spark, boilerplate(5, 1500)) == (0, 0)


def test_jaccard_odd(spark):
    rows = [(x.doc_id, x.text) for x in odd(spark).select("doc_id", "text").collect()]
    got = jaccard.jaccard_join(odd(spark)).collect()
    assert sorted(tuple(x) for x in got if x.doc_id is not None) == slow_jaccard([x for x in rows if x[0] is not None])
    assert [tuple(x) for x in got if x.doc_id is None] == [(None, 1, 0, None)]
    nulls = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f"), (None, "q r s"), (None, "q r s"), (None, None), (5, "q")]
    got = sorted(map(str, jaccard.jaccard_join(spark.createDataFrame(nulls, PAIR)).collect()))
    assert got == sorted(map(str, spark.createDataFrame([(None, 2, 2, 3), (None, 2, 2, 3), (3, 2, 2, 3), (None, 1, 1, None), (None, 1, 1, None), (None, 0, 0, None), (5, 1, 0, 5)], "doc_id long, n_shingles long, n_similar long, component_id long").collect()))
    kept = jaccard.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and Counter(x.doc_id for x in kept.collect()) == Counter(x[0] for x in rows)
    assert jaccard.jaccard_join(empty(spark)).count() == 0 and jaccard.keep_one(empty(spark)).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {x: find(x) for x in root}


def slow_repeats(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    at = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        on = [False] * len(t)
        for i in range(len(t) - n + 1):
            if at[t[i : i + n]] > 1:
                on[i : i + n] = [True] * n
        out.append((d, "".join("x" if o else "." for o in on)))
    return out


def spans_of(spark, rows, length, k, group):
    got = sufdedup.repeated_spans(spark.createDataFrame(rows, PAIR), length=length, k=k, group_strings=group).collect()
    by = {x.doc_id: sufdedup.merged([s.asDict() for s in x.spans]) for x in got}
    out = []
    for d, t in rows:
        on = ["."] * len((t or "").encode())
        for a, b in by.get(d, []):
            on[a:b] = "x" * (b - a)
        out.append((d, "".join(on)))
    return out


@pytest.mark.parametrize(("length", "k", "group"), [(20, 5, 2000), (20, 5, 1), (12, 3, 2), (30, 10, 3)])
def test_repeats(spark, length, k, group):
    r = random.Random(length + group)
    base = ["".join(r.choice("abcdé ") for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(70):
        t = "".join(r.choice("abcdefghij") for _ in range(r.randint(0, 50)))
        for _ in range(r.randint(0, 2)):
            b = r.choice(base)
            a = r.randrange(40)
            t += b[a : a + r.randint(5, 60)] + "".join(r.choice("xyz") for _ in range(r.randint(0, 20)))
        rows.append((i, r.choice([t, t, t, t, None, "", "ab" * 40, "z" * 90])))
    assert spans_of(spark, rows, length, k, group) == slow_repeats(rows, length)


def test_repeats_odd(spark):
    out = sufdedup.drop_repeats(odd(spark), length=20)
    assert out.columns == odd(spark).columns
    got = {(x.doc_id, x.text) for x in out.collect()}
    assert {(1, None), (2, ""), (4, "word"), (None, "x y")} <= got and not any(d in (5, 7) for d, _ in got)
    passage = "é" + "passage of some length that comes twice " * 2
    rows = [(1, "before " + passage + "after", None, None, 0), (2, "other " + passage + "words", None, None, 0), (3, passage + passage, None, None, 0)]
    left = {x.doc_id: (x.text, x.n_chars) for x in sufdedup.drop_repeats(spark.createDataFrame(rows, DOC), length=40).collect()}
    assert set(left) == {1, 2} and left[1][0].startswith("befor") and left[1][0].endswith("after") and left[1][1] == len(left[1][0]) < 20
    assert sufdedup.drop_repeats(empty(spark)).count() == 0 and sufdedup.repeated_spans(empty(spark)).count() == 0


def test_repeat_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {x.doc_id: x for x in registry.QUERIES["op10_suffix"](spark, sf).collect()}
    for d, mask in slow_repeats([(x.doc_id, x.text) for x in docs], 200):
        t = next(x.text for x in docs if x.doc_id == d).encode()
        kept = bytes(c for c, m in zip(t, mask) if m == ".")
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(t), mask.count("x"), len([s for s in mask.split(".") if s]), hashlib.sha256(kept).hexdigest())


def test_windows_of_blocks():
    r = random.Random(9)
    for _ in range(60):
        n, alphabet = r.choice([3, 6, 11]), r.choice([b"ab", b"abcd", bytes(range(256))])
        strings = [bytes(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 6))]
        strings.append(strings[0][: r.randint(0, 30)] + b"!")
        at = Counter(s[i : i + n] for s in strings for i in range(len(s) - n + 1))
        for s, on in zip(strings, sufdedup.repeated_windows(strings, n)):
            assert on.tolist() == [at[s[i : i + n]] > 1 for i in range(len(s) - n + 1)]


def test_strings_of_one_minimiser_are_not_all_sorted(monkeypatch):
    """Of many strings that share a minimiser only the parts that may repeat are put in suffix order, and their spans are those of a count."""
    r, n, shared = random.Random(12), 40, b"the bytes of one minimiser, in all of them"[:35]
    strings = {i: r.randbytes(30) + shared + r.randbytes(30) for i in range(1500)}
    strings[7], strings[1400] = strings[3][:70] + b"!" * 25, b"?" * 10 + strings[3][10:80]
    sorted_, order = [], sufdedup.Order
    monkeypatch.setattr(sufdedup, "Order", lambda text, depth: sorted_.append(len(text)) or order(text, depth))
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(strings)), pa.array(list(strings)), pa.array(list(strings.values()), pa.binary())], ["h", "s", "string"])
    got = {}
    for found in sufdedup._blocks(n)(iter([batch])):
        for s, parts in zip(*(c.to_pylist() for c in found.columns)):
            got[s] = {i for p in parts for i in range(p["a"], p["b"])}
    at = Counter(x[i : i + n] for x in strings.values() for i in range(len(x) - n + 1))
    want = {s: {j for i in range(len(x) - n + 1) if at[x[i : i + n]] > 1 for j in range(i, i + n)} for s, x in strings.items()}
    assert got == {s: w for s, w in want.items() if w} and {3, 7, 1400} <= got.keys()
    assert sum(sorted_) < sum(map(len, strings.values())) / 20


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> (n - 1 - i) & 1 for i in range(n)]
        return self

    def rice(self, v, k):
        z = v << 1 if v >= 0 else (-v << 1) - 1
        self.bits += [0] * (z >> k) + [1]
        self.put(z & (1 << k) - 1, k)

    def bytes(self):
        b = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, b[i : i + 8])), 2) for i in range(0, len(b), 8))


def stream(bits, channels, frames, samples, block):
    """A FLAC stream from finished frame bodies (without CRC-16); no seek table."""
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | samples.shape[1]).to_bytes(8, "big") + hashlib.md5(flac.pcm(samples, bits)).digest()
    out = b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info
    for f in frames:
        raw = np.frombuffer(f, np.uint8)
        out += f + int(flac.crc16_many(raw, np.array([0]), np.array([len(f)]))[0]).to_bytes(2, "big")
    return out


def head(number, size, assignment, bits):
    h = bytes([0xFF, 0xF8, 0x70 | 0x9, assignment << 4 | {8: 1, 16: 4, 24: 6}[bits] << 1]) + flac._utf8_number(number) + (size - 1).to_bytes(2, "big")
    return h + bytes([flac.crc8(h)])


def lpc_subframe(w, x, depth, coefs, shift, precision, parts, k, method=0, escape=None):
    m = len(coefs)
    w.put(0, 1).put(31 + m, 6).put(0, 1)
    for v in x[:m]:
        w.put(int(v) & (1 << depth) - 1, depth)
    w.put(precision - 1, 4).put(shift, 5)
    for c in coefs:
        w.put(c & (1 << precision) - 1, precision)
    res = [int(x[i]) - (sum(c * int(x[i - 1 - j]) for j, c in enumerate(coefs)) >> shift) for i in range(m, len(x))]
    w.put(method, 2).put(parts.bit_length() - 1, 4)
    per = len(x) // parts
    at = 0
    for p in range(parts):
        n = per - (m if p == 0 else 0)
        if escape == p:
            w.put((1 << (4 + method)) - 1, 4 + method).put(20, 5)
            for v in res[at : at + n]:
                w.put(v & (1 << 20) - 1, 20)
        else:
            w.put(k, 4 + method)
            for v in res[at : at + n]:
                w.rice(v, k)
        at += n


def test_flac_foreign_streams():
    r = np.random.default_rng(1)
    n = 64
    left = (1000 * np.sin(np.arange(2 * n) / 7) + r.integers(-20, 20, 2 * n)).astype(np.int64)
    right = left + r.integers(-5, 5, 2 * n)
    for assignment, pair in ((1, (left, right)), (8, (left, left - right)), (9, (left - right, right)), (10, ((left + right) >> 1, left - right))):
        frames = []
        for f in range(2):
            w = Writer()
            for c in range(2):
                depth = 16 + ((assignment, c) in ((8, 1), (9, 0), (10, 1)))
                lpc_subframe(w, pair[c][f * n : (f + 1) * n], depth, [30, -14], 4, 7, (1, 4)[f], 6, f, 2 if f else None)
            frames.append(head(f, n, assignment, 16) + w.bytes())
        s = stream(16, 2, frames, np.stack([left, right]), n)
        info, x = flac.decode_many([s])[0]
        assert (x[0] == left).all() and (x[1] == right).all() and info.channels == 2 and info.rate == 44100
    w = Writer()  # wasted bits, fixed predictors of order 3 and 4
    x = (np.cumsum(np.cumsum(r.integers(-3, 4, n))) * 4).astype(np.int64)
    for order in (3, 4):
        w = Writer()
        w.put(0, 1).put(8 + order, 6).put(1, 1).put(1, 2)
        y = x >> 2
        for v in y[:order]:
            w.put(int(v) & (1 << 22) - 1, 22)
        w.put(0, 2).put(0, 4).put(5, 4)
        for v in np.diff(y, order):
            w.rice(int(v), 5)
        s = stream(24, 1, [head(0, n, 0, 24) + w.bytes()], x[None], n)
        assert (flac.decode_many([s])[0][1][0] == x).all()


def test_flac_round_trip_and_damage(spark):
    r = random.Random(6)
    payloads = [bytes(64), b"a" * 64, os.urandom(192), bytes(range(256)) * 9, (b"\x00" * 63 + b"\xff") * 40] + [os.urandom(64 * r.randint(1, 40)) for _ in range(10)]
    payloads += [bytes(int(128 + 100 * np.sin(i / 9 + j)) for i in range(64 * r.randint(1, 50))) for j in range(10)]
    payloads.append(flac.payload_of("Where the words are plain, and the letters of the alphabet follow one another. ".encode() * 40))
    payloads.append(bytes(int(128 + 60 * np.sin(i / 3) + r.gauss(0, 4)) for i in range(64 * 40)))
    media = flac.encode_many(payloads)
    assert [(x[0] + 128).astype(np.uint8).tobytes() for _, x in flac.decode_many(media)] == payloads
    info = flac.Info(media[3])
    with_seek = flac.find_frames(media[3], info)
    info.points = None
    assert flac.find_frames(media[3], info) == with_seek
    kinds = {m[a + head[4]] >> 1 for m in media for a, _, head in flac.find_frames(m, flac.Info(m))}
    assert {0, 1, 0x20 | flac.ORDER - 1} <= kinds and kinds & {8, 9, 10}
    for m, p in zip(media[2:], payloads[2:]):
        for first, n in ((0, 5), (len(p) - 64, 64), (len(p) // 2, 700), (1020, 10), (len(p) - 3, 99), (len(p), 4)):
            own = flac.read_samples(m, first, n)
            assert (own[0] + 128).astype(np.uint8).tobytes() == p[first : first + n] or first >= len(p) and own.size == 0
    blocks = flac.PcmBlocks(2)
    for part in (b"aabbcc", b"dd", b"", b"eeff"):
        blocks.add(part)
    assert all(blocks.read(a, n) == b"aabbccddeeff"[2 * a : 2 * (a + n)] for a in range(7) for n in range(8))
    bad = bytearray(media[3])
    bad[-20] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        flac.decode_many([bytes(bad)])
    with pytest.raises(ValueError, match="not a FLAC"):
        flac.decode_many([b"RIFF0000"])
    df = spark.createDataFrame([(1, bytearray(media[3])), (2, None), (3, bytearray(media[0]))], "k long, m binary")
    blocks = flac.write_pcm_blocks(df, "k", "m", samples=500).orderBy("k", "block").collect()
    assert [b.first_sample for b in blocks if b.k == 1] == [0, 500, 1000, 1500, 2000] and not [b for b in blocks if b.k == 2]
    back = b"".join(bytes(b.pcm) for b in blocks if b.k == 1)
    assert (np.frombuffer(back, np.int8).astype(int) + 128).astype(np.uint8).tobytes() == payloads[3]


def test_media_long_text():
    """A long text needs a few times its own size, not a few dozen."""
    import resource

    r = random.Random(2)
    text = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "漢字"]) + str(r.randrange(99)) for _ in range(100_000)).encode() * 16
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    media = flac.encode_many([flac.payload_of(text)])
    back, digest = flac.PcmBlocks(1), hashlib.sha256()
    for _, _, _, x in flac.decode_blocks(media):
        if x is not None:
            back.add((x[0] + 128).astype(np.uint8).tobytes())
            digest.update(back.blocks[-1])
    assert digest.digest() == hashlib.sha256(flac.payload_of(text)).digest() and len(media[0]) < len(text)
    used = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024
    assert used < 10 * len(text) + (400 << 20)


def test_media_query(spark, sf):
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = registry.QUERIES["op6_media"](spark, sf).collect()
    assert len(got) == len(docs)
    for x in got:
        t = docs[x.doc_id].encode()
        p = t + bytes(-len(t) % 64 or 64 * (not t))
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    odd_rows = flac.media_columns(odd(spark), with_media=True).collect()
    assert len(odd_rows) == 10 and all(hashlib.sha256(bytes(x.media)).hexdigest() == x.media_sha256 and len(x.media) == x.media_bytes for x in odd_rows)
    assert len({(x.media_sha256, x.feature) for x in odd_rows if x.doc_id in (1, 2)}) == 1 and flac.media_columns(empty(spark)).count() == 0


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op4_language"](spark, sf).collect()
    lang = {x.doc_id: x.lang for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [x for x in got if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got) and len(got) == len(lang)
    assert np.mean([x.lang_pred == lang[x.doc_id] for x in held]) > 0.97 and all(0 <= x.score <= 1 for x in got)
    langs, protos = language.learn(odd(spark))
    assert langs == ["en", "fr"]
    out = {(x.doc_id, x.lang_pred) for x in language.predict(odd(spark), langs, protos).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (5, "fr")} <= out and (8, "en") in out
    assert language.learn(empty(spark))[0] == [] and {x.lang_pred for x in language.predict(odd(spark), *language.learn(empty(spark))).collect()} == {"und"}
    with pytest.raises(ValueError, match="more than"):
        old, language.MAX_LANGUAGES = language.MAX_LANGUAGES, 1
        try:
            language.learn(odd(spark))
        finally:
            language.MAX_LANGUAGES = old


def slow_language(taught, texts):
    """[(language, score)] of texts from (text, language) pairs: letter by letter."""
    one = {}

    def letter(ch):
        c = ord(ch.lower()) if len(ch.lower()) == 1 else ord(ch)
        if c not in one:
            one[c] = language.letter_vectors(np.array([c]))[0].astype(np.int64)
        return one[c]

    gap = language.letter_vectors(np.array([language.GAP]))[0].astype(np.int64)

    def vector(text):
        out = np.zeros(language.DIM, np.int64)
        for word in "".join(ch if ch.isalpha() else " " for ch in text or "").split():
            x = [gap, *map(letter, word), gap]
            for a, b, c in zip(x, x[1:], x[2:]):
                out += np.roll(a, 2) * np.roll(b, 1) * c
        return out

    sums = {}
    for text, lang in taught:
        v = vector(text)
        if lang is not None and any(ch.isalpha() for ch in text or ""):
            sums[lang] = sums.get(lang, 0) + np.rint(v / np.sqrt((v * v).sum()) * language.UNIT)
    out = []
    for text in texts:
        v = vector(text).astype(float)
        if not any(ch.isalpha() for ch in text or "") or not sums:
            out.append(("und", 0.0))
            continue
        cos = {k: v @ np.rint(s / abs(s).max() * language.PEAK) / np.linalg.norm(v) / np.linalg.norm(np.rint(s / abs(s).max() * language.PEAK)) for k, s in sums.items()}
        best = min(cos, key=lambda k: (-cos[k], k))
        out.append((best, (1 + cos[best]) / 2))
    return out


def test_language_brute_force(spark):
    """Vectors, prototypes and choice against letter by letter, scripts of all kinds, and the same in blocks of languages and in other layouts of rows."""
    r = random.Random(12)
    scripts = ["abcdeé", "абвгдж", "αβγδεζ", "漢字日本語文", "あいうえおか", "한국어말글자", "ABCÄÖÜ"]
    rows = [(i, " ".join("".join(r.choice(scripts[i % 7]) for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 12))) + r.choice(["", " 12-3", "😀"]), f"l{i % 7}" if i % 5 else None) for i in range(80)]
    rows += [(100, None, "l0"), (101, "", "l1"), (102, "123 !?", "l2"), (None, "абв", "l3"), (7, rows[7][1], rows[7][2]), (103, "ab " * 30_000, "l0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((i, *w) for (i, _, _), w in zip(rows, slow_language([(t, k) for _, t, k in rows], [t for _, t, _ in rows]))), key=key)
    for parts, most in ((1, 5000), (5, 5000), (3, 2)):
        old, language.MAX_LANGUAGES = language.MAX_LANGUAGES, most
        try:
            got = sorted(map(tuple, language.identify(df, df.repartition(parts)).collect()), key=key)
        finally:
            language.MAX_LANGUAGES = old
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(a[2] == pytest.approx(b[2], abs=1e-12) for a, b in zip(got, want))
        if parts == 1:
            first = got
        assert got == first


def test_urls(spark):
    rows = [
        (1, "http://Www.EXAMPLE.org/es/x?q#f", "www.example.org", "/es/x", "example.org/es/", "block"), (2, "https://a.org/es/", "a.org", "/es/", "org/", "allow"), (3, "x://example.org/en/123", "example.org", "/en/123", "example.org/en/1", "block"),
        (4, "http://b.com/fr/a", "b.com", "/fr/a", "com/fr/", "allow"), (5, "http://b.com/de/", "b.com", "/de/", "com/de/", "block"), (6, "http://b.com/de", "b.com", "/de", None, "allow"), (7, None, "", "", None, "allow"), (8, "no scheme.org/", "", "", None, "allow"),
        (9, "http://x.org", "x.org", "", None, "allow"), (10, "http://x.org?a=/b://c", "x.org", "", None, "allow"), (11, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), (12, "://org/", "org", "/", "org/", "allow"), (12, "://org/", "org", "/", "org/", "allow"),
        (13, "HTTP://ÄB.COM/Fr/", "Äb.com", "/Fr/", None, "allow"), (14, "", "", "", None, "allow"), (None, "http://c.com/fr/", "c.com", "/fr/", "com/fr/", "allow"), (15, "http://e.org/" + "a/" * 20_000, "e.org", "/" + "a/" * 20_000, "org/", "allow"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("key", F.lit(2)).withColumn("tokens", F.lit(3))
    got = urls.judge_urls(df, None)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([tuple(r)[:5] for r in got.select("page_id", "host", "path", "rule", "verdict").collect()], key=key) == sorted([(r[0], *r[2:]) for r in rows], key=key)
    pages = spark.createDataFrame([(i, f"http://{'spam.net/win' if i % 2 else 'good.net/read'}/{i}") for i in range(200)] + [(900, "http://spam.net/win/900"), (901, "http://new.net/other")], "page_id long, url string")
    labels = spark.createDataFrame([(i, "block" if i % 2 else "allow") for i in range(200)], "id long, verdict string")
    got = {r.page_id: r.verdict for r in urls.judge_urls(pages, labels).collect()}
    assert got[900] == "block" and got[901] == "allow" and all(got[i] == ("block" if i % 2 else "allow") for i in range(200))
    assert urls.judge_urls(df.limit(0), labels).count() == 0


def test_urls_brute_force(spark):
    """Mined rules matched by index against a scan of all rules."""
    r = random.Random(8)
    pages = spark.createDataFrame([(i, f"http://{r.choice('ab')}.{r.choice(['x', 'y'])}.net/{r.choice(['p', 'q'])}/{i}{r.choice(['', '/', '?k=1'])}") for i in range(300)], "page_id long, url string")
    labels = spark.createDataFrame([(i, "block" if r.random() < 0.2 + 0.5 * (i % 3 == 0) else "allow") for i in range(300)], "id long, verdict string")
    host, path = urls.host_and_path(F.col("url"))
    base = pages.withColumn("host", host).withColumn("path", path)
    sets = base.select(F.col("page_id").alias("id"), urls.url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    rules = urls.mine_rules(sets.join(labels, "id").select("tokens", "verdict")).collect()
    got = {x.page_id: x.verdict for x in urls.judge_urls(pages, labels).collect()}
    for x in sets.collect():
        fit = [(q.certainty, len(q.tokens), q.support, " ".join(q.tokens), q.verdict) for q in rules if set(q.tokens) <= set(x.tokens)]
        assert got[x.id] == (max(fit)[4] if fit else "allow")
    assert rules


def test_urls_block_rules(spark, tmp_path):
    """The query mines block rules, from the fixed rules and not from the labels of documents; a rule needs pages, not a part of the table."""
    urls_ = [f"http://h{i % 7}.example.{d}/{lang}/{i}" for i in range(100) for d in ("org", "com", "net") for lang in ("es", "fr", "de")]
    spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(len(urls_))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = registry.QUERIES["op8_urls"](spark, str(tmp_path)).collect()
    assert len(got) == len(urls_)
    assert {(r.path[:4], r.verdict) for r in got if r.rule is None and r.mined_confidence == 1} == {("/es/", "block"), ("/fr/", "allow")}
    few = [(i, f"http://{'bad' if i < 25 else 'h'}{0 if i < 25 else i % 40}.net/p/{i}") for i in range(6000)]
    labels = spark.createDataFrame([(i, "block" if i < 22 or i % 50 == 0 else "allow") for i, _ in few], "id long, verdict string")
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(few, "page_id long, url string"), labels).collect()}
    assert all(got[i] == ("block" if i < 25 else "allow") for i, _ in few)


def test_urls_rules_brute_force(spark):
    """Rules against a count of all token combinations."""
    from itertools import combinations

    r = random.Random(11)
    sets = [(sorted({r.choice("abc"), r.choice("de"), r.choice("fgh"), "z", "y"} | ({"p", "q"} if r.random() < 0.4 else set())), "block" if r.random() < 0.2 else "allow") for _ in range(150)]
    sets = [(t, "block" if "p" in t and "a" in t and r.random() < 0.45 else v) for t, v in sets] + [([], "block"), (["a"], None)]
    got = {(tuple(x.tokens), x.verdict): (x.confidence, x.certainty) for x in urls.mine_rules(spark.createDataFrame(sets, "tokens array<string>, verdict string"), min_pages=8, min_certainty=0.1).collect()}
    sets = [(t, v) for t, v in sets if t and v]
    with_, labels = Counter(), Counter(v for _, v in sets)
    for t, v in sets:
        kinds = [x for x in t if x not in "zq"]  # y stands for y and z, p for p and q
        for k in range(1, len(kinds) + 1):
            for c in combinations(kinds, k):
                full = tuple(sorted({*c, *("z" if "y" in c else ""), *("q" if "p" in c else "")}))
                with_[full, None] += 1
                with_[full, v] += 1
    want = {}
    for (c, v), k in with_.items():
        if v and k >= 8:
            confidence, share = k / with_[c, None], labels[v] / len(sets)
            if (confidence - share) / (1 - share) >= 0.1:
                want[c, v] = (pytest.approx(confidence), pytest.approx((confidence - share) / (1 - share)))
    assert got == want and want


def test_urls_rare_label_and_bounds(spark):
    """A pattern whose label is rarer than not is mined where it is far above its share, and pages are blocked by it; many query keys don't make many itemsets."""
    pages = [(i, f"http://{'win.bad' if i < 100 else f'h{i % 50}.good'}.net/{'abc'[i % 3]}/{i}") for i in range(2000)] + [(5000, "http://win.bad.net/zz/1"), (5001, "http://h1.good.net/zz/1")]
    labels = [(i, "block" if i < 100 and i % 2 else "allow") for i in range(2000)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {x.page_id: x.verdict for x in urls.judge_urls(df, spark.createDataFrame(labels, "id long, verdict string")).collect()}
    assert got[5000] == "block" and got[5001] == "allow"  # half of its pages are blocked, and 2.5 % of all
    r = random.Random(3)
    wide = [([f"k{j:02}" for j in range(30) if j < 20 or r.random() < 0.8], r.choice(["allow", "block"])) for _ in range(300)]
    narrow, kinds = urls._narrowed(spark.createDataFrame(wide, "tokens array<string>, verdict string"), urls.WIDTH)
    assert max(len(x.tokens) for x in narrow.collect()) <= urls.WIDTH and kinds.count() == 11
    assert urls.mine_rules(spark.createDataFrame(wide, "tokens array<string>, verdict string"), min_certainty=-9.0).count() <= 2 * 2**11
    deep = "http://" + ".".join(f"l{i}" for i in range(12)) + ".org/" + "a/" * 15
    host, path = urls.host_and_path(F.lit(deep))
    tokens = spark.range(1).select(urls.url_tokens(F.lit(deep), host, path)).first()[0]
    assert sum(t.startswith("host:") for t in tokens) == 13 and "depth:15" in tokens


def test_hot_tokens_go_to_the_heads(spark, monkeypatch):
    """Hot tokens are counted by group without a shuffle of all token rows."""
    plans, write = {}, jaccard.materialize

    def until_short(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        if name == "short-heads":
            raise InterruptedError
        return write(df, name)

    monkeypatch.setattr(jaccard, "materialize", until_short)
    groups = spark.createDataFrame([(g, 4, 1, [1, 2, 3, 10 + g]) for g in range(9)], "g long, n long, p long, head array<long>")
    with pytest.raises(InterruptedError):
        jaccard._ranked(groups, None, 5, 4)
    assert "strategy=broadcast" in plans["short-heads"]


def test_tokens_of_one_head_are_not_sorted(spark, monkeypatch):
    """Rounds add to the counts of tokens, and rare tokens that no other head has go before the join by token."""
    seen, write = {}, jaccard.materialize

    def spy(df, name):
        files = df.inputFiles() if name == "tokens" else []
        seen.setdefault(name, []).append((files, write(df, name)))
        return seen[name][-1][1]

    monkeypatch.setattr(jaccard, "materialize", spy)
    assert count_candidates(spark, boilerplate(6, 300)) == (0, 0)
    assert len(seen["tokens"]) > 1 and all(any(f.endswith("-tokens") or "-tokens/" in f for f in files) for files, _ in seen["tokens"][1:])
    rare = seen["ordered-heads"][0][1].filter("not hot")
    shared = rare.join(seen["tokens"][-1][1], "token", "left_semi").count()
    assert shared == seen["prefix-rows"][0][1].count() and rare.count() - shared < 300


def test_windows_are_hashed_once(spark, monkeypatch):
    """Each text goes through the rolling hashes once."""
    seen, make = spark.sparkContext.accumulator(0), sufdedup._minimizers

    def counted(length, k):
        run = make(length, k)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield from run(iter([batch]))

        return count

    monkeypatch.setattr(sufdedup, "_minimizers", counted)
    texts = [(i, "".join(chr(97 + (j * j * (i % 5 + 1)) % 23) for j in range(300 + i))) for i in range(20)]
    assert sufdedup.repeated_spans(spark.createDataFrame(texts, PAIR)).count() == 20 and seen.value == 20


def test_urls_wide_sets(spark):
    """A rule of two tokens that tell nothing each is counted over all pages, however many tokens these have."""
    r = random.Random(5)
    sets = [([f"p{i % 2}", f"q{i // 2 % 2}", *(f"f{j:02}" for j in range(13) if r.random() < 0.97)], "block" if i % 2 == i // 2 % 2 else "allow") for i in range(200)]
    assert max(len(t) for t, _ in sets) > urls.WIDTH
    rules = urls.mine_rules(spark.createDataFrame(sets, "tokens array<string>, verdict string"))
    got = {(tuple(x.tokens), x.verdict): (x.confidence, round(x.support * 200)) for x in rules.filter(F.size("tokens") == 2).collect()}
    pairs = {(p, q): "block" if p[1] == q[1] else "allow" for p in ("p0", "p1") for q in ("q0", "q1")}
    assert {k: v for k, v in got.items() if k[0] in pairs} == {(t, v): (1.0, 50) for t, v in pairs.items()}
    wide = max((t for t, _ in sets), key=len)  # with all the others, too
    n = sum(set(t) >= set(wide) for t, _ in sets)
    full = rules.filter(F.size("tokens") == len(wide)).filter(F.array_contains("tokens", wide[0]) & F.array_contains("tokens", wide[1])).collect()
    assert [round(x.support * 200) for x in full] == [n] * (n >= urls.MIN_PAGES)


def test_urls_base_against_sql(spark):
    """Host, path and rule of all pages against DuckDB, and the verdict where a fixed rule decides."""
    import duckdb

    sf = "/root/testdata/sf0.1"
    rules = " UNION ALL ".join(f"SELECT '{h}' AS h, '{p}' AS p, '{v}' AS v" for h, p, v in urls.FIXED)
    want = duckdb.sql(f"""WITH r AS ({rules}), a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS x FROM '{sf}/pages.parquet'),
        b AS (SELECT page_id, translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
        SELECT page_id, host, path, arg_max(h || p, length(h || p)), arg_max(v, length(h || p)) FROM b LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL""").fetchall()
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in registry.QUERIES["op8_urls"](spark, sf).collect()}
    assert len(got) == len(want)
    for id_, host, path, rule, verdict in want:
        assert got[id_][:3] == (host, path, rule) and (rule is None or got[id_][3] == verdict)
    assert {v for _, _, rule, v in got.values() if rule is None} == {"allow", "block"}


def test_hasher():
    buf = np.frombuffer(b"abcabcabd" * 3, np.uint8)
    h = textcore.Hasher(buf)
    g = h.grams(3)
    for i in range(len(g)):
        for j in range(len(g)):
            assert (g[i] == g[j]) == (buf[i : i + 3].tobytes() == buf[j : j + 3].tobytes())


def test_workers_give_memory_back():
    """What a task has freed is the system's again when it ends, in a process of its own as a worker is."""
    import subprocess
    import sys

    code = """
import ctypes, random, re
import pyarrow as pa
from quirefold.llm import sufdedup, textcore
def mb():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
def task(seed):
    r = random.Random(seed)
    common = r.randbytes(220)
    for at in range(0, 2_400, 100):
        strings = [r.randbytes(200) + common + r.randbytes(200) for _ in range(100)]
        yield pa.RecordBatch.from_pydict({"h": pa.array([7] * 100), "s": pa.array(range(at, at + 100)), "string": pa.array(strings, pa.binary())})
run = sufdedup._blocks(200)
def found():
    return sum(b.num_rows for b in run(task(1)))
small = [b.num_rows for b in run(b.slice(0, 3) for b in [next(task(2))])]
textcore._powers(2_400 * 620 + 1)  # these are kept
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
before = mb()
assert found() == 2_400 and small == [3]
print(mb() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < 8


def test_jaccard_workers_give_memory_back(monkeypatch):
    """Each function of the join that runs in a worker gives back what a task has freed, also when the task's rows aren't all read."""
    calls = []
    monkeypatch.setattr(textcore, "release", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"key": pa.array([1, 2, 3]), "text": [f"{i} a b c d e f g" for i in range(3)]})
    heads = next(iter(jaccard._heads(5, 90)(iter([batch]))))
    sets = next(iter(jaccard._sets(5)(iter([batch]))))
    assert heads.num_rows == sets.num_rows == 3 and len(calls) == 2
    shared = type("", (), {"value": np.full((1, jaccard.MAP_BITS // 8), 255, np.uint8)})
    ordered = list(jaccard._order(shared)(iter([pa.RecordBatch.from_arrays([heads.column(i) for i in (0, 1, 2, 6)], ["g", "n", "p", "head"])])))
    assert [b.num_rows for b in ordered] == [sum(heads.column(2).to_pylist())] and len(calls) == 3
    cells = [sets.column(0), *[pa.array([7] * 3)] * 3, pa.array([1] * 3), sets.column(1)]
    rows = pa.RecordBatch.from_arrays(cells, ["cls", "lo", "hi", "block", "copies", "tokens"])
    assert list(jaccard._cells(60)(iter([rows])))[0].num_rows == 3 and len(calls) == 4


def test_tables_start_few_programs(spark, tmp_path):
    """Hadoop starts chmod for each file and folder of a local table: two for each part are left. Damage is found without its checksum files."""
    import subprocess
    import sys
    from pathlib import Path

    noise = spark.range(0, 3000, 1, 3).select("id", F.sha2(F.col("id").cast("string"), 512).alias("x"), F.unhex(F.sha2(F.col("id").cast("string"), 512)).alias("y"))
    df = common.materialize(noise, "noise-rows")
    assert sorted(df.collect()) == sorted(noise.collect())
    folder = max((f for f in Path(common.shared_dir(spark).removeprefix("file://")).glob("quirefold/*-noise-rows")), key=lambda f: f.stat().st_mtime)
    files = sorted(folder.iterdir())
    assert len(files) == 3 and all(f.name.startswith("part-") for f in files)
    data = bytearray(files[0].read_bytes())
    at = data.find(hashlib.sha512(b"5").digest())  # these bytes aren't compressed
    assert at > 0
    data[at + 9] ^= 1
    files[0].write_bytes(data)
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        spark.read.schema(df.schema).options(**common._READ).parquet(str(folder)).collect()

    log, chmod = tmp_path / "log", tmp_path / "chmod"
    chmod.write_text(f'#!/bin/sh\necho "$*" >> {log}\nexec {shutil.which("chmod")} "$@"\n')
    chmod.chmod(0o755)
    code = """
from pyspark.sql import SparkSession
from quirefold.common import materialize
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print(materialize(spark.range(0, 300, 1, 3), "counted-rows").count())
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "SPARK_ENV_LOADED")} | {"PATH": f"{tmp_path}:{os.environ['PATH']}"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))), env=env)
    assert out.stdout.split()[-1:] == ["300"], out.stderr
    assert len([x for x in log.read_text().splitlines() if "counted-rows" in x]) <= 6


def test_pipeline(spark, sf):
    """Stage by stage against brute force on what the stage before kept."""
    import base64

    import corpus_pipeline as p
    import tiktoken

    from quirefold.llm import bpe, mixing
    from tests.llm.test_text_ops import slow_quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = dict(p.STAGES)["quality"](spark, docs, sf)
    kept = {x.doc_id for x in first.collect()}
    assert kept <= {x.doc_id for x in docs.collect() if not slow_quality(x.text)[5]}
    second = dict(p.STAGES)["near_duplicates"](spark, first, sf)
    comp = {d: c for d, _, _, c in slow_jaccard([(x.doc_id, x.text) for x in first.collect()])}
    assert {x.doc_id for x in second.collect()} == set(comp.values())
    third = dict(p.STAGES)["repeated_passages"](spark, second, sf)
    rows = {x.doc_id: x.text for x in second.collect()}
    left = {x.doc_id: x.text for x in third.collect()}
    for d, mask in slow_repeats(list(rows.items()), 200):
        cut, at = [], 0
        while (at := mask.find("x", at)) >= 0:
            end = mask.find(".", at) % (len(mask) + 1)
            cut.append((at, end))
            at = end
        want = sufdedup.whole_characters(rows[d].encode(), cut).decode() if cut else rows[d]
        assert left.get(d, "") == want
    third = spark.createDataFrame(third.collect(), third.schema)
    fourth = dict(p.STAGES)["mixing"](spark, third, sf)
    want = {x.doc_id: x.copies for x in mixing.mix_sources(third).collect() if x.copies}
    assert Counter(x.doc_id for x in fourth.collect()) == want and all(d.columns == docs.columns for d in (first, second, third, fourth))
    path, pattern = bpe.default_ranks()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    last = p.run(spark, sf)
    texts = {x.doc_id: x.text for x in fourth.collect()}
    ids = {x.doc_id: list(x.ids) for x in last.collect()}
    assert last.count() == fourth.count() and all(enc.encode_ordinary(texts[d]) == i for d, i in ids.items()) and set(ids) == set(texts)
    stage = odd(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, f in p.STAGES:
        assert f(spark, stage, sf).count() >= 0 and f(spark, stage.limit(0), sf).count() == 0
