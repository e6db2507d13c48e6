"""Quality rules, BPE, chat, mixing: edge cases, round trips, comparison with brute force."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.llm import bpe, chat, licenses, mixing, quality, registry
from tests.conftest import compare

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "word", "en", None, 4), (None, "x y", "en", "b", 3), (5, "é" * 30_000, "fr", "b", 30_000),
    (6, "a b c d e f g h\n" * 400, "en", "a", 1), (7, "don't stop 漢字 😀 \x00 end", None, "a", 9), (7, "don't stop 漢字 😀 \x00 end", None, "a", 9), (8, "\n\n\nline one\nline one\n", "en", "z", 2),
]


def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing further columns."""
    df = spark.createDataFrame(ODD, DOC)
    return df.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("size", F.lit(2.5)).withColumn("ids", F.lit("q")).withColumn("id", F.lit(0)).withColumn("g", F.lit(1))


def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, name):
    compare(spark, sf, registry.QUERIES, registry.ORACLES, [name])


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_quality(text):
    text = text or ""
    w = WORD.findall(text)
    at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {i + j for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)


def test_quality(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["a", "bb", "é", "#x", "漢"]) for _ in range(r.randint(0, 60))) + r.choice(["", "\n", "\na b\na b"]) for _ in range(200)]
    df = odd(spark).select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    rows = quality.quality_rules(df).collect()
    assert len(rows) == df.count()
    want = sorted((x.doc_id if x.doc_id is not None else -1, *slow_quality(x.text)) for x in df.collect())
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in rows) == want
    clean = " ".join(f"w{i}" for i in range(300))
    copies = " ".join(["one two three four five six seven"] * 3 + [clean[:100]])
    got = {x.doc_id: x.kept for x in quality.quality_rules(spark.createDataFrame([(1, clean), (2, copies), (3, "short")], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}
    kept = quality.keep_quality(odd(spark))
    assert kept.columns == odd(spark).columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in rows if x.kept and x.doc_id and x.doc_id < 100}
    assert quality.quality_rules(empty(spark)).count() == 0 and quality.keep_quality(empty(spark)).count() == 0


def reference_encoder():
    import tiktoken

    path, pattern = bpe.default_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark):
    enc = reference_encoder()
    r = random.Random(2)
    alphabet = " aeiouthnslABC\n\t.,!?0123é漢字日本العربيةпривет😀́\x00\x7f\x1c\x85  "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(400)] + ["ab" * 20_000, " " * 5000, "<|endoftext|>", "'" * 99]
    df = odd(spark).select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.encode_bpe(df).collect())
    want = []
    for x in df.collect():
        t = x.text or ""
        ids = enc.encode_ordinary(t)
        want.append((-1 if x.doc_id is None else x.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)
    out = bpe.with_tokens(odd(spark))
    assert out.columns == [c for c in odd(spark).columns if c != "ids"] + ["n_tokens", "ids"]
    back = bpe.decode_ids(out)
    assert all(bytes(x.decoded).decode() == (x.text or "") for x in back.collect())
    assert bpe.encode_bpe(empty(spark)).count() == 0 and bpe.with_tokens(empty(spark)).count() == 0


def test_tokens_of_copies(spark, monkeypatch):
    """Copies that follow each other, across batches too, are encoded once and all get their ids."""
    calls, encode = [], bpe.Bpe.encode_bytes
    monkeypatch.setattr(bpe.Bpe, "encode_bytes", lambda self, t: calls.append(t) or encode(self, t))

    class Frame:
        sparkSession, schema = spark, spark.createDataFrame([], "text string").schema  # noqa: N815
        drop = lambda self, *_: self
        mapInArrow = lambda self, run, _: run  # noqa: E731, N815

    batches = [pa.RecordBatch.from_pydict({"text": pa.array(x, pa.string())}) for x in (["", "one two", "one two"], ["one two", "b", None, "b", "b"])]
    out = [r for b in bpe.with_tokens(Frame())(iter(batches)) for r in b.to_pylist()]
    assert calls.count("one two") == 1 and calls.count("b") == 2
    coder = bpe.coder(*bpe.default_ranks())
    assert [r["text"] for r in out] == [t for b in batches for t in b.column(0).to_pylist()]
    assert [r["ids"] for r in out] == [np.frombuffer(encode(coder, r["text"] or ""), "<u4").tolist() for r in out] and all(r["n_tokens"] == len(r["ids"]) for r in out)


def test_tokens_without_texts(spark, sf):
    """The texts don't come back from Python where they aren't wanted."""
    import corpus_pipeline

    df = odd(spark)
    out = bpe.with_tokens(df, keep_text=False)
    assert out.columns == [c for c in df.columns if c not in ("ids", "text")] + ["n_tokens", "ids"]
    assert sorted(map(repr, out.collect())) == sorted(map(repr, bpe.with_tokens(df).drop("text").collect()))
    stage = corpus_pipeline.tokens(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    plan = stage._jdf.queryExecution().optimizedPlan()
    while "MapInArrow" not in plan.nodeName():
        plan = plan.children().head()
    names = plan.output().mkString(" ")
    assert "ids#" in names and "text#" not in names


def test_bpe_classes():
    coder = bpe.coder(*bpe.default_ranks())
    for c in range(256):
        t = "a" + chr(c) * 2 + "b 1" + chr(c)
        assert coder.find(t) == coder.find_latin(t)
    assert bpe.KNOWN_PATTERN == bpe.default_ranks()[1]


CONV = "conv_id long, turn long, role string, text string"


def test_chat(spark):
    r = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", " ", "ok", "<<SYS>>", "<|answer|>", "<|", "[INST", "é😀", "\n", "<|role|>", "[/INST] ", "<s>[INST] "]
    rows = []
    for c in range(60):
        for turn in range(r.randint(1, 6)):
            rows.append((c, turn, r.choice(["user", "assistant", "system", "tool", "<s>\\", None]), r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(0, 12)))])))
    rows += [(100, 0, "user", "a"), (100, 1, "assistant", "b"), (101, None, "user", "x"), (101, 0, "user", "y"), (102, 0, "user", "same"), (102, 0, "user", "same"), (None, 0, "user", "n"), (103, 0, "user", "long " * 100_000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, CONV).withColumn("segment", F.lit(1)).withColumn("loss", F.lit("x"))
    got = {x.conv_id: x for x in chat.read_chat(chat.format_chat(df)).collect()}
    by = {}
    rows = [x for x in rows if x[0] is not None]
    assert got.pop(None).n_turns == 1
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((-1 if t is None else t), role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(x[2], x[4]) for x in sorted(turns)]
        x = got[c]
        said = "".join(t for role, t in turns if role == "assistant")
        assert x.n_turns == len(turns) and x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (x.loss_chars, x.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[100].valid and not got[101].valid and got[101].bad_turn == 1
    seg = chat.format_chat(df.filter("conv_id = 100")).collect()
    assert "".join(s.segment for s in seg) == "<s>[INST] a [/INST] <|answer|>b</s>" and [s.segment for s in seg if s.loss] == ["b"]
    assert chat.read_chat(chat.format_chat(spark.createDataFrame([], CONV))).count() == 0
    alone = spark.createDataFrame([(None, i, "user", f"t{i % 3}") for i in range(9)], CONV)
    assert [x.n_turns for x in chat.read_chat(chat.format_chat(alone)).collect()] == [1] * 9


def test_chat_escapes():
    """No bare mark of the template is left in an escaped text, nor made where the text meets its markers; escapes can be undone."""
    t, r = chat.DEFAULT, random.Random(4)
    assert set(t.controls) == {"<<SYS>>", "<</SYS>>", "<s>", "[INST]", "[/INST]", "<|answer|>", "</s>", "<|role|>", "<|says|>", "<|end|>"}
    escape = t.escaper()
    bits = [*t.controls, "<", "[", "<|", "</", "\\", "\\:", ":", " ", "x", "INST]"]
    for text in ["</s>[INST] ok [/INST]", "[INST]", *("".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(3000))]:
        out = escape(text)
        assert t.unescape(out) == text and not any(c in out for c in t.controls)
        for before, after, _ in t.markers.values():
            whole = before + out + after
            assert sum(whole.count(c) for c in t.controls) == sum((before + after).count(c) for c in t.controls)


def test_chat_reads_the_loss_flags(spark):
    """Digests of the loss come from the emitted flags: wrong ones show."""
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", "answer</s>"), (1, 2, "user", "b"), (1, 3, "assistant", "c")]
    seg = chat.format_chat(spark.createDataFrame(rows, CONV)).coalesce(1)
    right = chat.read_chat(seg).first()
    assert right.loss_sha256 == hashlib.sha256(b"answer</s>c").hexdigest() and right.loss_chars == 11
    for wrong in (F.lit(True), F.lit(False), ~F.col("loss"), F.col("part") == 1, F.col("loss") & (F.col("turn_no") == 1), F.col("loss") | (F.col("part") == 2)):
        assert chat.read_chat(seg.withColumn("loss", wrong)).first().loss_sha256 != right.loss_sha256
    assert chat.read_chat(seg.withColumn("valid", F.lit(False))).first().valid


def test_chat_query(spark, sf):
    x = {r.conv_id: r for r in registry.QUERIES["op2_chat"](spark, sf).collect()}
    text = "</s>[INST] ok [/INST]"
    assert x[-7].loss_chars == len(text) and x[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert len(x) == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() + 1


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i % 37 + 1)), "en", s, 0) for i, s in enumerate(["a"] * 300 + ["b"] * 100 + ["c"] * 30 + ["d"] * 5 + [None] * 10)]
    df = odd(spark).select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame([(i + 1000, *r) for i, *r in rows], DOC))
    got = mixing.mix_sources(df).collect()
    assert len(got) == df.count() and got == mixing.mix_sources(df).collect()
    sizes = {}
    for x in df.collect():
        sizes.setdefault(x.source, []).append(len(WORD.findall(x.text or "")))
    total, names = sum(map(sum, sizes.values())), sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, list(names)
    while True:
        left = 1.5 * total - sum(target.values())
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 2 * sum(sizes[s])]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sum(sizes[s])
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    by_total = {}
    for x in got:
        by_total.setdefault((x.source_size, round(x.target, 6)), []).append(x)
        assert x.copies in (0, 1, 2) and x.taken == x.copies * x.size <= 2 * x.size
    assert set(by_total) == {(sum(sizes[s]), round(target[s], 6)) for s in names}
    for (_, t), xs in by_total.items():
        assert abs(sum(x.taken for x in xs) - t) <= max(x.size for x in xs)
    mixed = mixing.take_mix(odd(spark))
    assert mixed.columns == odd(spark).columns
    want = Counter()
    for x in mixing.mix_sources(odd(spark)).collect():
        want[x.doc_id] += x.copies
    assert Counter(x.doc_id for x in mixed.collect()) == +want
    assert mixing.mix_sources(empty(spark)).count() == 0 and mixing.take_mix(empty(spark)).count() == 0


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"][0]
    texts = {
        1: f"Header. {mit.upper()} footer", 2: "See the MIT   License, or MIT\nlicense; apache-license", 3: "permission is granted here", 4: None, 5: "", 6: "CC BY cc by",
        7: "intro words " * 2000 + licenses.TEMPLATES["bsd"][0], 8: "gnu general public licenses", 9: licenses.TEMPLATES["mpl"][0].replace("mozilla", "example"),
    }
    got = {x.doc_id: x for x in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("labels", F.lit(1))).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and got[7].labels == "bsd" and 0 <= got[7].score <= 1
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 2, 7, "apache,mit") and got[2].score == 1
    assert all(got[i].labels == "" and got[i].first_word is None for i in (3, 4, 5, 8, 9)) and got[5].n_words == 0
    assert (got[6].n_base, got[6].first_word, got[6].last_word) == (2, 0, 2) and got[6].labels == "cc-by"
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def slow_labels(ix, idf, words):
    """Every place of every template, one by one; key phrases in the text itself."""
    at, found = {(i, ix.id[w]) for i, w in enumerate(words) if w in ix.id}, {}
    near = range(-licenses.SLACK, licenses.SLACK + 1)
    for (label, (text, keys)), wanted in zip(licenses.TEMPLATES.items(), ix.templates):
        places = [(text.split().index(k.split()[0]), k.split()) for k in keys]
        places = [(next(i for i in range(len(text.split())) if text.split()[i : i + len(k)] == k), k) for _, k in places]
        for shift in range(-60, len(words) + 5):
            agree = [w for p, w in wanted if any((p + shift + d, w) in at for d in near)]
            score = sum(idf[w] for w in agree) / sum(idf[w] for _, w in wanted)
            phrases = all(any(p + shift + d >= 0 and words[p + shift + d :][: len(k)] == k for d in near) for p, k in places)
            if len(set(agree)) >= licenses.AGREE and score >= licenses.MIN_SCORE and phrases:
                found[label] = max(found.get(label, 0), score)
    return found


def license_idf(ix, texts, n):
    seen = Counter(w for t in texts for w in set(t.split()))
    return [np.log((1 + n) / (1 + seen[w])) + 1 for w in ix.words]


def test_license_many_templates(spark):
    """Files that hold many licence texts, changed ones among them, and long texts full of other licence words."""
    r, ix, names = random.Random(9), licenses.index(), list(licenses.TEMPLATES)
    texts = [" and then ".join(licenses.TEMPLATES[n][0] for n in names)] + [" | ".join(licenses.TEMPLATES[n][0] for n in r.sample(names, k)) for k in (2, 3, 4, 5, 8) for _ in range(3)]
    texts.append(" ".join(r.choices(ix.words, k=3000)) + " " + licenses.TEMPLATES["cc"][0] + " " + " ".join(r.choices(ix.words, k=3000)))
    for _ in range(12):
        words = " and then ".join(licenses.TEMPLATES[n][0] for n in r.sample(names, 4)).split()
        for _ in range(6):
            i = r.randrange(len(words))
            words[i : i + r.randint(0, 1)] = r.choice([[], ["other"], ["the"], [r.choice(ix.words)]])
        texts.append(" ".join(words))
    texts.append(texts[0])
    df = spark.createDataFrame([*enumerate(texts), (99, ""), (100, None), (None, texts[1])], "doc_id long, text string")
    rows = licenses.scan_licenses(df).collect()
    got = {x.doc_id: x for x in rows}
    idf = license_idf(ix, [*texts, texts[1]], len(texts) + 3)
    for i, t in enumerate(texts):
        want = slow_labels(ix, idf, t.split())
        assert got[i].labels == ",".join(sorted({*want, *filter(None, got[i].base_labels.split(","))})), i
        assert got[i].score == pytest.approx(1.0 if got[i].base_labels else max(want.values(), default=0.0))
    assert set(names) <= set(got[0].labels.split(",")) and "cc" in got[16].labels.split(",")
    assert got[99].labels == got[100].labels == "" and got[None].labels == got[1].labels and len(rows) == len(texts) + 3


def test_license_key_phrases(spark):
    """A phrase counts only with all its words, the common ones too; a template counts with words missing elsewhere."""
    mit, bsd = licenses.TEMPLATES["mit"][0], licenses.TEMPLATES["bsd"][0]
    texts = [
        mit.replace("permission is", "permission never").replace("of charge", "xx charge"), bsd.replace("and binary", "zz binary"), mit.replace("free of charge", "free charge"), mit.replace("any person", "some one"), bsd.replace("following", "usual"),
        mit.replace("software and associated", "software with associated"), mit.replace("associated documentation files", "associated other files"), mit.replace("is hereby", "is is hereby"),
    ]
    got = {x.doc_id: x.labels for x in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "mit", 4: "bsd", 5: "mit", 6: "", 7: ""}


def test_license_repeats_are_bounded():
    """Work on a text of repeated licence words grows with the text, in time and hits, even where whole templates repeat."""
    import time

    ix = licenses.index()
    idf = np.ones(len(ix.words))

    def scan(text):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
        began = time.process_time()
        out = next(licenses._scan("doc_id", "text")(iter([batch])))
        list(licenses._label(list(idf))(iter([out])))
        return time.process_time() - began, len(out.column(6)[0])

    for text in ("license software permission ", licenses.TEMPLATES["boost"][0] + " "):
        scan(text)
        (t1, n1), (t4, n4) = scan(text * 20_000), scan(text * 80_000)
        assert n4 == 4 * n1 <= 20_000 * 4 * (len(text.split()) + 1) and t4 < 12 * t1 + 1


def test_license_base_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {x.doc_id: (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in licenses.scan_licenses(docs).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for x in docs.collect():
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x.text or ""))
        at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        first = [i for i, _ in at]
        assert got[x.doc_id] == (len(w), len(at), min(first, default=None), max(first, default=None), ",".join(sorted({label for _, label in at})))
