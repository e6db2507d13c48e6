"""Suffix-array dedup: removal of every byte inside a string of `length` bytes that also starts elsewhere.

Finding the repeats of a corpus needs no suffix array of the whole: every window of `length` bytes is put with
its least `k`-gram by hash (its minimiser, the leftmost of equals), so equal windows have equal minimisers.
Consecutive windows with the same minimiser at the same place form a run, a string of at most 2 * length - k
bytes in which no window repeats. Then

1. runs are counted by minimiser and string, with map-side combine. A run whose string occurs twice is repeated
   as a whole. A run whose minimiser occurs in no other run is not repeated at all. Both need no text.
2. The other runs, those of texts that agree only in part, are fetched from the texts, one copy of each string,
   and put by minimiser into blocks of bounded size. A block's strings are joined by separators and sorted into
   a suffix array to the depth `length`; from its Burrows-Wheeler transform, intervals are extended to the left
   breadth first. The step in which a boundary between neighbours in the suffix order is first met is their
   common prefix, so common prefixes come out by increasing value; the expansion stops at `length`, and
   neighbours without a boundary by then share a window. Only parts whose windows have a rolling hash that occurs
   twice in the block are sorted, as other windows cannot repeat; the cost of a string therefore does not grow with
   the number of strings that hold its minimiser.
3. A minimiser with too many different strings for one block is split: the places that it can have in a window are
   halved, the windows of either half have more bytes than the minimiser in common, and the hash of those is their
   key; this is repeated until the groups fit or the key holds the whole window, when counting decides. So no group is ever gathered beyond a bound, and nothing is dropped.

Where strings are counted they are compared by 64-bit hashes of the minimiser and of the string, and byte by
byte (suffix order) in blocks.

Nulls: a null text is empty; a row with a null id takes no part: it keeps its text and is no other's copy. Ids are
unique but for repeated rows. Texts shorter
than `length`, empty texts and empty tables have no spans. Repeated rows are repeats of each other and lose all
their windows. Further columns are ignored by repeated_spans and kept by drop_repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.common import materialize, ship, table
from quirefold.llm import textcore as tc

LENGTH, GRAM = 200, 40
#: Strings of a minimiser that one block takes; beyond, the minimiser is split.
GROUP_STRINGS = 2_500
#: Bytes of strings from which a block is closed; a group has at most as many again.
BLOCK_BYTES = 1 << 20


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(buf: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, place of the minimiser, its hash, hash of the string) of each run; places in the buffer."""
    if len(buf) < length:
        return tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hasher = tc.Hasher(buf)
    g = hasher.grams(k)
    w = length - k + 1
    n = len(buf) - length + 1
    low = window_min(g, w)
    # the leftmost place of the minimum: the place of each gram that equals the minimum of a window, carried to the right
    doc_of = np.searchsorted(off, np.arange(n), "right") - 1
    ok = off[doc_of + 1] >= np.arange(n) + length
    place = _leftmost(g, low, w)
    at = np.flatnonzero(ok)
    if not len(at):
        return runs(buf[:0], off[:1], length, k)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (place[at[1:]] != place[at[:-1]]) | (doc_of[at[1:]] != doc_of[at[:-1]])
    i = np.flatnonzero(new)
    start = at[i]
    count = np.diff(np.append(i, len(at)))
    p = place[start]
    h = hasher.ranges(start, start + count + length - 1) + tc.mix(g[p] + (p - start).astype(np.uint64))
    return doc_of[start], start, count, p, g[p], tc.mix(h)


def _leftmost(g: np.ndarray, low: np.ndarray, w: int) -> np.ndarray:
    """For each window i, the least j >= i with g[j] == low[i]."""
    n = len(low)
    # the minimum seldom changes from a window to the next, and few grams are a minimum of a window they lie in
    change = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    length = np.diff(np.append(change, n))
    cand = np.flatnonzero(_is_min(g, low, w))
    values, number = np.unique(g[cand], return_inverse=True)
    of_change = np.searchsorted(values, low[change])
    places = np.bincount(number, minlength=len(values))
    lone = np.empty(len(values), np.int64)
    lone[number] = cand
    out = np.repeat(lone[of_change], length)
    several = np.flatnonzero(np.repeat(places[of_change] > 1, length))
    if len(several):  # the next place at or after the window's start
        pairs = np.sort(number.astype(np.int64) * len(g) + cand)
        asked = np.repeat(of_change, length)[several] * len(g) + several
        out[several] = pairs[np.searchsorted(pairs, asked)] % len(g)
    return out


def _is_min(g: np.ndarray, low: np.ndarray, w: int) -> np.ndarray:
    """Which grams equal the minimum of some window that holds them: the largest of those minima is at most the gram, so compare with it."""
    n = len(g)
    pad = np.zeros(w - 1, np.uint64)
    most = ~window_min(~np.concatenate([pad, low, pad]), w)
    return most[:n] == g


class Order:
    """The suffixes of a text of small symbols (0 parts strings) in the order of their first `depth` symbols or more.

    Prefixes are doubled in length, each step one sort of whole numbers that hold two ranks and the place. `lcp`
    has the common prefixes with the suffix before of less than `known` symbols, the length that one number holds
    at first; the others are `known`.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        place = max(1, n.bit_length())
        width = max(1, int(text.max()).bit_length())
        if 3 * place > 64 or width + place > 64:
            raise ValueError("the block is too large")
        self.known = per = min((64 - place) // width, depth)
        t = np.concatenate([text, np.zeros(per, text.dtype)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for j in range(per):
            key = key << np.uint64(width) | t[j : j + n]
        sh, low = np.uint64(place), np.uint64((1 << place) - 1)
        key = key << sh | np.arange(n, dtype=np.uint64)
        key.sort()
        differ = (key[1:] ^ key[:-1]) >> sh
        # leading symbols that agree: by the highest bit that differs
        self.lcp = np.zeros(n, np.int64)
        self.lcp[1:] = per - np.searchsorted(np.array([1 << (width * j) for j in range(per)], np.uint64), differ, "right")
        sa = (key & low).astype(np.int64)
        new = differ > 0
        rank, have = self._ranks(sa, new), per
        while have < depth and not new.all():
            nxt = np.zeros(n, np.uint64)
            nxt[: n - have] = rank[have:] + np.uint64(1)
            key = rank << sh + sh | nxt << sh | np.arange(n, dtype=np.uint64)
            key.sort()
            sa = (key & low).astype(np.int64)
            new = (key[1:] ^ key[:-1]) >> sh > 0
            rank, have = self._ranks(sa, new), 2 * have
        self.sa = sa

    @staticmethod
    def _ranks(sa: np.ndarray, new: np.ndarray) -> np.ndarray:
        r = np.empty(len(sa), np.uint64)
        r[sa[0]] = 0
        r[sa[1:]] = np.cumsum(new, dtype=np.uint64)
        return r


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its windows (by start) occur at another place in any of them."""
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    total = int(sizes.sum() + len(sizes))
    raw = np.frombuffer(b"\x00".join([*strings, b""]), np.uint8)
    ends = starts + sizes
    body = np.ones(total, bool)
    body[ends] = False
    code = np.zeros(256, np.int64)
    used = np.unique(raw[body])
    code[used] = np.arange(1, len(used) + 1)
    text = np.where(body, code[raw], 0).astype(np.int32)  # 0: the separator
    order = Order(text, length)
    flags = _expand(text, order, length)
    left = np.repeat(ends, sizes + 1) - np.arange(total)  # symbols up to the separator
    sa = order.sa
    whole = left[sa] >= length
    same = np.zeros(total, bool)
    join = flags[1:] & whole[1:] & whole[:-1]
    same[sa[1:][join]] = True
    same[sa[:-1][join]] = True
    return [same[a : a + max(0, s - length + 1)] for a, s in zip(starts.tolist(), sizes.tolist())]


def suspects(strings: list[bytes], length: int) -> tuple[list[int], list[int], list[bytes]]:
    """(string, offset, bytes) of the parts made of windows whose rolling hash occurs twice; all windows that repeat lie in them."""
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    count = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(strings)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    if not len(at):
        return [], [], []
    grams = tc.Hasher(np.frombuffer(b"".join(strings), np.uint8)).grams(length)
    i = np.flatnonzero(tc.repeated(grams[starts[owner] + at]))
    owner, at = owner[i], at[i]
    edge = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(np.concatenate([[True], edge])) if len(i) else i
    last = np.append(first[1:], len(i)) - 1
    of, low, high = owner[first].tolist(), at[first].tolist(), at[last].tolist() if len(i) else []
    return of, low, [strings[o][a : b + length] for o, a, b in zip(of, low, high)]


def _expand(text: np.ndarray, order: Order, length: int) -> np.ndarray:
    """For each place in the suffix order, whether it shares `length` symbols with the one before, by breadth-first backward extension.

    A level holds the intervals of strings of one length whose right boundary was met in the step before for the
    first time; symbol 0 is never extended over. The first levels are those that the order's keys show.
    """
    n, sa = len(text), order.sa
    bwt = text[sa - 1].astype(np.uint64)  # the last symbol of the text is a separator, so wrapping round is harmless
    place, sym = np.uint64(max(1, n.bit_length())), np.uint64(9)
    key = bwt << place | np.arange(n, dtype=np.uint64)
    key.sort()
    lf = np.empty(n, np.uint64)
    lf[(key & np.uint64((1 << int(place)) - 1)).astype(np.int64)] = np.arange(n, dtype=np.uint64)
    known = order.known
    open_ = np.append(order.lcp >= known, False)  # boundaries not met yet
    open_[0] = False
    if known >= length:
        return open_[:n]
    # strings of length `known`: intervals between boundaries, of which those are new whose right one shares one symbol less
    edges = np.append(np.flatnonzero(~open_[:n]), n)
    lcp = np.append(order.lcp, -1)
    new = lcp[edges[1:]] == known - 1
    lb, rb = edges[:-1][new], edges[1:][new] - 1
    clean = left_of_separator(text, known)[sa[lb]]
    lb, rb = lb[clean], rb[clean]
    for _ in range(known, length):
        if not len(lb):
            break
        size = rb - lb + 1
        inside = np.repeat(lb - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        label = np.repeat(np.arange(len(lb), dtype=np.uint64), size)
        c = bwt[inside]
        packed = (lf[inside] << place | label) << sym | c
        packed = packed[c != 0]
        if not len(packed):
            break
        packed.sort()
        to = (packed >> (place + sym)).astype(np.int64)
        what = packed & np.uint64((1 << int(place + sym)) - 1)  # label and symbol
        cut = (to[1:] != to[:-1] + 1) | (what[1:] != what[:-1])
        a, b = to[np.concatenate([[True], cut])], to[np.concatenate([cut, [True]])]
        fresh = open_[b + 1]
        lb, rb = a[fresh], b[fresh]
        open_[rb + 1] = False
    return open_[:n]


def left_of_separator(text: np.ndarray, k: int) -> np.ndarray:
    """Whether no separator is among the k symbols from each place."""
    n = len(text)
    zeros = np.concatenate([[0], np.cumsum(text == 0)])
    end = np.minimum(np.arange(n) + k, n)
    return (zeros[end] == zeros[:n]) & (np.arange(n) + k <= n)


def _spans(on: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the windows that are on."""
    d = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(d == 1).tolist(), (np.flatnonzero(d == -1) + length - 1).tolist()))


def _minimizers(length: int, k: int):
    @tc.thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in tc.slices(batch, "text"):
                doc, start, count, p, h, s = runs(buf, off, length, k)
                if len(doc):
                    yield pa.RecordBatch.from_arrays(
                        [tc.id_array(rows, "id").take(pa.array(doc)), pa.array((start - off[doc]).astype(np.int64)), pa.array(count.astype(np.int16)), pa.array((p - start).astype(np.int16)), pa.array(h.view(np.int64)), pa.array(s.view(np.int64))],
                        ["id", "start", "windows", "at", "h", "s"],
                    )

    return run


def _fetch(length: int):
    """From (id, text, asks: array of (start, windows, at, h, s)): the strings asked for."""

    @tc.thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, texts, asks = batch.columns
            out: list[tuple] = []
            size = 0
            for text, ask in zip(texts.to_pylist(), asks.to_pylist()):
                for a in ask:
                    out.append((a["h"], a["s"], a["at"], text[a["start"] : a["start"] + a["windows"] + length - 1]))
                    size += a["windows"] + length
                if size > 8 << 20:
                    yield _strings(out)
                    out, size = [], 0
            if out:
                yield _strings(out)

    return run


def _strings(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int16()), pa.array([x[3] for x in out], pa.binary())], ["h", "s", "at", "string"])


_FOUND = "s long, parts array<struct<a:int,b:int>>"


def _found(rows: list[tuple[int, list[tuple[int, int]]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in r[1]] for r in rows], kind)], ["s", "parts"])


def _blocks(length: int):
    """Rows sorted by group: strings are compared in blocks of whole groups; a block is closed when it is large enough."""

    def compare(strings: dict[int, bytes]) -> pa.RecordBatch | None:
        keys = list(strings)
        of, low, parts = suspects([strings[s] for s in keys], length)
        got: dict[int, list[tuple[int, int]]] = {}
        for i, at, on in zip(of, low, repeated_windows(parts, length) if parts else []):
            if on.any():
                got.setdefault(keys[i], []).extend((at + a, at + b) for a, b in _spans(on, length))
        return _found(list(got.items())) if got else None

    @tc.thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: dict[int, bytes] = {}
        group, size = None, 0
        for batch in batches:
            g, s, string = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("h", "s", "string"))
            for gi, si, x in zip(g, s, string):
                if gi != group and size > BLOCK_BYTES:
                    if (found := compare(strings)) is not None:
                        yield found
                    strings, size = {}, 0
                group = gi
                strings[si] = x
                size += len(x)
        if strings and (found := compare(strings)) is not None:
            yield found

    return run


def _split_keys(length: int, k: int, depth: int):
    """Parts of strings (g, s, offset in the string, part). The places that a minimiser can have in a window are halved
    `depth` times; the windows of one such range have more bytes than the minimiser in common, whose hash is the key."""
    wide = length - k + 1
    step = -(-wide // (1 << depth))

    @tc.thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, s, at, string = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("h", "s", "at", "string"))
            out: list[tuple[int, int, int, bytes]] = []
            for hi, si, p, x in zip(h, s, at, string):
                seed = hi.to_bytes(8, "little", signed=True)
                for low in range(0, wide, step):
                    high = min(low + step, wide) - 1
                    a, b = max(0, p - high), min(len(x) - length, p - low)
                    if a <= b:
                        d = hashlib.blake2b(x[p - low : p - high + length], digest_size=8, salt=low.to_bytes(8, "little"), key=seed).digest()
                        out.append((int.from_bytes(d, "little", signed=True), si, a, x[a : b + length]))
                if len(out) > 20_000:
                    yield _parts(out)
                    out = []
            if out:
                yield _parts(out)

    return run


def _parts(out: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.binary())], ["g", "s", "shift", "string"])


def _hot(strings: DataFrame, hot: DataFrame, length: int, k: int, most: int) -> DataFrame:
    """Found parts of the strings of minimisers in `hot`, by splitting their keys until groups fit."""
    rest = strings.join(hot, "h", "left_semi")
    found = None
    last = max(1, (length - k).bit_length())  # then a part is one window
    for depth in sorted({*range(1, last, 2), last}):
        parts = rest.mapInArrow(_split_keys(length, k, depth), "g long, s long, shift int, string binary")
        sized = parts.groupBy("g").agg(F.count("*").alias("m"))
        parts = parts.withColumn("p", F.xxhash64("s", "shift"))
        if depth == last:
            again = parts.join(sized.filter("m > 1").select("g"), "g", "left_semi")
            got = again.select("s", F.array(F.struct(F.col("shift").alias("a"), (F.col("shift") + length).cast("int").alias("b"))).alias("parts"))
            return got if found is None else found.unionByName(got)
        fits = parts.join(sized.filter((F.col("m") > 1) & (F.col("m") <= most)).select("g"), "g", "left_semi")
        same = fits.select(F.col("g").alias("h"), F.col("p").alias("s"), "string").repartition("h").sortWithinPartitions("h").mapInArrow(_blocks(length), _FOUND).withColumnRenamed("s", "p")
        got = fits.select("p", "s", "shift").join(same, "p").select("s", F.transform("parts", lambda x: F.struct((x["a"] + F.col("shift")).alias("a"), (x["b"] + F.col("shift")).alias("b"))).alias("parts"))
        got = materialize(got, "split-found")
        found = got if found is None else found.unionByName(got)
        over = parts.join(sized.filter(F.col("m") > most).select("g"), "g", "left_semi").select("s").distinct()
        left = materialize(rest.join(over, "s", "left_semi"), "split-rest")
        if left.isEmpty():
            return found
        rest = left
    return found


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int | None = None, group_strings: int = GROUP_STRINGS) -> DataFrame:
    """(id, spans: array of (a, b)): for each text with repeats, the byte ranges that repeated windows cover, in order and merged."""
    ship(df.sparkSession)
    k = min(GRAM, max(1, length // 5)) if k is None else k
    texts = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = texts.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("start", T.LongType()), T.StructField("windows", T.ShortType()), T.StructField("at", T.ShortType()), T.StructField("h", T.LongType()), T.StructField("s", T.LongType())])
    all_runs = materialize(texts.filter(F.length("text") >= length).mapInArrow(_minimizers(length, k), schema), "all-runs")  # else windows are hashed twice
    # one row per minimiser: whether it occurs twice, and in different strings
    by_min = all_runs.groupBy("h").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).filter("n > 1")
    by_min = by_min.select("h", (F.col("lo") != F.col("hi")).alias("mixed"))
    # runs of minimisers that occur once are gone from here on
    kept = materialize(all_runs.join(by_min, "h"), "runs")
    counts = kept.groupBy("h", "s").agg(F.count("*").alias("c"), F.first("mixed").alias("mixed"), F.min(F.struct("id", "start", "windows", "at")).alias("one"))
    counts = materialize(counts, "strings")
    asks = counts.filter("mixed").select("one.id", F.struct("one.start", "one.windows", "one.at", "h", "s").alias("ask")).groupBy("id").agg(F.collect_list("ask").alias("asks"))
    strings = texts.join(asks, "id").select("id", "text", "asks").mapInArrow(_fetch(length), "h long, s long, at short, string binary")
    strings = materialize(strings, "run-strings")
    group_strings = min(group_strings, BLOCK_BYTES // (2 * length))
    hot = materialize(counts.filter("mixed").groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > group_strings).select("h"), "hot")
    cool = strings.join(hot, "h", "left_anti")
    found = cool.select("h", "s", "string").repartition("h").sortWithinPartitions("h").mapInArrow(_blocks(length), _FOUND)
    if not hot.isEmpty():
        found = found.unionByName(_hot(strings, hot, length, k, group_strings))
    found = found.select("s", F.explode("parts").alias("part"))
    partial = kept.join(counts.filter("mixed and c = 1").select("h", "s"), ["h", "s"]).join(found, "s").select("id", (F.col("start") + F.col("part.a")).alias("a"), (F.col("start") + F.col("part.b")).alias("b"))
    whole = kept.join(counts.filter("c > 1").select("h", "s"), ["h", "s"]).select("id", F.col("start").alias("a"), (F.col("start") + F.col("windows") + (length - 1)).alias("b"))
    spans = whole.unionByName(partial).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    return spans.withColumnRenamed("id", id_col)


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans or []:
        a, b = s["a"], s["b"]
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, spans = batch.columns
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            text, cut = text or b"", merged(own)
            h, at = hashlib.sha256(), 0
            for a, b in cut:
                h.update(text[at:a])
                at = b
            h.update(text[at:])
            out.append((len(text), sum(b - a for a, b in cut), len(cut), h.hexdigest()))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[j] for x in out], pa.int64()) for j in range(3)), pa.array([x[3] for x in out], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def whole_characters(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    """What is left when of each span only the characters that lie in it as a whole are removed."""
    out, at = [], 0
    for a, b in cut:
        while a < len(text) and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = max(a, b)
    out.append(text[at:])
    return b"".join(out)


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """df with the repeated bytes cut out of its texts, whole characters only; rows whose text is cut away entirely go. n_chars, if there, is counted anew."""
    spans = repeated_spans(df, id_col, text_col, length).withColumnRenamed(id_col, "_id").withColumnRenamed("spans", "_spans")
    joined = df.join(spans, df[id_col] == F.col("_id"), "left").drop("_id")
    names = [*df.columns, "_spans"]
    t, s = names.index(text_col), len(df.columns)

    @tc.thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(t).to_pylist()
            left = [x if not own else whole_characters(x.encode(), merged(own)).decode() for x, own in zip(texts, batch.column(s).to_pylist())]
            cols = list(batch.columns[:s])
            cols[t] = pa.array(left, batch.column(t).type)
            yield pa.RecordBatch.from_arrays(cols, names[:s]).filter(pa.array([not old or bool(new) for old, new in zip(texts, left)]))

    out = joined.select(*names).mapInArrow(run, df.schema)
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text_col), F.lit(0)).cast(df.schema["n_chars"].dataType)).select(*df.columns)
    return out


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
    spans = repeated_spans(docs)
    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


QUERIES = {"op10_suffix": op10_suffix}
ORACLES: dict[str, str] = {}
