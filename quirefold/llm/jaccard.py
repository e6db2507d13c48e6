"""N-gram Jaccard join by grouped prefixes, exact for a threshold.

Texts are sets of hashed `width`-word shingles. Two sets with 100 * |x & y| >= PERCENT * |x | y| share a token
among the first p(x), p(y) of any common order of tokens, with p(n) = n - ceil(n * PERCENT / 100) + 1.

1. Equal sets collapse into one class, classes with the same size and the same first tokens (by hash) into one
   group; only groups take part in the join. A head holds somewhat more than p tokens.
2. Tokens in heads of more than HOT groups are hot and go last in the order, so prefixes are made of rare tokens.
   Where a head has fewer than p others, as in texts that share long notices, it is made anew from all tokens of the
   text, until every group has its p rare tokens or has been seen whole. The latter are `dense`: more than
   100 - PERCENT % of their tokens are hot.
3. Rare tokens of prefixes are joined, but for those that a Bloom filter shows to be of one head: at most HOT groups meet at one. Pairs of groups (length filter) are reduced
   to one row (map-side combine) and filtered by the differences that their prefixes already show. Whatever a
   dense group shares with one that isn't dense is found here, as the latter's prefix is all rare.
4. Dense groups that share hot tokens alone are a few large clusters, whose pairs are never listed. They collapse
   into buckets by their first hot tokens and size class; buckets, not groups, are joined by the hot tokens of
   their members' prefixes. The number of buckets of a cluster hardly grows with it.
5. Candidates are verified in cells of two blocks of at most about BLOCK classes: a block is part of a large group
   or bucket, or some small ones of one connected component of candidates. A cell exists only where two blocks
   have candidates, and only the classes that take part are sent to it, so a component of loose chains costs by its
   candidate pairs and a tight cluster by its blocks. A class has one block, so that each pair is met in one cell. Sets
   (from the texts, those classes only) are compared there by matrix products. A cell returns links by class and
   a spanning forest, never its pairs.

Exact for texts of any length: sizes are compared as integers, tokens by 64-bit hashes. Hot keys: copies are
collapsed before the join, common tokens aren't joined by pairs, cells are bounded, and skewed joins are left to
adaptive execution.

Nulls: a null text, or one without words, has an empty set: n_shingles 0, n_similar 0, its own component. A row with
a null id takes part like any other; its id stays null, also as the component of rows of null ids alone, and ids
must be below 2**62 where there are such rows. Texts of fewer words than `width` are one shingle. Ties and repeated
rows: copies of one class, linked with each other; ids are unique but for repeated rows. Empty table: no rows.
Further columns are ignored by jaccard_join and kept by keep_one, which keeps all rows of null ids, as it drops by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.common import materialize, ship, table
from quirefold.llm import textcore as tc
from quirefold.llm.components import connected_components, sized

WIDTH, PERCENT, HOT, BLOCK = 5, 90, 64, 256
#: First hot tokens whose equality makes a bucket of dense groups.
SIGNATURE = 3
#: Tokens of a class from which it takes the room of several in a block.
LONG_SET = 1000
#: Bits of a bitmap of shared tokens.
MAP_BITS = 1 << 15
#: Numbers from here on stand for rows without id.
NO_ID = 1 << 62


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct tokens of each text."""
    low = tc.LOWER[buf]
    w = tc.Words(low, off)
    h = tc.Hasher(low).ranges(w.start, w.end)
    g = tc.ngram_hashes(h, width)
    out = []
    for a, c in zip(w.first[:-1].tolist(), w.count.tolist()):
        if c >= width:
            s = np.sort(g[a : a + c - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif c:
            out.append(tc.mix(np.array([(h[a : a + c] * tc.WORD_MULT[width : width + c]).sum() + tc.U64(c)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _lists(sets: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))


def _i64(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _heads(width: int, percent: int):
    @tc.thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in tc.slices(batch, "text"):
                sets = shingle_sets(buf, off, width)
                p = [prefix_length(len(s), percent) if len(s) else 0 for s in sets]
                heads = [s[: q + q // 4 + 8] for s, q in zip(sets, p)]
                hashed = [(int(s.sum()), int(tc.mix(s ^ tc.WORD_MULT[0]).sum()), int((tc.mix(x + tc.WORD_MULT[1])).sum())) for s, x in zip(sets, heads)]
                cols = [tc.id_array(rows, "key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(p, pa.int64())]
                cols += [_i64([x[j] for x in hashed]) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*cols, _lists(heads)], ["key", "n", "p", "k1", "k2", "hh", "head"])

    return run


def _sets(width: int):
    @tc.thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in tc.slices(batch, "text"):
                rest = [rows.column(i) for i in range(rows.num_columns) if rows.schema.names[i] != "text"]
                names = [c for c in rows.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*rest, _lists(shingle_sets(buf, off, width))], [*names, "tokens"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    m = len(sets)
    out = np.zeros((m, m))
    if m <= 6:
        for i in range(m):
            for j in range(i + 1, m):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    if not len(column):
        return out
    column = np.cumsum(np.concatenate([[0], (column[1:] != column[:-1]).astype(np.int64)]))
    for low in range(0, int(column[-1]) + 1, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        x = np.zeros((m, min(4096, int(column[-1]) + 1 - low)), np.float32)
        x[owner[a:b], column[a:b] - low] = 1
        out += x @ x.T
    return out


def _cells(percent: int):
    """Rows (lo, hi, block, cls, copies, tokens) sorted by cell: links and a spanning forest of the links that cross the cell's two blocks."""

    def solve(rows: list[tuple[int, int, int, np.ndarray]], cross: bool) -> Iterator[tuple[int, int, int]]:
        rows.sort(key=lambda r: r[1])
        block, cls, copies, sets = zip(*rows)
        inter = np.rint(overlaps(list(sets))).astype(np.int64)
        size = np.array([len(s) for s in sets])
        linked = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
        np.fill_diagonal(linked, False)
        if cross:
            b = np.array(block)
            linked &= b[:, None] != b[None, :]
        weight = linked @ np.array(copies, np.int64)
        root = np.arange(len(cls))
        for x in range(len(cls)):  # rows are in order of class, so the first reached is the least
            if root[x] == x:
                todo = [x]
                while todo:
                    for y in np.flatnonzero(linked[todo.pop()]).tolist():
                        if y > x and root[y] == y:
                            root[y] = x
                            todo.append(y)
        for x in np.flatnonzero(linked.any(1)).tolist():
            yield cls[x], int(weight[x]), cls[root[x]]

    @tc.thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            lists = get("tokens")
            offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            done: list[tuple[int, int, int]] = []
            for k, (lo, hi, block, cls, copies) in enumerate(zip(*(get(c).to_pylist() for c in ("lo", "hi", "block", "cls", "copies")))):
                if cell is not None and (lo, hi) != cell:
                    done += solve(rows, cell[0] != cell[1])
                    rows = []
                cell = (lo, hi)
                if rows and rows[-1][1] == cls:  # a repeated row of the table
                    continue
                rows.append((block, cls, copies, flat[offs[k] : offs[k + 1]].copy()))
            if done:
                yield _links(done)
        if rows:
            yield _links(list(solve(rows, cell[0] != cell[1])))

    return run


def _links(done: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(3)], ["cls", "links", "root"])


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text): the id, or for the rows without one a number beyond all ids, which are written so that it stays."""
    texts = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    none = texts.filter("key IS NULL")
    if none.isEmpty():
        return texts.filter("key IS NOT NULL")
    return texts.filter("key IS NOT NULL").unionByName(materialize(none.withColumn("key", F.lit(NO_ID) + F.monotonically_increasing_id()), "rows-without-id"))


def _ranked(groups: DataFrame, texts: DataFrame, width: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(rows, dense) of groups (g, n, p, head). rows: (token, g, n, p, r), the rare tokens of each prefix that two groups share; dense: (g, n, sig, token), the hot ones of dense groups with their first ones' hash.

    Each round makes the heads of groups whose rare tokens don't suffice anew from their whole texts, adds the tokens
    that they didn't have to the counts, and ends when no group needs it. Tokens of one head aren't kept, so one that
    comes later is counted as if a head had it before: at most once too often, and any counts give an exact order.
    """
    heads = groups.withColumn("whole", F.size("head") >= F.col("n"))
    counts = materialize(heads.select(F.explode("head").alias("token")).groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "tokens")
    prefix = "g long, n long, p long, r int, token long, hot boolean, dense boolean, sig long"
    while True:
        rows = heads.select("g", F.posexplode("head").alias("rank", "token"))
        hots = counts.filter(F.col("df") > hot).select("token", "df")
        if hots.isEmpty():
            rows = heads.select("g", "n", "p", "head").mapInArrow(_order(_shared(counts)), prefix)
            return materialize(rows.select("token", "g", "n", "p", "r").join(counts.select("token"), "token"), "prefix-rows"), rows.limit(0).select("g", "n", "sig", "token")
        hots = sized(hots)  # else all token rows would be shuffled in each round, only to be counted by group
        n_hot = rows.join(hots, "token").groupBy("g").agg(F.count("*").alias("n_hot"))
        spare = heads.filter(~F.col("whole")).select("g", (F.size("head") - F.col("p")).alias("spare"))  # heads themselves stay where they are
        short = materialize(spare.join(n_hot, "g").filter("spare < n_hot").select("g"), "short-heads")
        if short.isEmpty():
            break
        more = texts.join(sized(short), texts["key"] == short["g"]).select("g", "text").mapInArrow(_sets(width), "g long, tokens array<long>").dropDuplicates(["g"])
        longer = materialize(groups.select("g", "n", "p", F.size("head").alias("had")).join(more, "g").select("g", "n", "p", F.col("tokens").alias("head"), F.lit(True).alias("whole"), "had"), "longer-heads")
        new = longer.select("had", F.posexplode("head").alias("rank", "token")).filter("rank >= had").groupBy("token").agg(F.count("*").alias("more"))
        counts = materialize(counts.join(new, "token", "full").select("token", (F.coalesce("df", F.lit(1)) + F.coalesce("more", F.lit(0))).alias("df")), "tokens")
        heads = materialize(heads.join(sized(short), "g", "left_anti").select("g", "n", "p", "head", "whole").unionByName(longer.drop("had")), "heads")
    # heads without a hot token are in order as they are; the others are put in order, rare tokens by hash, then hot ones, rarer classes first
    order = _order(_shared(counts))
    mixed = materialize(n_hot.select("g"), "groups-with-hot")
    plain = heads.join(sized(mixed), "g", "left_anti").select("g", "n", "p", "head").mapInArrow(order, prefix)
    own = rows.join(hots, "token").groupBy("g").agg(F.collect_list(F.struct("rank", F.floor(F.log2("df")).cast("int").alias("l"))).alias("hots"))  # at most a text's own tokens
    mixed = materialize(heads.join(sized(mixed), "g", "left_semi").join(own, "g").select("g", "n", "p", "head", "hots.rank", "hots.l").mapInArrow(order, prefix), "ordered-heads")
    rare = plain.unionByName(mixed.filter("not hot")).select("token", "g", "n", "p", "r").join(counts.select("token"), "token")
    return materialize(rare, "prefix-rows"), mixed.filter("dense and hot").select("g", "n", "sig", "token")


def _shared(counts: DataFrame) -> Broadcast:
    """A Bloom filter of the tokens, for the workers: most tokens are of one head and need not be shuffled to be dropped. 32 MB at most, then less sharp.

    Bitmaps of MAP_BITS, chosen by the lowest bits of a token, as heads are made of the tokens with the least highest ones.
    """
    count = counts.count()
    maps = 1 << min(13, max(0, (8 * count // MAP_BITS).bit_length()))

    @tc.thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            tokens = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            which, places = _places(tokens, maps)
            for m in np.unique(which).tolist():
                own = bits.setdefault(m, np.zeros(MAP_BITS, bool))
                for at in places:
                    own[at[which == m]] = True
        if bits:
            yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in bits.values()], pa.binary())], ["m", "bits"])

    by_map = counts.select("token", F.col("token").bitwiseAND(F.lit(maps - 1)).alias("m")).repartition("m").mapInArrow(run, "m long, bits binary")
    out = np.zeros((maps, MAP_BITS // 8), np.uint8)
    for m, bits in by_map.toLocalIterator():
        out[m] = np.frombuffer(bits, np.uint8)
    return counts.sparkSession.sparkContext.broadcast(out)


def _places(tokens: np.ndarray, maps: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bitmap of each token, and its places there."""
    which = (tokens & np.uint64(maps - 1)).astype(np.int64)
    return which, [(tokens >> np.uint64(s) & np.uint64(MAP_BITS - 1)).astype(np.int64) for s in (13, 28)]


def _order(shared: Broadcast):
    """Prefixes of heads (g, n, p, head; where there are any, ranks and classes of hot tokens) in the common order, without rare tokens that no other head has."""

    @tc.thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = shared.value
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(8)]
            g, n, p = (batch.column(i).to_pylist() for i in range(3))
            for i in range(batch.num_rows):
                head = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                first, hot = np.arange(min(p[i], len(head))), np.zeros(min(p[i], len(head)), bool)
                if batch.num_columns > 4:
                    level = np.zeros(len(head), np.int32)
                    level[batch.column(4)[i].values.to_numpy()] = batch.column(5)[i].values.to_numpy()
                    first = np.argsort(level, kind="stable")[: p[i]]
                    hot = level[first] > 0
                tokens = head[first]
                sig = int(tc.mix(tokens[hot][:SIGNATURE].view(np.uint64) + tc.WORD_MULT[2]).sum())
                which, places = _places(tokens.view(np.uint64), len(maps))
                kept = np.flatnonzero(hot | np.logical_and.reduce([maps[which, at >> 3] >> (at & 7) & 1 == 1 for at in places]))
                m = len(kept)
                for c, x in zip(cols, (np.full(m, g[i]), np.full(m, n[i]), np.full(m, p[i]), kept.astype(np.int32), tokens[kept], hot[kept], np.full(m, hot.any()), np.full(m, sig, np.uint64).view(np.int64))):
                    c.append(x)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["g", "n", "p", "r", "token", "hot", "dense", "sig"])

    return run


def _group_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of groups that share a rare token of their prefixes and that the filters leave. rows: as of _ranked."""
    alpha = lambda x, y: F.ceil((x + y) * percent / (100 + percent))
    need = (F.col("n") * percent <= F.col("n2") * 100) & (F.col("n2") * percent <= F.col("n") * 100)
    y = rows.select("token", F.col("g").alias("b"), F.col("n").alias("n2"), F.col("p").alias("p2"), F.col("r").alias("r2"))
    both = rows.withColumnRenamed("g", "a").join(y, "token").filter((F.col("a") < F.col("b")) & need)
    pairs = both.groupBy("a", "b", "n", "n2", "p", "p2").agg(F.count("*").alias("c"), F.max("r").alias("ra"), F.max("r2").alias("rb"))
    most = F.col("n") + F.col("n2") - 2 * alpha(F.col("n"), F.col("n2"))
    # up to where the shorter prefix ends all common tokens are known
    c2 = 2 * F.col("c")
    seen = F.least(F.col("p") + F.col("rb") + 1 - c2, F.col("p2") + F.col("ra") + 1 - c2)
    return pairs.filter(seen <= most).select("a", "b")


def _bucket_pairs(dense: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(buckets, pairs): (g, u), and (a, b) with a <= b, buckets that share a hot token and whose sizes allow a link."""
    # sizes of two classes apart are too different for a link
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int")
    rows = dense.withColumn("u", F.xxhash64("sig", step))
    buckets = materialize(rows.select("g", "u", "n").distinct(), "buckets")
    spread = buckets.groupBy("u").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    x = materialize(rows.select("token", "u").distinct().join(spread, "u"), "bucket-tokens")
    y = x.select("token", F.col("u").alias("b"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    fits = (F.col("least") * percent <= F.col("most2") * 100) & (F.col("least2") * percent <= F.col("most") * 100)
    pairs = x.withColumnRenamed("u", "a").join(y, "token").filter((F.col("a") <= F.col("b")) & fits).select("a", "b").distinct()
    return buckets.select("g", "u"), materialize(pairs, "bucket-pairs")


def candidates(classes: DataFrame, docs: DataFrame, texts: DataFrame, width: int, percent: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, pairs, wide): (cls, copies, n, g, node), group pairs, and pairs of nodes all of whose classes meet.

    A node is a bucket or a group that isn't dense. Those of several classes are a pair with themselves.
    """
    groups = classes.groupBy("hh", "n", "p").agg(F.min("cls").alias("g"), F.count("*").alias("size"))
    groups = materialize(groups, "groups")
    heads = groups.select("g", "p", "size").join(docs.select(F.col("key").alias("g"), "n", "head").filter("n > 0"), "g").select("g", "n", "p", "head").dropDuplicates(["g"])
    rows, dense = _ranked(materialize(heads, "group-heads"), texts, width, hot)
    pairs = materialize(_group_pairs(rows, percent), "pairs")
    buckets, wide = _bucket_pairs(dense, percent)
    node = groups.join(buckets, "g", "left").select("hh", "n", "p", "g", F.coalesce("u", "g").alias("node"))
    members = materialize(classes.join(node, ["hh", "n", "p"]).select("cls", "copies", "n", "g", "node"), "nodes")
    alone = members.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("node").alias("a"), F.col("node").alias("b"))
    return members, pairs, materialize(wide.union(alone).distinct(), "wide-pairs")


def _cell_rows(members: DataFrame, pairs: DataFrame, wide: DataFrame, block: int) -> DataFrame:
    """(lo, hi, block, cls, copies): the classes that each cell compares."""
    node_of = members.select("g", "node").distinct()
    left = pairs.join(node_of.select(F.col("g").alias("a"), F.col("node").alias("na")), "a").join(node_of.select(F.col("g").alias("b"), F.col("node").alias("nb")), "b")
    # where all classes of two nodes meet anyway, their group pairs are among them
    left = left.withColumn("lo", F.least("na", "nb")).withColumn("hi", F.greatest("na", "nb")).join(wide.select(F.col("a").alias("lo"), F.col("b").alias("hi")), ["lo", "hi"], "left_anti")
    narrow = materialize(left.select("a", "b", "na", "nb"), "narrow-pairs")
    comp = materialize(connected_components(narrow.select(F.col("na").alias("a"), F.col("nb").alias("b")).union(wide)).select("node", F.col("component").alias("c")), "candidates")
    # long sets count as several classes
    sizes = members.groupBy("node").agg(F.greatest(F.count("*"), F.ceil(F.sum("n") / LONG_SET)).alias("m"))
    busy = sizes.join(comp, "node", "left").join(wide.select(F.col("a").alias("node")).union(wide.select(F.col("b").alias("node"))).distinct().withColumn("w", F.lit(True)), "node", "left")
    busy = busy.filter("c IS NOT NULL OR w").select("node", "m", F.coalesce("c", "node").alias("c"))
    busy = materialize(busy, "busy-nodes")
    small = busy.filter(F.col("m") <= block).groupBy("c").agg(F.ceil(F.sum("m") / block).alias("n_blocks"))
    busy = busy.join(small, "c", "left")
    parts = F.ceil(F.col("m") / block)
    shared = F.when(F.col("m") <= block, F.xxhash64("c", F.pmod(F.xxhash64("node"), "n_blocks")))
    busy = materialize(busy.select("node", shared.alias("shared"), parts.alias("parts")), "node-blocks")
    own = F.coalesce("shared", F.xxhash64("node", F.lit("part"), F.pmod(F.xxhash64("cls"), "parts")))
    members = materialize(members.join(busy, "node").select("cls", "copies", "g", "node", own.alias("block")), "members")
    by_group, by_node = members.select("g", "block").distinct(), members.select("node", "block").distinct()
    lo, hi = F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")
    one = narrow.join(by_group.select(F.col("g").alias("a"), F.col("block").alias("x")), "a").join(by_group.select(F.col("g").alias("b"), F.col("block").alias("y")), "b")
    one = one.select(lo, hi, F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("x").alias("block")), F.struct(F.col("b").alias("g"), F.col("y").alias("block")))).alias("s")).select("lo", "hi", "s.g", "s.block").distinct()
    all_ = wide.join(by_node.select(F.col("node").alias("a"), F.col("block").alias("x")), "a").join(by_node.select(F.col("node").alias("b"), F.col("block").alias("y")), "b")
    all_ = all_.select(lo, hi, F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("block")), F.struct(F.col("b").alias("node"), F.col("y").alias("block")))).alias("s")).select("lo", "hi", "s.node", "s.block").distinct()
    rows = members.join(one, ["g", "block"]).select("lo", "hi", "block", "cls", "copies").union(members.join(all_, ["node", "block"]).select("lo", "hi", "block", "cls", "copies"))
    return materialize(rows.distinct(), "cells")


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, n_similar, component_id): one row per row of df. Ids are whole numbers."""
    ship(df.sparkSession)
    texts = _keyed(df, id_col, text_col)
    docs = materialize(texts.mapInArrow(_heads(width, percent), "key long, n long, p long, k1 long, k2 long, hh long, head array<long>"), "heads")
    classes = docs.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("key").alias("cls"), F.count("*").alias("copies"), F.min("hh").alias("hh"), F.min("p").alias("p"))
    classes = materialize(classes, "classes")
    cells = _cell_rows(*candidates(classes, docs, texts, width, percent, hot), block)
    # texts stay where they are while the list of classes is small
    busy = materialize(cells.select("cls").distinct(), "busy-classes")
    sets = texts.join(sized(busy), texts["key"] == F.col("cls")).select("cls", "text").mapInArrow(_sets(width), "cls long, tokens array<long>")
    met = sets.join(sized(cells), "cls").select("lo", "hi", "block", "cls", "copies", "tokens")
    met = met.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "cls")
    links = materialize(met.mapInArrow(_cells(percent), "cls long, links long, root long"), "links")
    by_class = links.groupBy("cls").agg(F.sum("links").alias("links"))
    comps = connected_components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    result = classes.select("k1", "k2", "n", "cls", "copies").join(by_class, "cls", "left").join(comps.withColumnRenamed("node", "cls"), "cls", "left")
    result = materialize(result.select("k1", "k2", F.col("n").alias("_n"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), F.coalesce("component", "cls").alias("component")), "class-results")
    out = docs.select("key", "n", "k1", "k2").join(result, ["k1", "k2"], "left")
    known = lambda c: F.when(c < NO_ID, c)
    return out.select(
        known(F.col("key")).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("n_similar", F.lit(0))).otherwise(0).cast("long").alias("n_similar"),
        known(F.when(F.col("n") > 0, F.coalesce("component", "key")).otherwise(F.col("key"))).alias("component_id"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all columns, whose id is the least of its component. Ids must be unique."""
    drop = jaccard_join(df, id_col, text_col).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_drop"))
    drop = materialize(drop, "dropped")
    return df.join(sized(drop), df[id_col] == F.col("_drop"), "left_anti")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op7_jaccard": op7_jaccard}
_ORACLE = """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i + 1:i + 5], ' ') END AS g
          FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
    r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    m AS (SELECT a, min(b) AS m FROM r GROUP BY 1), k AS (SELECT a, count(*) AS k FROM l GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.k, 0)::BIGINT AS n_similar, m.m AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.a = d.doc_id LEFT JOIN m ON m.a = d.doc_id"""
ORACLES = {"op7_jaccard": _ORACLE}
