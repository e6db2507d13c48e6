"""Ranked search: AND of phrases, prefixes, titles, many queries in one job.

A query is split into groups of words that must stand side by side. For each document and group, a match is a
position from which all words of the group follow; every group needs one, and the score is the number of matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions import lexer
from quirefold.common import materialize, with_row_numbers
from quirefold.functions.lexer import MAX_WORD, WORD_CHARS
from quirefold.operators import index

_TERM = pa.schema([("query_id", pa.int64()), ("group_id", pa.int32()), ("offset", pa.int32()), ("group_len", pa.int32()), ("n_groups", pa.int32()), ("word", pa.string()), ("prefix", pa.bool_())])


def split_query(query: str, stop_words: Iterable[str] = (), word_chars: str = WORD_CHARS) -> list[list[str]]:
    """Groups of words. Quotes and any sign but a space outside quotes join words into a phrase; letters beyond ASCII are words each."""
    stop, groups = set(stop_words), []
    in_phrase = in_quote = False

    def emit(word: str) -> None:
        if word in stop:
            return
        if in_phrase and groups:
            groups[-1].append(word)
        else:
            groups.append([word])

    for m in re.finditer(rf"([A-Za-z0-9{re.escape(word_chars)}]+)|(.)", query, re.S):
        if m[1]:
            emit(m[1].lower())
            in_phrase = True
            continue
        c = m[2]
        if c == '"':
            in_quote = not in_quote
        elif c == " " and not in_quote:
            in_phrase = False
        elif c >= "\x80" and c <= "￿" and (c.isalpha() or c.isdecimal()):
            emit(c)
            in_phrase = True
    return groups


def query_terms(spark: SparkSession, queries: Iterable[tuple[int, str]], stop_words: Iterable[str] = (), word_chars: str = WORD_CHARS, prefix: bool = False) -> DataFrame:
    """Rows of terms. With prefix, words outside phrases stand for all words that they begin."""
    rows = []
    for q, text in queries:
        groups = split_query(text, stop_words, word_chars)
        for g, words in enumerate(groups):
            for i, w in enumerate(words):
                rows.append((q, g, i, len(words), len(groups), w, prefix and len(words) == 1))
    # an Arrow table becomes a local relation, whose size the planner knows
    columns = zip(*rows) if rows else [()] * len(_TERM)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, _TERM)], schema=_TERM))


def match(tok: DataFrame, terms: DataFrame, prefixes: bool = True) -> DataFrame:
    """(query_id, doc_id, score): tok (doc_id, pos, word) against terms. prefixes: whether any term may be one."""
    hits = tok.join(terms.filter("not prefix"), "word")
    if prefixes:
        p = terms.filter("prefix").withColumnRenamed("word", "start")
        # equi-join on the first character, so that it isn't a cross join
        pre = tok.join(p, (F.substring("word", 1, 1) == F.substring("start", 1, 1)) & F.col("word").startswith(F.col("start")))
        hits = hits.unionByName(pre.drop("start"))
    return _scores(hits)


def _scores(hits: DataFrame) -> DataFrame:
    at = hits.groupBy("query_id", "doc_id", "group_id", "group_len", "n_groups", (F.col("pos") - F.col("offset")).alias("at")).agg(F.count_distinct("offset").alias("k"))
    groups = at.filter("k = group_len").groupBy("query_id", "doc_id", "group_id", "n_groups").agg(F.count("*").alias("m"))
    docs = groups.groupBy("query_id", "doc_id", "n_groups").agg(F.count("*").alias("g"), F.sum("m").alias("score"))
    return docs.filter("g = n_groups").select("query_id", "doc_id", "score")


#: Groups of words of a batch up to which each text is searched as it is read; more are joined to tokens.
MAX_GROUPS = 64
#: Passages whose first looked-for words are a filter on texts as they are read; more are joined to tokens.
MAX_PASSAGES = 10_000


def _places(w: Column, words: Iterable[str], starts: Iterable[str] = ()) -> Column:
    """(x, i) of the words in w that are any of `words` or begin with any of `starts`."""
    words, starts = sorted(set(words)), sorted(set(starts))

    def wanted(x: Column) -> Column:
        tests = ([x.isin(words)] if words else []) + [x.startswith(p) & (F.length(x) <= MAX_WORD) for p in starts]
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

    return F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: wanted(h["x"]))


def match_texts(docs: DataFrame, queries: Iterable[tuple[int, str]], text: str = "text", stop_words: Iterable[str] = (), prefix: bool = False) -> DataFrame:
    """(query_id, doc_id, score) of docs (doc_id, text), with no shuffle: each text's words are looked through once for all words of the queries, and phrases are held against their neighbours."""
    parsed = [(q, [tuple(g) for g in split_query(t, stop_words)]) for q, t in queries]
    parsed = [(q, gs) for q, gs in parsed if gs and all(len(w) <= MAX_WORD for g in gs for w in g)]
    groups = list(dict.fromkeys(g for _, gs in parsed for g in gs))
    if not groups:
        return docs.limit(0).select(F.lit(0).cast("long").alias("query_id"), "doc_id", F.lit(0).cast("long").alias("score"))
    if len(groups) > MAX_GROUPS:
        return match(index.tokens(docs, text, stop_words), query_terms(docs.sparkSession, queries, stop_words, prefix=prefix), prefix)
    starts = [g[0] for g in groups if prefix and len(g) == 1]
    firsts = [g[0] for g in groups if not (prefix and len(g) == 1)]

    def count(g: tuple[str, ...]) -> Column:
        def here(h: Column) -> Column:
            first = h["x"].startswith(g[0]) if prefix and len(g) == 1 else h["x"] == g[0]
            return reduce(lambda a, b: a & b, [first, *(F.get("w", h["i"] + k) == F.lit(word) for k, word in enumerate(g[1:], 1))])

        return F.size(F.filter("at", here))

    # no filter on the places: it would be pushed below the words, which were then made twice; texts without any have no scores
    found = docs.select("doc_id", lexer.words(F.col(text), stop_words).alias("w")).select("doc_id", "w", _places(F.col("w"), firsts, starts).alias("at"))
    found = found.select("doc_id", F.array(*map(count, groups)).alias("n"))
    number = {g: i for i, g in enumerate(groups)}

    def score(gs: list[tuple[str, ...]]) -> Column:
        each = [F.get("n", number[g]) for g in gs]
        return F.when(reduce(lambda a, b: a & b, (c > 0 for c in each)), reduce(lambda a, b: a + b, each).cast("long"))

    scores = F.array(*(F.struct(F.lit(q).cast("long").alias("query_id"), score(gs).alias("score")) for q, gs in parsed))
    return found.select("doc_id", F.explode(F.filter(scores, lambda x: x["score"].isNotNull())).alias("s")).select("s.query_id", "doc_id", "s.score")


def match_index(post: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) from postings (word, doc_id, positions). The documents of each query's rarest term are found first; only their postings of the other terms are opened."""
    exact = post.join(terms.filter("not prefix"), "word")
    p = terms.filter("prefix").withColumnRenamed("word", "start")
    starts = post.join(p, (F.substring("word", 1, 1) == F.substring("start", 1, 1)) & F.col("word").startswith(F.col("start"))).drop("start")
    hits = exact.unionByName(starts)
    term = ["query_id", "group_id", "offset"]
    counts = hits.groupBy(*term).agg(F.count("*").alias("n"))
    # a query of which a term is nowhere has no results
    rarest = counts.groupBy("query_id").agg(F.min_by(F.struct("group_id", "offset"), F.struct("n", "group_id", "offset")).alias("r"), F.count("*").alias("k"))
    rarest = rarest.join(terms.groupBy("query_id").agg(F.count("*").alias("k")), ["query_id", "k"]).select("query_id", "r.group_id", "r.offset")
    docs = hits.join(F.broadcast(rarest), term).select("query_id", "doc_id").distinct()  # a row per query is broadcast
    tok = hits.join(docs, ["query_id", "doc_id"], "left_semi").select(*term, "doc_id", "group_len", "n_groups", F.explode("positions").alias("pos"))
    return _scores(tok)


def match_passages(docs: DataFrame, passages: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, doc_id, score): whole passages (query_id, words) as phrases, of any length and with words of any length.

    A passage is looked for where the longest of its words stands (the first of equals) and compared there as a whole.
    """
    longest = F.array_sort(F.transform("words", lambda x, i: F.struct((-F.length(x)).alias("l"), i.alias("i"), x.alias("x"))))
    anchors = passages.filter(F.size("words") > 0).select("query_id", "words", F.get(longest, 0).alias("a")).select("query_id", "words", F.col("a.x").alias("word"), F.col("a.i").alias("offset"))
    own = docs.select("doc_id", lexer.words(F.col(text)).alias("own"))
    if anchors.limit(MAX_PASSAGES + 1).count() <= MAX_PASSAGES:
        looked_for = [r[0] for r in anchors.select("word").distinct().collect()]
        at = own.select("doc_id", "own", F.explode(_places(F.col("own"), looked_for)).alias("h")).select("doc_id", "own", F.col("h.x").alias("word"), F.col("h.i").alias("pos"))
        hits = at.join(F.broadcast(anchors), "word")
    else:
        at = index.tokens(docs, text, max_word=None).join(anchors, "word").filter(F.col("pos") >= F.col("offset"))
        hits = at.join(own.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    start = F.col("pos") - F.col("offset")
    hits = hits.filter(start >= 0).filter(F.slice("own", F.greatest(start, F.lit(0)) + 1, F.size("words")) == F.col("words"))
    return hits.select("query_id", "doc_id", start.alias("at")).distinct().groupBy("query_id", "doc_id").agg(F.count("*").alias("score"))


def rank(found: DataFrame, limit: int = 0) -> DataFrame:
    """With rank by score, then doc_id; the first `limit` of each query if it is above 0. Without a limit, no task holds all results of a query."""
    if limit > 0:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    found = materialize(found, "found")  # the range sort goes through its input twice, the first time for a sample
    rows = with_row_numbers(found, "ranked", F.col("query_id"), F.desc("score"), F.col("doc_id"), column="_g")
    first = rows.groupBy("query_id").agg(F.min("_g").alias("_first"))
    return rows.join(first, "query_id").select(*found.columns, (F.col("_g") - F.col("_first") + 1).cast("int").alias("rank"))


def top(found: DataFrame, limit: int = 0) -> DataFrame:
    """rank() for a single query: a sort with a limit instead of a window."""
    out = found.orderBy(F.desc("score"), "doc_id")
    return out.limit(limit) if limit > 0 else out


def with_titles(found: DataFrame, docs: DataFrame) -> DataFrame:
    """docs (doc_id, path, title): url and topic, which is the path where there is no title."""
    return found.join(docs.select("doc_id", "path", "title"), "doc_id", "left").withColumn("topic", F.coalesce("title", "path"))
