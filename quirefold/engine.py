"""One object for a set of documents, and one for help archives: the library's front door."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.common import materialize
from quirefold.functions.lexer import MAX_WORD
from quirefold.operators import index, regex_search, search, sinks, trees
from quirefold.operators import units as unit_ops
from quirefold.sources.datasource import read_chm


class Corpus:
    """Documents (doc_id, path, title, text) with search; an index that was written before is used where it is given."""

    def __init__(self, docs: DataFrame, stop_words: Iterable[str] = (), postings: DataFrame | None = None):
        self.docs, self.stop, self.post = docs, tuple(stop_words), postings

    def build_index(self, path: str, reuse: bool = False) -> Corpus:
        """Writes the index to path, or with reuse takes the one that has been finished there."""
        spark = self.docs.sparkSession
        if not (reuse and index.is_complete(spark, path)):
            post = index.postings(index.tokens(self.docs, stop_words=self.stop))
            index.write_index(post, path, self.docs.select("doc_id", "path", "title"))
        self.post = index.read_index(spark, path)
        return self

    def postings_of(self, queries: list[tuple[int, str]], whole_words: bool) -> DataFrame:
        """Postings of the words of the queries, or of what begins with them: a filter that reaches the scan."""
        groups = [g for _, q in queries for g in search.split_query(q, self.stop)]
        starts = [] if whole_words else sorted({g[0] for g in groups if len(g) == 1})
        words = sorted({w for g in groups for w in g if whole_words or len(g) > 1})
        tests = ([F.col("word").isin(words)] if words else []) + [F.col("word").startswith(p) for p in starts]
        return self.post.filter(reduce(lambda a, b: a | b, tests)) if tests else self.post.limit(0)

    def search(self, query: str, regex: bool = False, whole_words: bool = True, titles_only: bool = False, limit: int = 0) -> DataFrame:
        """Ranked results (doc_id, score, url, topic, rank), or with regex the matching documents."""
        if regex:
            patterns = regex_search.split_regex_query(query)
            found = self.docs.filter(regex_search.any_pattern(F.col("text"), patterns)).withColumn("topic", F.coalesce("title", "path"))
            return found.orderBy(F.lower("path"), "doc_id").limit(limit) if limit > 0 else found
        return self.search_many([(0, query)], whole_words, titles_only, limit).drop("query_id")

    def search_found(self, queries: list[tuple[int, str]], whole_words: bool = True, titles_only: bool = False) -> DataFrame:
        """(query_id, doc_id, score)."""
        if titles_only or self.post is None:
            return search.match_texts(self.docs, queries, "title" if titles_only else "text", self.stop, not whole_words)
        terms = search.query_terms(self.docs.sparkSession, queries, self.stop, prefix=not whole_words)
        return search.match_index(self.postings_of(queries, whole_words), terms)

    def search_many(self, queries: list[tuple[int, str]], whole_words: bool = True, titles_only: bool = False, limit: int = 0) -> DataFrame:
        found = search.rank(self.search_found(queries, whole_words, titles_only), limit)
        return search.with_titles(found, self.docs).select("query_id", "doc_id", "score", F.col("path").alias("url"), "topic", "rank")


class Archives:
    """Help archives at a path (file, folder or pattern)."""

    def __init__(self, spark: SparkSession, path: str, only: str = ""):
        self.spark, self.path, self.only = spark, path, only

    def without_index(self) -> Archives:
        """Those that have no word index of their own; the others are left as soon as their directory is read."""
        return Archives(self.spark, self.path, "without_index")

    def _table(self, what: str) -> DataFrame:
        return read_chm(self.spark, self.path, what, self.only)

    def info(self) -> DataFrame:
        return self._table("archives")

    def info_json(self) -> DataFrame:
        return sinks.info_json(self.info())

    def entries(self) -> DataFrame:
        return self._table("units")

    def units(self) -> DataFrame:
        return unit_ops.directory_map(self.entries())

    def objects(self) -> DataFrame:
        return self._table("objects")

    def topics(self) -> DataFrame:
        return self._table("topics")

    def titles(self) -> DataFrame:
        return trees.titles(self.topics())

    def resolve(self, path: str) -> DataFrame:
        return unit_ops.resolve(self.units(), path)

    def read(self, path: str) -> DataFrame:
        return self.objects().filter(F.col("path_key") == path.lower())

    def enumerate(self, what: int = unit_ops.ALL) -> DataFrame:
        return self.units().filter(unit_ops.matches(F.col("flags"), what)).orderBy("archive_id", "ord")

    def documents(self) -> DataFrame:
        """Text files as a corpus; documents are numbered in directory order within an archive."""
        return self._user_objects().filter("doc_id IS NOT NULL")

    def _user_objects(self) -> DataFrame:
        """All USER objects as documents; those that aren't text files have no doc_id."""
        from pyspark.sql.window import Window

        user = self.objects().filter(unit_ops.matches(F.col("flags"), unit_ops.USER) & F.col("text").isNotNull())
        is_text = F.lower("path").rlike(r"\.(txt|html?|xml|xhtml)$")
        number = F.when(is_text, F.sum(is_text.cast("long")).over(Window.partitionBy("archive_id").orderBy("ord")) - 1)
        t = self.titles().withColumnRenamed("archive_id", "_a").withColumnRenamed("path_key", "_k")
        d = user.withColumn("doc_id", number).join(t, (F.col("archive_id") == F.col("_a")) & (F.col("path_key") == F.col("_k")), "left")
        return d.select("archive_id", F.col("doc_id").cast("long").alias("doc_id"), "path", "title", "text")

    def search_index(self, query: str, whole_words: bool = False, titles_only: bool = False, limit: int = 0) -> DataFrame:
        """Search in the archives' own word index: words match by their beginnings unless whole_words or in a phrase."""
        return self._numbered(self._match_own(query, whole_words, titles_only), limit)

    def _match_own(self, query: str, whole_words: bool, titles_only: bool) -> DataFrame:
        """(archive_id, url, topic, score). The words of the query are pushed to the reader, which goes down each index to them."""
        groups = search.split_query(query, word_chars="")
        test = [F.col("word") == w if whole_words or len(g) > 1 else F.col("word").startswith(w) for g in groups for w in dict.fromkeys(g)]
        # a table per word, as each filter is taken by its reader, and one reader takes but one
        parts = [self._table("fts").filter(t) for t in test]
        fts = reduce(lambda a, b: a.unionByName(b), parts).dropDuplicates(["archive_id", "word", "context", "doc_id"]) if parts else self._table("fts").limit(0)
        fts = materialize(fts, "found")  # they are gone through several times below, and reading them opens all archives
        fts = fts.filter("context = 1") if titles_only else fts
        terms = search.query_terms(self.spark, [(0, query)], word_chars="", prefix=not whole_words)
        key = F.struct("archive_id", "url")
        # positions of body and title are kept apart, as both count from 0
        places = F.transform("positions", lambda p: p.cast("long") + F.col("context").cast("long") * (1 << 32))
        found = search.match_index(fts.select("word", key.alias("doc_id"), places.alias("positions")), terms)
        names = fts.groupBy(key.alias("doc_id")).agg(F.max("title").alias("topic"))
        return found.join(names, "doc_id").select("doc_id.archive_id", "doc_id.url", "topic", "score")

    def _numbered(self, found: DataFrame, limit: int) -> DataFrame:
        ranked = search.rank(found.select(F.lit(0).cast("long").alias("query_id"), F.struct("archive_id", "url", "topic").alias("doc_id"), "score"), limit)
        return ranked.select("doc_id.archive_id", "doc_id.url", "doc_id.topic", "score", "rank")

    def corpus(self, docs: DataFrame | None = None) -> Corpus:
        """The text files of all archives; a document's id is its archive with its number there."""
        docs = self.documents() if docs is None else docs
        return Corpus(docs.withColumn("doc_id", F.struct("archive_id", "doc_id")))

    def search(self, query: str, regex: bool = False, whole_words: bool = False, titles_only: bool = False, limit: int = 300) -> DataFrame:
        """(archive_id, url, topic, score, rank): in the own index of the archives that have one, over the texts of the others. By regular expressions, if asked for, the matching ones of all USER objects."""
        if regex:
            return Corpus(self._user_objects()).search(query, regex=True, limit=limit)
        texts = self.without_index().corpus()
        found = texts.search_found([(0, query)], whole_words, titles_only)
        found = search.with_titles(found, texts.docs).select("doc_id.archive_id", F.col("path").alias("url"), "topic", "score")
        return self._numbered(self._match_own(query, whole_words, titles_only).unionByName(found), limit)

    def extract(self, target: str) -> DataFrame:
        return sinks.extract(self.objects(), target)


__all__ = ["MAX_WORD", "Archives", "Corpus"]
