"""Inverted index: tokens, postings with positions, dictionary; stored as Parquet sorted by word."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import lexer

#: A word in more than HIGH_DOCS documents and HIGH_PERCENT of them is of high frequency.
HIGH_DOCS, HIGH_PERCENT = 1000, 95


def tokens(docs: DataFrame, text: str = "text", stop_words: Iterable[str] = (), max_word: int | None = lexer.MAX_WORD, words: Column | None = None) -> DataFrame:
    """(doc_id, pos, word) of docs (doc_id, text). Longer words than max_word hold a position but are left out."""
    w = lexer.words(F.col(text), stop_words) if words is None else words
    out = docs.select("doc_id", F.posexplode(w).alias("pos", "word"))
    return out if max_word is None else out.filter(F.length("word") <= max_word)


def postings(tok: DataFrame) -> DataFrame:
    """(word, doc_id, tf, positions)."""
    by = tok.groupBy("word", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return by.select("word", "doc_id", F.size("positions").alias("tf"), "positions")


def dictionary(post: DataFrame) -> DataFrame:
    return post.groupBy("word").agg(F.count("*").alias("doc_count"))


def high_frequency(dic: DataFrame, n_docs: int, least: int = HIGH_DOCS, percent: int = HIGH_PERCENT) -> DataFrame:
    return dic.filter((F.col("doc_count") > least) & (F.col("doc_count") * 100 >= percent * n_docs))


def write_index(post: DataFrame, path: str, docs: DataFrame | None = None) -> None:
    """Postings by ranges of words, sorted, so that a lookup reads few row groups; the table of documents beside them."""
    post.repartitionByRange("word").sortWithinPartitions("word", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    if docs is not None:
        docs.write.mode("overwrite").parquet(f"{path}/docs")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether an index has been written there to the end: its writer marks that last."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/docs/_SUCCESS")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/postings")


def explode_postings(post: DataFrame) -> DataFrame:
    """(doc_id, pos, word) again."""
    return post.select("doc_id", F.explode("positions").alias("pos"), "word")
