"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on the whole of docs; run() writes each result as Parquet into
the shared folder and reads it back as the next stage's docs. All stages but the last return the columns of
documents. Ids are unique up to the mix, which repeats rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirefold.common import materialize, table
from quirefold.llm.bpe import with_tokens
from quirefold.llm.jaccard import keep_one
from quirefold.llm.mixing import take_mix
from quirefold.llm.quality import keep_quality
from quirefold.llm.sufdedup import drop_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere; a document of nothing else goes."""
    return drop_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, which have been decoded and held against the text."""
    return with_tokens(docs, keep_text=False)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mixing), ("tokens", tokens)]

#: Repeated passages and BPE can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
