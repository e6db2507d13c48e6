"""The driver's tables seen as archives: units with paths, directory order and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.common import table, with_row_numbers
from quirefold.operators.units import unit_flags

_URL = r"^[A-Za-z]+://([^/?#]*)([^?#]*)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, title, text) of pages; text is the markup."""
    p = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("/"), F.regexp_extract("url", _URL, 1), F.regexp_extract("url", _URL, 2))
    title = F.nullif(F.regexp_extract("html", r"<title>([^<]*)", 1), F.lit(""))
    return p.select(F.col("page_id").alias("doc_id"), path.alias("path"), title.alias("title"), F.col("html").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, title, text) of documents."""
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("-")), F.lit("/"), F.coalesce("lang", F.lit("-")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.lit(None).cast("string").alias("title"), "text")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, title, text) of the turns of conversations."""
    path = F.concat(F.lit("/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("-"), F.coalesce("role", F.lit("")), F.lit(".txt"))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), path.alias("path"), F.lit(None).cast("string").alias("title"), "text")


def units(docs: DataFrame, name: str = "units", under: str = "") -> DataFrame:
    """(ord, doc_id, path, path_key, length, flags) in directory order, which is that of lower-cased paths.

    With `under` only the paths that begin with it, whatever the case: they lie side by side in the order, so that they alone are sorted and
    the others before them are counted.
    """
    rows = docs.select("doc_id", "path", F.lower("path").alias("path_key"), F.octet_length("text").cast("long").alias("length"), unit_flags(F.col("path")).alias("flags"))
    if not under:
        return with_row_numbers(rows, name, F.col("path_key"), F.col("doc_id"), column="ord")
    key = under.lower()
    before = rows.filter((F.col("path_key") < key) | F.col("path_key").isNull()).count()
    inside = with_row_numbers(rows.filter(F.col("path_key").startswith(key)), name, F.col("path_key"), F.col("doc_id"), column="ord")
    return inside.withColumn("ord", F.col("ord") + before)
