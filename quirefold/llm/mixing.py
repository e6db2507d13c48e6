"""Mixing sources to target weights by systematic sampling.

A document of n words (its size) of source s is expected in target(s) / size(s) copies, at most `most`. Within
each source the documents are put in order of size; their expected copies are summed from the front, one offset
per source is added, and a document is emitted once per integer boundary that its part of the sum crosses.
Because the order is by size, the words taken from a source miss its target by less than its longest document.

Targets: sources in code-point order, null last, weigh WEIGHTS in turn and share `share` of all sizes by
weight; a target stops at `most` times its source's size and the excess goes to the others by weight, again until none
is above. That level is found by whole-table aggregates, one row each.

Nothing is gathered by source: one range sort by (source, size, id) gives global row numbers from partition
sizes, and a row's rank in its source is its number less that of the source's first row; so a source with a
third of all rows is spread over tasks like any other. Only ids, sizes and hashes of rows are sorted, no text.

Nulls: a null text has size 0; a null source is a source, last in order; a null id comes first in order. Ties
and repeated rows: each row counts, in any order among equals. Documents of size 0 take 0 words; a source of
size 0 has target 0. Empty table: no rows. The offset is fixed by the source's name, so reruns agree. Further
columns are ignored by mix_sources and kept by take_mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.common import materialize, table, with_row_numbers
from quirefold.llm.components import sized

WEIGHTS, SHARE_NUM, SHARE_DEN, MOST = (3, 1, 2), 3, 2, 2
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, share: tuple[int, int] = (SHARE_NUM, SHARE_DEN), weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target) from rows of (source, size), one per source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by = with_row_numbers(by, "sources", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("g") % len(weights) + 1).cast("int"))
    by = materialize(by.withColumn("w", w), "weights")
    total = by.agg(F.sum("source_size")).first()[0] or 0
    wanted, level = total * share[0], 0.0
    cap = F.col("source_size") * most
    while True:  # each round caps more sources or ends; the level is per weight
        above = F.lit(level) * F.col("w") >= cap
        capped, free = by.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0))).first()
        if not free:
            break
        new = (wanted - share[1] * capped) / (share[1] * free)
        if new <= level:
            break
        level = new
    target = F.least(cap.cast("double"), F.lit(level) * F.col("w"))
    return by.select("source", "source_size", "n", "g", target.alias("target"))


def _offset() -> Column:
    """In (0, 1), by the source's name."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("source"), F.lit("\x00null"))), 1, 8), 16, 10).cast("double")
    return (h + 0.5) / F.lit(4294967296.0)


def _copies(sizes: DataFrame) -> DataFrame:
    """sizes (id, source, size and more) with source_size, target and copies."""
    rows = with_row_numbers(sizes, "sizes", F.col("source").asc_nulls_last(), F.col("size"), F.col("id"))
    sources = materialize(source_targets(rows), "targets")
    first = rows.groupBy("source").agg(F.min("g").alias("first"))
    sources = sources.join(first, sources["source"].eqNullSafe(first["source"])).select(sources["source"].alias("s"), "source_size", "target", "first")
    joined = rows.join(sources, rows["source"].eqNullSafe(sources["s"]))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("g") - F.col("first")
    copies = F.least(F.floor(_offset() + (rank + 1) * each) - F.floor(_offset() + rank * each), F.lit(MOST)).cast("long")
    return joined.withColumn("copies", copies)


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of df: id, size, source_size, target, copies, taken."""
    sizes = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), _size(text_col).alias("size"))
    # written first, so that the sort's sample doesn't count words again
    return _copies(materialize(sizes, "text-sizes")).select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of df, each as often as the mix takes it.

    Only ids, sizes and hashes of rows are sorted; copies come back to the rows by id and hash, so that ids may repeat or be null, and texts
    stay where they are while that list is small. Equal rows are one there, with the copies of all.
    """
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), F.col(id_col).alias("id")).withColumn("key", F.xxhash64("row"))
    sizes = rows.select("id", "key", F.col(f"row.{source_col}").cast("string").alias("source"), _size(f"row.{text_col}").alias("size"))
    taken = _copies(materialize(sizes, "row-sizes")).groupBy("id", "key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    taken = materialize(taken.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "copies", "rows"), "row-copies")
    chosen = rows.join(sized(taken), F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    again = chosen.filter("rows > 1")
    if not taken.filter("rows > 1").isEmpty():
        chosen = chosen.filter("rows = 1").unionByName(again.dropDuplicates(["_id", "_key"]))
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


_ORACLE = """
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
    w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
    r AS (SELECT *, sum(2 * source_size) OVER o AS c0, sum(w) OVER o AS w0, sum(2 * source_size) OVER () AS call, sum(w) OVER () AS wall FROM w WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
    levels AS (SELECT 0 AS c, (SELECT sum(w) FROM w) AS f, -1.0 AS lo UNION ALL SELECT c0, wall - w0, 2.0 * source_size / w FROM r WHERE wall > w0),
    total AS (SELECT sum(source_size) AS t FROM s),
    level AS (SELECT max((3 * t - 2 * c)::DOUBLE / (2 * f)::DOUBLE) AS v FROM levels, total WHERE (3 * t - 2 * c)::DOUBLE / (2 * f)::DOUBLE >= lo - 1e-9),
    t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, v * w) AS target FROM w, level),
    k AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
                 (('0x' || substr(md5(coalesce(d.source, chr(0) || 'null')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0 AS u,
                 row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS i
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    c AS (SELECT *, least((floor(u + (i + 1) * e) - floor(u + i * e))::BIGINT, 2) AS copies FROM k)
    SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c"""

QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {"op5_mixing": _ORACLE}
