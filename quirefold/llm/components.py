"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.common import materialize

#: Rows of ids that may be broadcast, a few dozen MB; more are joined by shuffle.
BROADCAST_IDS = 500_000


def sized(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A table of narrow rows, marked for broadcast if it has been counted and is small; else as it is, for a join by shuffle."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of edges (a, b) reaches.

    Each step joins edges with the least neighbour of their ends, so no neighbourhood is gathered; a node with
    very many edges is a hot join key, which adaptive execution splits. Ends when a round changes nothing.
    """
    e = edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a <> b").distinct()
    e, before = materialize(e, "edges"), None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        e = materialize(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())
