"""Results as JSON, text and files."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.common import ship
from quirefold.operators.units import type_label


NO_RESULTS = '{"ok":false}'


def search_json(ranked: DataFrame, query_ids: Iterable[int] = ()) -> DataFrame:
    """(query_id, json): {"ok": true, "results": [[url, topic], ...]} in order of rank, or NO_RESULTS for those of query_ids that found nothing. ranked: a page of results of each query."""
    pair = F.array("path", "topic")
    rows = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", pair.alias("r")))).alias("rows"))
    found = rows.select("query_id", F.to_json(F.struct(F.lit(True).alias("ok"), F.transform("rows", lambda x: x["r"]).alias("results"))).alias("json"))
    asked = sorted(set(query_ids))
    if not asked:
        return found
    ids = ranked.sparkSession.createDataFrame([(q,) for q in asked], "query_id long")
    return ids.join(found, "query_id", "left").select("query_id", F.coalesce("json", F.lit(NO_RESULTS)).alias("json"))


def info_json(archives: DataFrame, build_step: int | None = None) -> DataFrame:
    fields = [F.col("title"), F.col("encoding"), F.col("home_file").alias("homeFile"), F.col("has_index").alias("hasIndex")]
    if build_step is not None:
        fields.append(F.lit(build_step).alias("buildIndexStep"))
    return archives.select("archive_id", F.to_json(F.struct(*fields, F.lit(True).alias("ok"))).alias("json"))


def listing_lines(units: DataFrame) -> DataFrame:
    """Space, start, length, kind and path of each unit as a line."""
    line = F.concat_ws("\t", F.col("space").cast("string"), F.col("start").cast("string"), F.col("length").cast("string"), type_label(F.col("flags")), F.col("path"))
    return units.select("ord", line.alias("line"))


def extract(objects: DataFrame, target: str) -> DataFrame:
    """Writes objects (path, content) below the folder target, which executors share; (path, bytes, written) of each.

    Paths that don't begin with a slash are left out; a path that would leave the folder is an error in its row.
    """
    ship(objects.sparkSession)
    base = os.path.abspath(target)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                full = os.path.normpath(base + path)
                if full != base and not full.startswith(base + os.sep):
                    rows.append((path, 0, False))
                    continue
                if path.endswith("/"):
                    os.makedirs(full, exist_ok=True)
                else:
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    with open(full, "wb") as f:
                        f.write(content or b"")
                rows.append((path, len(content or b""), True))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_())], ["path", "bytes", "written"])

    return objects.filter(F.col("path").startswith("/")).select("path", "content").mapInArrow(run, "path string, bytes long, written boolean")
