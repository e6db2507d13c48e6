"""Session helpers: shipping the package to workers, reading tables, cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SHIPPED = "_quirefold_shipped"
#: Bytes of an Arrow batch between the JVM and Python, where the session doesn't set it: whole texts are long.
_BATCH_KEY, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
_LOCAL_DIR: str | None = None
#: Without its native library Hadoop starts a program, chmod, for each file and folder that it makes in a local folder. So tables get no
#: marker and no checksum files; Parquet's own checksums of pages are verified instead.
_WRITE = {
    "compression": "zstd", "parquet.page.write-checksum.enabled": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true",
}
_READ = {"parquet.page.verify-checksum.enabled": "true"}


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once per Spark context), and keep Arrow batches small."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, _BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="quirefold-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    setattr(sc, _SHIPPED, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    global _LOCAL_DIR
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="quirefold-shared-")
        atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
    return f"file://{_LOCAL_DIR}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quirefold/{uuid.uuid4().hex}-{name}"
    full = path if ":" in path.partition("/")[0] else (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///").rstrip("/") + path
    if full.startswith("file:/"):  # the folders that the committer would make
        os.makedirs(f"/{full[5:].lstrip('/')}/_temporary/0/_temporary")
    df.write.mode("append").options(**_WRITE).parquet(path)
    return spark.read.schema(df.schema).options(**_READ).parquet(path)


def with_row_numbers(df: DataFrame, name: str, *order: Column, column: str = "g") -> DataFrame:
    """df written in a total order, with global row numbers from 0: a range sort, then the sizes of its partitions. No task sees more than its own range."""
    parts = df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    parts = materialize(parts, name)
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the sort
    starts = parts.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_s"))
    return parts.join(F.broadcast(starts), "_p").select(*df.columns, (F.col("_s") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias(column))
