"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

from quirefold import registry  # noqa: E402
from quirefold.engine import Corpus  # noqa: E402
from quirefold.plans import virtual  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ("token_counts_docs", "dictionary_df", "index_postings", "search_ranked", "search_and", "search_phrase", "search_batch", "search_benchmark_phrases", "regex_or", "enumerate_dir", "files_tree", "highlight")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        run()  # once for compiling
        began = time.time()
        run()
        seconds[name] = round(time.time() - began, 3)

    for name in QUERIES:
        timed(name, lambda n=name: registry.QUERIES[n](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    folder = tempfile.mkdtemp(prefix="bench-index-")
    try:
        corpus = Corpus(virtual.documents(spark, SF_DIR))
        timed("build_index", lambda: corpus.build_index(folder))
        for name, q in (("indexed_single", "letionai"), ("indexed_and", "anea eriner"), ("indexed_phrase", '"anea eriner"')):
            timed(name, lambda q=q: corpus.search(q, limit=300).collect())
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
