"""Command line: python -m quirefold {info,list,dir,find,extract,search,regex,topics} ARCHIVES [ARGUMENT]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quirefold.engine import Archives
from quirefold.operators import trees
from quirefold.operators.units import ALL, enumerate_dir, type_label


def lines(spark: SparkSession, command: str, path: str, argument: str | None) -> list[str]:
    """What a command prints."""
    a = Archives(spark, path)
    if command == "info":
        return [r.json for r in a.info_json().collect()]
    if command in ("list", "dir"):
        u = a.enumerate(ALL) if command == "list" else enumerate_dir(a.units(), argument or "/", ALL)
        return [f"{r.length}\t{r.kind}\t{r.path}" for r in u.select("length", type_label(F.col("flags")).alias("kind"), "path").collect()]
    if command == "find":
        return [f"{r.path}\t{r.length}" for r in a.resolve(argument or "/").collect()]
    if command == "extract":
        done = a.extract(argument or ".").agg(F.count("*"), F.sum("bytes")).first()
        return [f"{done[0]} objects, {done[1] or 0} bytes"]
    if command == "topics":
        t = a.topics().orderBy("archive_id", "id")
        return [r.line for r in t.select(trees.indented(F.col("level"), F.col("title"), F.col("path")).alias("line")).collect()]
    found = a.search(argument or "", regex=command == "regex")
    url = "url" if "url" in found.columns else "path"
    return [f"{r[url]}\t{r['topic']}" for r in found.collect()]


def main() -> None:
    p = argparse.ArgumentParser(prog="quirefold")
    p.add_argument("command", choices=("info", "list", "dir", "find", "extract", "search", "regex", "topics"))
    p.add_argument("path")
    p.add_argument("argument", nargs="?")
    args = p.parse_args()
    spark = SparkSession.builder.appName("quirefold").config("spark.ui.enabled", "false").getOrCreate()
    for line in lines(spark, args.command, args.path, args.argument):
        print(line)
    spark.stop()


if __name__ == "__main__":
    main()
