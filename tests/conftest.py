import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def compare(spark, sf_dir, queries, oracles, names):
    """Each query's rows and its SQL's, as sorted lists of strings."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark", "part"):
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    for name in names:
        got = queries[name](spark, sf_dir)
        columns = sorted(got.columns)
        mine = sorted(tuple(map(str, r)) for r in got.select(*columns).collect())
        rel = con.sql(oracles[name])
        assert sorted(rel.columns) == columns, name
        theirs = sorted(tuple(map(str, r)) for r in rel.select(*(f'"{c}"' for c in columns)).fetchall())
        assert mine == theirs, name
