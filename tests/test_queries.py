import importlib

import pytest

from quirefold import registry
from tests.conftest import compare


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, sf, name):
    compare(spark, sf, registry.QUERIES, registry.ORACLES, [name])


def test_benchmark_passages_brute_force(spark, tmp_path):
    """Whole passages count: not their first words, nor only those of short words; places may overlap."""
    from pyspark.sql import functions as F

    from quirefold.functions import lexer

    texts = ["a b c d e f g h", "x a b c d e f g h a b c d e f g h", "a b c d e q r s", "b b b b b b", "t incomprehensibilities u", "", None, "A, b! c d e f g"]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    passages = ["a b c d e f g h", "b b", "t incomprehensibilities u", "a b c d e f zz", "", None, "a b c d e f g"]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.query_id, r.doc_id): r.score for r in registry.QUERIES["search_benchmark_phrases"](spark, str(tmp_path)).collect()}
    words = lambda name: {r[0]: r[1] or [] for r in spark.read.parquet(str(tmp_path / name)).select(F.col("item_id" if name[0] == "b" else "doc_id"), lexer.words(F.col("text"))).collect()}
    want = {}
    for q, p in words("benchmark.parquet").items():
        for d, w in words("documents.parquet").items():
            n = sum(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1)) if p else 0
            want |= {(q, d): n} if n else {}
    assert got == want and want[1, 3] == 5 and (2, 4) in want and (0, 2) not in want


def test_entry(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).columns == ["query_id", "doc_id", "score", "url", "topic", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_index_stream(spark, sf, tmp_path):
    from quirefold.operators import index
    from quirefold.streaming.incremental import index_stream, read_segments

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.filter("doc_id % 2 = 0").write.parquet(str(tmp_path / "in"))
    path, cp = str(tmp_path / "idx"), str(tmp_path / "cp")
    run = lambda: index_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), path, cp).awaitTermination()
    run()
    docs.filter("doc_id % 2 = 1").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    want = index.postings(index.tokens(docs))
    assert read_segments(spark, path).select("word", "doc_id", "tf").exceptAll(want.select("word", "doc_id", "tf")).count() == 0
    assert read_segments(spark, path).count() == want.count()


def test_words_are_made_once(spark, sf):
    """F3 of r03: a filter on the places of words was pushed below the words, so that each text was split twice."""
    from quirefold.operators import search
    from quirefold.plans import virtual

    found = search.match_texts(virtual.documents(spark, sf), registry._BATCH)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # markup, words
