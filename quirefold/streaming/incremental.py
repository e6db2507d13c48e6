"""Keeping an index up to date from a stream of documents: each batch becomes a segment of postings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirefold.operators import index


def index_stream(docs: DataFrame, path: str, checkpoint: str, text: str = "text", stop_words: Iterable[str] = ()) -> StreamingQuery:
    """Writes the postings of each batch to its own segment; a batch that is run again replaces its segment. Runs until all that is there is done."""

    def write(batch: DataFrame, number: int) -> None:
        post = index.postings(index.tokens(batch, text, stop_words))
        post.repartitionByRange("word").sortWithinPartitions("word", "doc_id").write.mode("overwrite").parquet(f"{path}/segment={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Postings of all segments; of a document that came again, those of its last segment."""
    post = spark.read.parquet(path)
    last = post.groupBy("doc_id").agg(F.max("segment").alias("segment"))
    return post.join(last, ["doc_id", "segment"]).drop("segment")
