"""Chunking of a stream of documents. Every chunker is a map of one row, so a stream needs no
state and no watermark; metrics and TF-IDF are computed over what the sink has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textmill.plans.strategies import chunk, documents


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_per_batch: int = 100) -> DataFrame:
    return documents(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def chunk_stream(docs: DataFrame, given: dict, strategy: str, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the chunks of each new document; exactly once, by the file sink's log."""
    writer = chunk(docs, given, strategy).writeStream.format("parquet").partitionBy("strategy").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(path)
