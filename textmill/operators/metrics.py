"""Chunk statistics per document and per strategy, and the text report.

From a table of chunks they take a shuffle by document. From documents that hold their chunks as an array, and the time
that making them took (``strategies.timed``), those of a document come from its row alone, and include that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import json_size


def record_size(chunks: DataFrame) -> Column:
    """Bytes of a chunk's line in the chunk file: its JSON record and a line feed."""
    return _record_size(F.col("text"), F.col("metadata"), F.col("chunk_id"), F.col("doc_id"))


def _record_size(text: Column, metadata: Column, chunk_id: Column, doc_id: Column) -> Column:
    keys = len('{"text": , "metadata": , "chunk_id": , "doc_id": }\n')
    return keys + json_size(text) + F.length(metadata) + json_size(chunk_id) + json_size(doc_id)


def _sums(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each of ``docs``: its chunks' number, the sums of their lengths and squares, least and greatest length,
    and bytes. All other statistics follow from these, so chunks are made once."""
    n = F.length("text").cast("long")
    found = chunks.groupBy(F.col("source_doc_id").alias("doc_id")).agg(
        F.count("*").alias("n"), F.sum(n).alias("s"), F.sum(n * n).alias("q"), F.min(F.length("text")).alias("low"), F.max(F.length("text")).alias("high"), F.sum(record_size(chunks)).alias("bytes")
    )
    return docs.select("doc_id").join(found, "doc_id", "left").fillna(0, ["n", "s", "q", "bytes"])


def _sums_of_arrays(rows: DataFrame) -> DataFrame:
    """``_sums`` and the seconds ``spent``, from rows of doc_id, chunks (array) and spent (nanoseconds): no shuffle."""
    sizes = F.transform("chunks", lambda c: F.struct(F.length(c["text"]).cast("long").alias("n"), _record_size(c["text"], c["metadata"], F.concat("doc_id", c["id_suffix"]), F.concat("doc_id", c["doc_suffix"])).cast("long").alias("bytes")))
    total = lambda of: F.coalesce(F.aggregate("sizes", F.lit(0).cast("long"), lambda t, x: t + of(x)), F.lit(0).cast("long"))
    return rows.select("doc_id", "spent", sizes.alias("sizes")).select(
        "doc_id",
        F.coalesce(F.size("sizes"), F.lit(0)).cast("long").alias("n"),
        total(lambda x: x["n"]).alias("s"),
        total(lambda x: x["n"] * x["n"]).alias("q"),
        F.array_min(F.transform("sizes", lambda x: x["n"])).cast("int").alias("low"),
        F.array_max(F.transform("sizes", lambda x: x["n"])).cast("int").alias("high"),
        total(lambda x: x["bytes"]).alias("bytes"),
        (F.col("spent") / 1e9).alias("spent"),
    )


def _variance(n: Column, s: Column, q: Column) -> Column:
    """Of the population, from whole numbers."""
    exact = lambda c: c.cast("decimal(38,0)")
    return F.when(n > 0, ((exact(n) * exact(q) - exact(s) * exact(s)).cast("double") / n / n)).otherwise(0.0)


def per_document(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each of ``docs`` (doc_id); zeros for a document without chunks."""
    return _per_document(_sums(docs, chunks))


def per_timed_document(rows: DataFrame) -> DataFrame:
    """``per_document`` and ``chunking_time_sec``, for the rows of ``strategies.timed``."""
    return _per_document(_sums_of_arrays(rows), F.round("spent", 6).alias("chunking_time_sec"))


def _per_document(sums: DataFrame, *more: Column) -> DataFrame:
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    return sums.select(
        "doc_id",
        n.alias("chunk_count"),
        F.round(_variance(n, s, q), 6).alias("chunk_size_variance"),
        F.round(F.when(n > 0, s / n).otherwise(0.0), 6).alias("avg_chunk_size"),
        F.coalesce("low", F.lit(0)).alias("min_chunk_size"),
        F.coalesce("high", F.lit(0)).alias("max_chunk_size"),
        F.col("bytes").alias("index_size_bytes"),
        *more,
    )


def aggregated(docs: DataFrame, chunks: DataFrame, chunker: str) -> DataFrame:
    """One row: counts over documents, sizes over all chunks."""
    return _aggregated(_sums(docs, chunks), chunker)


def aggregated_timed(rows: DataFrame, chunker: str) -> DataFrame:
    """``aggregated`` and the total, average and median seconds of a document, for the rows of ``strategies.timed``: one pass, one row. The
    median is exact to the microsecond; what it keeps grows with the number of different microseconds, not of documents."""
    micros = F.round(F.col("spent") * 1e6).cast("long")
    return _aggregated(
        _sums_of_arrays(rows).withColumn("micros", micros),
        chunker,
        F.round(F.coalesce(F.sum("spent"), F.lit(0.0)), 6).alias("total_chunking_time_sec"),
        F.round(F.coalesce(F.avg("spent"), F.lit(0.0)), 6).alias("average_chunking_time_sec"),
        F.round(F.coalesce(F.expr("percentile(micros, 0.5)") / 1e6, F.lit(0.0)), 6).alias("median_chunking_time_sec"),
    )


def _aggregated(sums: DataFrame, chunker: str, *more: Column) -> DataFrame:
    total = sums.agg(
        F.count("*").alias("total_documents"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"),
        F.round(F.avg("n"), 6).alias("average_chunks_per_document"),
        F.min("n").alias("min_chunks_per_document"),
        F.max("n").alias("max_chunks_per_document"),
        F.expr("percentile(n, 0.5)").alias("median_chunks_per_document"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_index_size_bytes"),
        F.round(F.avg("bytes"), 3).alias("average_index_size_bytes_per_document"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("s"),
        F.coalesce(F.sum("q"), F.lit(0)).alias("q"),
        F.coalesce(F.min("low"), F.lit(0)).alias("global_min_chunk_size"),
        F.coalesce(F.max("high"), F.lit(0)).alias("global_max_chunk_size"),
        *more,
    )
    n, s, q = F.col("total_chunks"), F.col("s"), F.col("q")
    derived = {"global_chunk_size_variance": F.round(_variance(n, s, q), 4), "global_avg_chunk_size": F.round(F.when(n > 0, s / n).otherwise(0.0), 6)}
    return total.withColumns(derived).drop("s", "q").select(F.lit(chunker).alias("chunker"), "*")


def report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lines of the text report, in order of ``line``: a count for each document, by id as text, then totals."""
    return report_of(per_document(docs, chunks))


def report_of(each: DataFrame) -> DataFrame:
    """``report`` of the rows of ``per_document``."""
    each = each.select("doc_id", "chunk_count")
    totals = each.agg(F.count("*").alias("d"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("c"), F.coalesce(F.avg("chunk_count"), F.lit(0.0)).alias("a"), F.coalesce(F.min("chunk_count"), F.lit(0)).alias("lo"), F.coalesce(F.max("chunk_count"), F.lit(0)).alias("hi"))
    names = [("Total documents: %d", "d"), ("Total chunks: %d", "c"), ("Average chunks per document: %.2f", "a"), ("Min chunks: %d", "lo"), ("Max chunks: %d", "hi")]
    tail = totals.select(F.posexplode(F.array(*(F.format_string(f, c) for f, c in names))).alias("pos", "value")).select(F.concat(F.lit("~"), F.col("pos").cast("string")).alias("line"), "value")
    return each.select(F.col("doc_id").alias("line"), F.format_string("%s: %d chunks", "doc_id", "chunk_count").alias("value")).unionByName(tail)
