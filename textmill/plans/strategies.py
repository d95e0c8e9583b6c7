"""The catalogue of chunking strategies and the plan that applies one to documents.

A specification is ``{"type": ..., "params": {...}}``; the parameters of a hybrid hold two more. ``embedding_model`` names
the encoder of a semantic or topic chunker (``module:attribute``), ``tokenizer`` holds the parameters of a byte-pair vocabulary.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators import chunkers as C

TYPES: dict[str, Callable[..., C.Chunker]] = {
    "fixed_character": C.fixed_character,
    "fixed_token": C.fixed_token,
    "overlapping_token": C.overlapping_token,
    "sliding_token": C.sliding_token,
    "token_span": C.token_span,
    "sentence": C.sentence,
    "sentence_group": C.sentence_group,
    "paragraph": C.paragraph,
    "paragraph_group": C.paragraph_group,
    "late_sentence": C.late_sentence,
    "late_paragraph": C.late_paragraph,
    "recursive": C.recursive,
    "recursive_token": C.recursive_token,
    "parent_child": C.parent_child,
    "semantic_embedding": lambda **params: C.semantic_breakpoints("semantic_embedding_based_chunking", **params),
    "semantic_boundary": lambda **params: C.semantic_breakpoints("semantic_boundary_detection", gradient=True, **params),
    "similarity_threshold": C.similarity_threshold,
    "semantic_variance": C.semantic_variance,
    "topic": C.topic,
    "dynamic_token": C.dynamic_token,
    "content_density": C.content_density,
    "length_aware": C.length_aware,
    "llm_boundary": C.llm_boundary,
    "llm_segment": C.llm_segment,
}


def spec(kind: str, **params) -> dict:
    return {"type": kind, "params": params}


def _hybrid(primary: dict, secondary: dict | None = None) -> dict:
    return spec("hybrid", primary=primary, secondary=secondary or spec("fixed_token", chunk_size=200, overlap=20))


#: The configured strategies and their parameters.
STRATEGIES: dict[str, dict] = {
    "fixed_character_chunking": spec("fixed_character", chunk_size=100, overlap=10),
    "fixed_token_chunking": spec("fixed_token", chunk_size=50, overlap=0),
    "sliding_window_token_chunking": spec("sliding_token", window_size=50, step_size=25),
    "overlapping_token_chunking": spec("overlapping_token", chunk_size=50, overlap_size=10),
    "sentence_based_chunking": spec("sentence"),
    "sentence_group_chunking": spec("sentence_group", sentences_per_chunk=3, overlap=1),
    "paragraph_based_chunking": spec("paragraph"),
    "paragraph_group_chunking": spec("paragraph_group", paragraphs_per_chunk=2, overlap=1),
    "recursive_chunking": spec("recursive", chunk_size=500, chunk_overlap=50),
    "recursive_token_fallback_chunking": spec("recursive_token", chunk_size=100, chunk_overlap=10),
    "parent_child_chunking": spec("parent_child", parent_chunk_size=500, child_chunk_size=100, chunk_overlap=20),
    "semantic_embedding_based_chunking": spec("semantic_embedding"),
    "semantic_similarity_threshold_chunking": spec("similarity_threshold", threshold=0.6),
    "topic_based_chunking": spec("topic", distance_threshold=0.4),
    "semantic_boundary_detection": spec("semantic_boundary"),
    "late_chunking_sentence_indexing": spec("late_sentence"),
    "late_chunking_paragraph_indexing": spec("late_paragraph"),
    "late_chunking_token_spans": spec("token_span", span_size=128, step_size=64),
    "dynamic_token_size_chunking": spec("dynamic_token", min_chunk_size=50, max_chunk_size=200),
    "content_density_adaptive_chunking": spec("content_density", base_chunk_size=1000),
    "semantic_variance_adaptive_chunking": spec("semantic_variance", sensitivity=0.2),
    "length_aware_chunking": spec("length_aware", target_length=500, tolerance=100),
    "llm_boundary_detection_chunking": spec("llm_boundary"),
    "llm_segment_then_chunk": spec("llm_segment"),
    "hybrid_semantic_fixed_token_chunking": _hybrid(spec("semantic_embedding")),
    "hybrid_semantic_sliding_window_chunking": _hybrid(spec("semantic_embedding"), spec("sliding_token", window_size=50, step_size=25)),
    "hybrid_sentence_fixed_token_chunking": _hybrid(spec("sentence")),
    "hybrid_paragraph_fixed_token_chunking": _hybrid(spec("paragraph")),
    "hybrid_recursive_fixed_token_chunking": _hybrid(spec("recursive", chunk_size=500, chunk_overlap=50)),
    "hybrid_fixed_char_fixed_token_chunking": _hybrid(spec("fixed_character", chunk_size=100, overlap=10)),
    "hybrid_overlapping_fixed_token_chunking": _hybrid(spec("overlapping_token", chunk_size=50, overlap_size=10)),
    "hybrid_sentence_group_fixed_token_chunking": _hybrid(spec("sentence_group", sentences_per_chunk=3, overlap=1)),
    "hybrid_paragraph_group_fixed_token_chunking": _hybrid(spec("paragraph_group", paragraphs_per_chunk=2, overlap=1)),
    "hybrid_dynamic_fixed_token_chunking": _hybrid(spec("dynamic_token", min_chunk_size=50, max_chunk_size=200)),
    "hybrid_content_density_fixed_token_chunking": _hybrid(spec("content_density", base_chunk_size=1000)),
    "hybrid_semantic_variance_fixed_token_chunking": _hybrid(spec("semantic_variance", sensitivity=0.2)),
}


def chunker(given: dict) -> C.Chunker:
    """The chunker that a specification names."""
    kind, params = given["type"], given.get("params", {})
    if kind == "hybrid":
        rest = {k: v for k, v in params.items() if k not in ("primary", "secondary")}
        return C.hybrid(chunker(params["primary"]), chunker(params["secondary"]), **rest)
    if kind not in TYPES:
        raise ValueError(f"unknown chunker type: {kind}")
    named = {"embedding_model": "encoder"}
    return TYPES[kind](**{named.get(k, k): v for k, v in params.items()})


def read_specs(text: str) -> dict[str, dict]:
    """The enabled strategies of a JSON list of ``{name, enabled, spec}``."""
    return {x["name"]: x["spec"] for x in json.loads(text) if x.get("enabled", True)}


def documents(table: DataFrame) -> DataFrame:
    """(doc_id, text) with ids of the form ``doc_007``; a scan of fewer tasks than cores is dealt out first."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    rows = table.select(F.format_string("doc_%03d", F.col("doc_id")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.repartition(cores) if not table.isStreaming and rows.rdd.getNumPartitions() < cores else rows


def _rows(docs: DataFrame) -> DataFrame:
    """Other columns stay, for expressions that use them."""
    return docs.withColumn("text", F.coalesce("text", F.lit("")))


def made(docs: DataFrame, by: C.Chunker) -> DataFrame:
    """The chunks ``c`` of ``docs`` (doc_id, text): a row for each, with source_doc_id and chunk_ord."""
    return _each(by.add(_rows(docs), "text", "doc_id", "chunks"))


def timed(docs: DataFrame, by: C.Chunker) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text), also without chunks: doc_id, its ``chunks`` as an array, and ``spent``, the nanoseconds
    that making them took. A Python function works on whole batches: its time is shared out by the bytes of the texts it gets."""
    rows = _rows(docs).withColumn("spent", F.lit(0).cast("long"))
    return by.add(rows, "text", "doc_id", "chunks", "spent").select("doc_id", "chunks", "spent")


def _each(rows: DataFrame) -> DataFrame:
    # Not the inner generator: Spark would infer a filter on the size of the array, and compute it twice.
    return rows.select(F.col("doc_id").alias("source_doc_id"), F.posexplode_outer("chunks").alias("chunk_ord", "c")).where("c is not null")


def _named(rows: DataFrame, strategy: str | None) -> DataFrame:
    out = rows.select("source_doc_id", F.concat("source_doc_id", "c.doc_suffix").alias("doc_id"), "chunk_ord", F.concat("source_doc_id", "c.id_suffix").alias("chunk_id"), "c.text", "c.metadata")
    return out if strategy is None else out.select(F.lit(strategy).alias("strategy"), "*")


def chunk(docs: DataFrame, given: dict, strategy: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> source_doc_id, doc_id, chunk_ord, chunk_id, text, metadata (JSON)."""
    return _named(made(docs, chunker(given)), strategy)


def chunks_of(rows: DataFrame, strategy: str | None = None) -> DataFrame:
    """What ``chunk`` gives, from the rows of ``timed``."""
    return _named(_each(rows), strategy)


def chunk_all(docs: DataFrame, names: Iterable[str] | None = None, specs: dict[str, dict] | None = None) -> DataFrame:
    """The chunks of many strategies, told apart by ``strategy``."""
    specs = specs or STRATEGIES
    return reduce(DataFrame.unionByName, (chunk(docs, specs[n], n) for n in names or specs))


def register_views(docs: DataFrame, names: Iterable[str] | None = None, prefix: str = "chunks_of_") -> list[str]:
    """The chunks of ``docs`` by each strategy as a temporary view, for use in SQL; nothing is computed before a view is read."""
    made = []
    for name in names or STRATEGIES:
        chunk(docs, STRATEGIES[name], name).createOrReplaceTempView(f"{prefix}{name}")
        made.append(f"{prefix}{name}")
    return made
