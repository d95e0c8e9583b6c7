"""SimHash fingerprints and near-duplicate classes (operator 4).

Fingerprint: A-Z in lower case, words, 4-word shingles with repeats (a shorter text: all its
words), XXH64 with seed 42 of each; a bit is one if more than half of the hashes have it.

Search: covering locality-sensitive hashing. Each of the 64 bits gets a non-zero vector of
r + 1 bits; a table for each non-zero vector v looks only at the bits whose vector has an odd
product with v. The vectors of r differing bits span r dimensions at most, so some v is
orthogonal to all of them and its table does not look at any differing bit: every pair within
radius r meets in some table. Equal fingerprints are one node from the start. How the members
of a bucket are compared is said in ``buckets``: never all pairs of a large one in one task.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; rows
that share an id are separate rows with the same ``doc_id``; null ids never give the class
its name unless all ids in it are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import minhash
from textmill.llm.buckets import bucket_links, members_of
from textmill.llm.components import connected_components
from textmill.llm.storage import materialize
from textmill.llm.subwords import in_slices
from textmill.llm.vectext import parts, windows, words_of, xxh64

SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCK = 2000
SLICE = 1 << 19


def bit_counts(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """How many shingle hashes of each text have each bit, and how many there are."""
    words = words_of(texts)
    first, last, begins = windows(words.docs, shingle)
    starts = words.starts[first]
    h = xxh64(words.data, starts, words.ends[last] - starts, SEED)
    counts = np.diff(begins)
    ones = np.zeros((len(counts), 64), dtype=np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones[some] = np.add.reduceat(bits, begins[some], axis=0, dtype=np.int64)
    return ones, counts


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text; a very long text is counted in parts."""
    sums = [bit_counts(part, shingle) for _, part in parts(texts, shingle - 1)]
    ones, counts = sum(o for o, _ in sums), sum(c for _, c in sums)
    return np.packbits((2 * ones > counts[:, None]) & (counts[:, None] > 0), axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in in_slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(texts, shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, n_bits: int = 64) -> list[int]:
    """A mask (signed) for each table; any ``radius`` bits lie outside one of the masks."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(n_bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def near_links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) whose components are those of all links."""
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in covering_masks(radius)))
    members = members_of(fps.select(F.col("fp").alias("node"), F.posexplode(keys).alias("t", "key")))

    def near(rows: pa.Table):
        own = rows.column("node").to_numpy().view(np.uint64)
        return lambda x, some: np.bitwise_count(own[some] ^ own[x]) <= radius

    return bucket_links(members, lambda pairs: pairs.where(F.bit_count(F.col("node").bitwiseXOR(F.col("leader"))) <= radius), near, block=block)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id and the number of rows
    with the same fingerprint."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "distinct-fingerprints")
    parts = connected_components(near_links(nodes.select("fp"), radius))
    linked = materialize(parts.join(nodes, parts["node"] == nodes["fp"]).select("fp", "root", "first"), "linked-fingerprints")
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("component")), "root").select("fp", "component")
    classes = nodes.join(named, "fp", "left").select("fp", F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("component")).alias("component_id"), "copies")
    # As a table of its own, so that the join below may be split where a fingerprint has very many rows.
    classes = materialize(classes, "fingerprint-classes")
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "copies")


def keep_one(docs: DataFrame, threshold: float = minhash.THRESHOLD, radius: int = RADIUS, shingle: int = minhash.SHINGLE) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, that of the least ``doc_id`` (nulls last); all
    columns are kept, whatever their names.

    A link is an exact Jaccard similarity of ``threshold`` or more on ``shingle``-word shingles. Candidates
    come from the covering tables of the SimHash of these shingles, which find every such pair within
    ``radius`` bits, and from MinHash bands, since most pairs near the threshold differ in some ten bits,
    beyond any radius that covering masks can afford."""
    masks = covering_masks(radius)

    def tables(texts: pa.Array) -> np.ndarray:
        return fingerprints_of(texts, shingle).view(np.int64)[:, None] & np.array(masks, dtype=np.int64)

    return minhash.keep_one(docs, threshold, shingle, tables)
