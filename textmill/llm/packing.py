"""Best-fit packing of tokenised documents into sequences of a fixed capacity (operator 1).

Method: pieces above a third of the capacity ("large") fit at most twice in a bin, so they
are matched greedily, the longest with the longest partner that still fits; the smaller
ones then go, longest first, to the tightest remaining gap.

At scale nothing but a histogram of lengths (at most ``capacity`` rows) reaches the driver:
pieces of one length are interchangeable, so the packing is planned on counts and a piece
finds its bin by its length and its rank among the pieces of that length. The rank is the
rank inside the writing task plus the counts of the tasks before, so no length, however
frequent, meets in one task.

Edge cases: a null text is empty; an empty document is the end id alone; repeated rows and
ids are packed like any others; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.storage import batches_of, materialize
from textmill.llm.subwords import encoder, in_slices, public_path

CAPACITY = 1024
END_ID = 2
SLICE = 1 << 20
KEPT, ALONE = 300_000, 700_000  # pieces that a worker knows at a time, the second where packing runs alone; the results do not depend on it
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, part_rank long"


def cut_lengths(n_ids: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, piece number, start and length of each piece: all pieces are full but the first."""
    n_pieces = -(-n_ids // capacity)
    doc = np.repeat(np.arange(len(n_ids)), n_pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    first = (n_ids - (n_pieces - 1) * capacity)[doc]
    start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, first, capacity)


def ranks_in(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rank of each element among its equals, continuing ``seen``, which is updated."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    begins = np.flatnonzero(np.diff(ordered, prepend=-1))
    sizes = np.diff(np.append(begins, len(ordered)))
    rank = np.empty(len(values), dtype=np.int64)
    rank[order] = np.arange(len(ordered)) - np.repeat(begins, sizes) + seen[ordered]
    np.add.at(seen, values, 1)
    return rank


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, alone: bool = False) -> DataFrame:
    """One row per piece of each document, with the writing task and the rank inside it. ``alone``: a worker does nothing
    else, so it keeps more pieces, from task to task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        coder = encoder(tokenizer_path, ALONE if alone else KEPT)
        for batch, texts in in_slices(batches, "text", SLICE):
            ids, n = coder.encode(texts)
            ends = np.cumsum(n)
            full = np.insert(ids, ends, end_id).astype("<u4")
            n = n + 1
            begins = np.cumsum(n) - n
            doc, piece, start, length = cut_lengths(n, capacity)
            at = begins[doc] + start
            raw = memoryview(full).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(ranks_in(length, seen), pa.int64())],
                [x.split()[0] for x in PIECES.split(", ")],
            )
        if not alone:
            coder.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Bins as (how many alike, lengths of their pieces) for ``counts[length]`` pieces of each length.
    The number of kinds depends on ``capacity`` alone, not on the number of pieces."""
    left = counts.astype(object).copy()
    least_large = capacity // 3 + 1
    gaps: list[int] = []  # sorted
    open_bins: dict[int, list[list]] = {}
    closed: list[tuple[int, list[int]]] = []

    def put(many: int, lengths: list[int]) -> None:
        gap = capacity - sum(lengths)
        if gap == 0:
            closed.append((many, lengths))
            return
        if gap not in open_bins:
            bisect.insort(gaps, gap)
            open_bins[gap] = []
        open_bins[gap].append([many, lengths])

    for x in range(capacity, least_large - 1, -1):
        y = min(x, capacity - x)
        while left[x] > 0:
            while y >= least_large and (left[y] == 0 or (y == x and left[x] < 2)):
                y -= 1
            if y < least_large:
                put(left[x], [x])
                left[x] = 0
            else:
                many = left[x] // 2 if x == y else min(left[x], left[y])
                put(many, [x, y])
                left[x] -= many
                left[y] -= many
    for s in range(least_large - 1, 0, -1):
        while left[s] > 0:
            k = bisect.bisect_left(gaps, s)
            if k == len(gaps):
                each = capacity // s
                if left[s] >= each:
                    put(left[s] // each, [s] * each)
                if left[s] % each:
                    put(1, [s] * (left[s] % each))
                left[s] = 0
                continue
            gap = gaps[k]
            many, lengths = open_bins[gap].pop()
            used = min(many, left[s])
            if used < many:
                open_bins[gap].append([many - used, lengths])
            elif not open_bins[gap]:
                del open_bins[gap], gaps[k]
            left[s] -= used
            put(used, [*lengths, s])
    return closed + [(many, lengths) for rows in open_bins.values() for many, lengths in rows]


def places(bins: list[tuple[int, list[int]]], capacity: int) -> tuple[np.ndarray, ...]:
    """Per (length, first rank): key ``length * 2**48 + rank``, its sequence number and the offset."""
    next_rank = [0] * (capacity + 1)
    rows, sequence = [], 0
    for many, lengths in bins:
        offset = 0
        for length in lengths:
            rows.append(((length << 48) + next_rank[length], sequence, offset))
            next_rank[length] += many
            offset += length
        sequence += many
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, alone: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text): one row per piece with its ``sequence_id`` and ``offset``; ``alone`` as in ``pieces``."""
    with batches_of(docs.sparkSession, 2000):  # whole texts: fewer at a time, for memory
        cut = materialize(pieces(docs, tokenizer_path or public_path(), capacity, end_id, alone), "pieces")
    per_task = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    keys, sequences, offsets = places(plan_bins(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = cut.join(earlier, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("part_rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            key = (batch.column("length").to_numpy() << 48) + rank
            k = np.searchsorted(keys, key, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequences[k] + key - keys[k]), pa.array(offsets[k])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
