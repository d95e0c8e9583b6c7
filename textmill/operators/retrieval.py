"""Exact top-k by cosine: many queries against all rows of an index, in one plan and one pass over the index.

The index is dealt out in parts by a hash of the ids. Queries are packed in blocks (a row with a matrix), and each block goes to every part, so what is
shuffled is the index once and the queries once for each part; none of them passes through the driver. A task lays its part out as a matrix and
takes the blocks one after another: it holds one part and one block at a time. Each part gives the best ``k`` rows of each query, of which the
best are kept (before and after the shuffle). Similarities are taken ``CELLS`` at a time, and of them only those that reach a query's ``k``-th best so far
are looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
CELLS = 2_000_000  # similarities at a time


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _packed(queries: DataFrame, block: int) -> DataFrame:
    """``queries`` (query_id, vector) -> blocks of at most ``block`` queries: their ids and unit vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, block) for i in range(0, batch.num_rows, block)):
                ids, unit = some.column(0).to_numpy().astype("<i8"), _matrix(some.column(1)).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([unit.tobytes()])], ["ids", "unit"])

    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.where("vector is not null").mapInArrow(run, "ids binary, unit binary")


def _best(q: np.ndarray, unit: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of ``q`` the best ``k`` rows of ``unit``: numbers of queries, ids and scores; equal scores by id."""
    who, found, score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    floor = np.full(len(q), -np.inf)  # a row below its query's k-th best cannot count
    step = max(1, CELLS // max(len(q), 1))
    for a in range(0, len(unit), step):
        new = np.round(q @ unit[a : a + step].T, 6)
        row, column = np.nonzero(new >= floor[:, None])
        who, found, score = np.append(who, row), np.append(found, ids[a + column]), np.append(score, new[row, column])
        order = np.lexsort((found, -score, who))
        who, found, score = who[order], found[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        last = rank == k - 1
        floor[who[last]] = score[last]
        keep = rank < k
        who, found, score = who[keep], found[keep], score[keep]
    return who, found, score


def top_k(index: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """``index`` (id long, vector), ``queries`` (query_id long, vector), of one width; null vectors are left out ->
    query_id, rank (from 1), id, score; equal scores, to six digits, by id. A zero vector scores 0. ``parts``: so many that the
    vectors of one fit in a task's memory; as many as shuffle partitions if not given."""
    parts = parts or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    none = F.lit(None).cast("binary")
    # A null sorts first: the rows of a part, then the blocks.
    own = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "vector", none.alias("ids"), none.alias("unit"))
    each = _packed(queries, block).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("vector"), "ids", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ids, unit = -1, [], np.empty(0, dtype=np.int64), None
        for batch in batches:
            part, is_block = batch.column(0).to_numpy(), np.array(batch.column(3).is_valid())
            cuts = np.flatnonzero(np.diff(part * 2 + is_block, prepend=-1)).tolist() + [len(part)] if len(part) else []
            for a, b in zip(cuts, cuts[1:]):
                if part[a] != at:
                    at, held, unit = part[a], [], None
                if not is_block[a]:
                    held.append((batch.column(1).slice(a, b - a).to_numpy(), _matrix(batch.column(2).slice(a, b - a))))
                    continue
                if unit is None and held:
                    ids, unit = (np.concatenate(x) for x in zip(*held))
                    held = []
                if unit is None:
                    continue
                for j in range(a, b):
                    names = np.frombuffer(batch.column(3)[j].as_buffer(), dtype="<i8")
                    q = np.frombuffer(batch.column(4)[j].as_buffer(), dtype="<f8").reshape(len(names), -1)
                    who, found, score = _best(q, unit, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(names[who]), pa.array(found), pa.array(score)], ["query_id", "id", "score"])

    both = own.unionByName(each).repartition(parts, "part").sortWithinPartitions("part", F.col("ids").isNotNull())
    found = both.mapInArrow(run, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nest(hits: DataFrame) -> DataFrame:
    """(query_id, rank, chunk_id, text, score) -> one row per query with its ``retrieved_chunks`` in order."""
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text", "score"))).alias("h"))
    return rows.select("query_id", F.transform("h", lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["text"].alias("text"), h["score"].alias("score"))).alias("retrieved_chunks"))


def retrieve(queries: DataFrame, index: DataFrame, k: int = 5, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """``queries`` (query_id, query, answers, vector), ``index`` as given by ``embedding.points`` -> one row for each query: query_id, query, answers and
    ``retrieved_chunks`` (chunk_id, text, score), the best first. The index is read for its vectors and again for what was found: give a written one
    (``embedding.read_collection``), or else it is made twice."""
    rows = index.select(F.col("point_id").alias("id"), "vector", "payload")
    hits = top_k(rows, queries.select("query_id", "vector"), k, block, parts)
    named = hits.join(rows.select("id", F.col("payload.original_chunk_id").alias("chunk_id"), F.col("payload.text").alias("text")), "id")
    return queries.select("query_id", "query", "answers").join(nest(named), "query_id", "left")
