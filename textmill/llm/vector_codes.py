"""Vectors as short codes: one codebook entry for each part of a vector (operator 13).

Components become whole numbers, floor(1024 * x). A vector is cut into four consecutive parts; each part position has a
codebook of up to 256 entries, which starts with that part of the first rows and is improved in rounds: all parts go to
their nearest entry, and each entry becomes the mean of its parts, rounded down. All arithmetic is on whole numbers, so the
result doesn't depend on how the rows are partitioned.

The nearest entry is found by partial distances (``nearest``): dimensions are taken by falling variance of the codebook. The
sums over the first ones, of all entries, give each vector a guess, whose complete distance is the best so far; from
then on an entry is dropped as soon as its sum is strictly above the best, so ties survive and the answer is exact. Masks tell
which are left; when they are few, only they go on.

Scale: the numbers are written once as a table and read in each round. A task sends the count and sum of each entry, 1024 rows at
most, which Spark adds up; the codebooks (4 * 256 entries, of a size given by the vectors' width) go through the driver and to the tasks. Sums
by label are aggregates, joined back to the coded rows.

Edge cases: rows whose vector is null or holds a null or non-finite component are left out; components beyond 16384 in
magnitude count as at that bound; with fewer than 256 rows the codebooks are that small; equal ids are in order of their
numbers, null ids last; a vector with another number of components than the first row has no code and no error; a width that four does not divide is cut as evenly as
possible; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.storage import batches_of, discard, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BOUND = 1 << 24
HEAD = 4  # dimensions after which each vector has a first guess
FEW = 16  # where no more than one in so many entries is left, they go on one by one
BLOCK = 1024
BATCH = 4096
RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def numbers(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, vector, label) -> the kept ones: vec_id, label and the vector's whole numbers."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("vector", lambda x: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(x * SCALE))).cast("int"))
    typed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("vector").cast("array<double>").alias("vector"))
    return typed.where(F.col("vector").isNotNull() & fine).select("vec_id", "label", whole.alias("numbers"))


def cuts(width: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin, and the last ends."""
    return [i * width // parts for i in range(parts + 1)]


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of ``book`` to each of ``values`` by squared distance, the first of equal ones, and that distance."""
    index, distance = np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=np.int64)
    width = book.shape[1]
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable") if width else np.zeros(0, dtype=np.int64)
    most = max(int(np.abs(values).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.int32 if width * (2 * most) ** 2 < 1 << 31 else np.int64
    book = np.ascontiguousarray(book[:, order], dtype=kind)
    for a in range(0, len(values), BLOCK):
        own = np.ascontiguousarray(values[a : a + BLOCK, order], dtype=kind)
        rows = np.arange(len(own))

        def complete(guess: np.ndarray) -> np.ndarray:
            step = own - book[guess]
            return (step * step).sum(axis=1, dtype=kind)

        sums = np.zeros((len(own), len(book)), dtype=kind)
        best = np.full(len(own), np.iinfo(kind).max, dtype=kind)
        done, left = 0, np.ones(sums.shape, dtype=bool)
        while done < width and np.count_nonzero(left) * FEW > left.size:  # while many are left, a plain matrix is cheapest
            step = own[:, done, None] - book[None, :, done]
            sums += step * step
            done += 1
            if done in (HEAD, 2 * HEAD):
                best = np.minimum(best, complete(sums.argmin(axis=1)))
            left = sums <= best[:, None]
        row, entry = np.nonzero(left)
        so_far = sums[row, entry]
        for d in range(done, width):
            step = own[row, d] - book[entry, d]
            so_far = so_far + step * step
            keep = so_far <= best[row]
            row, entry, so_far = row[keep], entry[keep], so_far[keep]
        least = np.minimum.reduceat(so_far, np.searchsorted(row, rows))
        at = np.flatnonzero(so_far == least[row])
        index[a : a + BLOCK] = entry[at[np.searchsorted(row[at], rows)]]
        distance[a : a + BLOCK] = least
    return index, distance


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have that width, and their numbers."""
    fits = np.diff(column.offsets.to_numpy()) == width
    return fits, column.filter(pa.array(fits)).flatten().to_numpy().reshape(int(fits.sum()), width)


def first_books(table: DataFrame) -> list[np.ndarray]:
    """The codebooks of the first rows, of at most ``ENTRIES`` entries."""
    rows = [r["numbers"] for r in table.orderBy(F.asc_nulls_last("vec_id"), "numbers").select("numbers").limit(ENTRIES).collect()]
    rows = [r for r in rows if len(r) == len(rows[0])]
    width = len(rows[0]) if rows else 0
    whole = np.array(rows, dtype=np.int64).reshape(len(rows), width)
    at = cuts(width)
    return [whole[:, a:b] for a, b in zip(at, at[1:])]


def improved(table: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every part to its nearest entry, every entry to the mean of its parts."""
    at = cuts(sum(b.shape[1] for b in books))
    widest = max(b.shape[1] for b in books)
    if not widest:
        return books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), dtype=np.int64) for b in books]
        total = [np.zeros((len(b), widest), dtype=np.int64) for b in books]
        for batch in batches:
            _, values = _matrix(batch.column(0), at[-1])
            for p, book in enumerate(books):
                own = values[:, at[p] : at[p + 1]]
                index, _ = nearest(own, book)
                n[p] += np.bincount(index, minlength=len(book))
                order = np.argsort(index, kind="stable")
                if len(order):
                    begins = np.flatnonzero(np.diff(index[order], prepend=-1))
                    total[p][index[order[begins]], : own.shape[1]] += np.add.reduceat(own[order].astype(np.int64), begins, axis=0)
        for p in range(len(books)):
            used = np.flatnonzero(n[p])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, dtype=np.int32)), pa.array(used.astype(np.int32)), pa.array(n[p][used]), pa.array(list(total[p][used]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = table.select("numbers").mapInArrow(run, "part int, entry int, n long, total array<long>").groupBy("part", "entry")
    found = sums.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(d))) for d in range(widest)]).alias("total")).collect()
    books = [b.copy() for b in books]
    for r in found:
        book = books[r["part"]]
        book[r["entry"]] = np.array(r["total"][: book.shape[1]], dtype=np.int64) // r["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def _coded(table: DataFrame, books: list[np.ndarray]) -> DataFrame:
    at = cuts(sum(b.shape[1] for b in books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = np.array([f"{i:02x}" for i in range(ENTRIES)])
        for batch in batches:
            fits, values = _matrix(batch.column(2), at[-1])
            code, error = np.full(len(values), "", dtype="U1"), np.zeros(len(values), dtype=np.int64)
            for p, book in enumerate(books):
                index, distance = nearest(values[:, at[p] : at[p + 1]], book)
                code, error = np.char.add(code, two[index]), error + distance
            codes, errors = np.full(len(fits), None, dtype=object), np.zeros(len(fits), dtype=np.int64)
            codes[fits], errors[fits] = code, error
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, mask=~fits)], ["vec_id", "label", "code", "error"])

    label = table.schema["label"].dataType.simpleString()
    return table.select("vec_id", "label", "numbers").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def encode(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (vec_id, vector, label) -> ``RESULT``, a row for each kept vector."""
    spark: SparkSession = rows.sparkSession
    with batches_of(spark, BATCH):
        table = materialize(numbers(rows), "vector-numbers")
        books = first_books(table)
        if not len(books[0]):
            return spark.createDataFrame([], RESULT)
        for _ in range(rounds):
            books = improved(table, books)
        coded = materialize(_coded(table, books), "vector-codes")
    discard(table)
    sums = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "vector-labels")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    dot = lambda a, b: f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
    pick = lambda book: f"(SELECT vec_id, label, part, u, min(({dot('u', 'u')} - 2 * {dot('u', 'c')} + {dot('c', 'c')})::BIGINT * {ENTRIES} + entry) AS m FROM p JOIN {book} USING (part) GROUP BY ALL)"
    steps = []
    for r in range(ROUNDS):
        steps.append(f"""s{r} AS MATERIALIZED (SELECT part, entry, list(x ORDER BY d) AS c FROM (
  SELECT part, m % {ENTRIES} AS entry, d, floor(sum(u[d]) / count(*))::BIGINT AS x FROM {pick(f'b{r}')}, (SELECT unnest(range(1, 17)) AS d) GROUP BY ALL) GROUP BY ALL
), b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s.c, b.c) AS c FROM b{r} b LEFT JOIN s{r} s ON s.part = b.part AND s.entry = b.entry)""")
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (SELECT vec_id, label, i AS part, v[16 * i + 1 : 16 * i + 16] AS u FROM k, (SELECT unnest(range(0, {PARTS})) AS i)
), b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, u AS c FROM p QUALIFY entry < {ENTRIES}
), {", ".join(steps)}, n AS (SELECT vec_id, label, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY part) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM {pick(f'b{ROUNDS}')} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256 FROM n"""


ORACLE = _oracle()
