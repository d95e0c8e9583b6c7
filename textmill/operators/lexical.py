"""TF-IDF over chunks: lower-case terms of two word characters or more, raw counts,
``ln((1 + n) / (1 + df)) + 1``, rows of length one, the ``max_features`` most frequent terms
(ties: by term), columns in the order of terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import lifted
from textmill.functions.text import TERMS

BETWEEN = r"[^\p{L}\p{N}_]+"  # what separates terms: they are all of ``TERMS`` that is left, but for single characters
Terms = tuple[np.ndarray, np.ndarray, pa.Array]


def lower(text: Column) -> Column:
    """Each character by itself, as in SQL and Arrow; Java looks at what stands beside a sigma, and makes two characters of a dotted I."""
    return F.lower(F.translate(text, "\u03a3\u0130", "\u03c3i"))


def found_terms(texts: pa.Array) -> Terms:
    """Of each term in ``texts``, one after another, the number of its text and of its word among the distinct ones, and these."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), pattern=BETWEEN)
    row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    words = lists.flatten().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = pc.greater_equal(pc.utf8_length(words.dictionary), 2).to_numpy(zero_copy_only=False)[code]
    return row[keep], code[keep], words.dictionary


def together(rows: DataFrame, key: str = "chunk_id", within: str | None = None) -> DataFrame:
    """``rows`` of equal ``key`` one after another in one task, with ``begins``: whether a row is the first of its key. Texts are shuffled for it, unless rows of
    a key share a value ``within`` by which they are dealt out already."""
    rows, keys = (rows, (within, key)) if within else (rows.repartition(key), (key,))
    return rows.withColumn("begins", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) == 1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows as given by ``together``, cut between chunks into about ``lifted.SLICE`` bytes of texts, with the number of each row's chunk among those of a cut."""
    held = None
    for batch in batches:
        batch = batch if held is None else pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        begins, size = batch.column("begins").to_numpy(zero_copy_only=False), lifted.sizes_of(batch.column("text"), lifted.EACH)
        starts = np.union1d(0, np.flatnonzero(begins))
        cuts = starts[np.diff((np.cumsum(size) - size)[starts] // lifted.SLICE, prepend=-1) > 0].tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a), np.cumsum(begins[a:b]) - 1
        held = batch.slice(cuts[-1])
    if held is not None:
        yield held, np.cumsum(held.column("begins").to_numpy(zero_copy_only=False)) - 1


def _counts(rows: DataFrame) -> DataFrame:
    """Texts cross one shuffle, by chunk, which the vocabulary and the vectors share; counts by chunk and term, and the norms by
    chunk, then need no other one, and a text is smaller than its counts."""
    terms = rows.select("chunk_id", "text").repartition("chunk_id").select("chunk_id", F.explode(F.regexp_extract_all(lower(F.col("text")), F.lit(TERMS), F.lit(0))).alias("term")).where("term is not null")
    return terms.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def vocabulary(rows: DataFrame, max_features: int = 10_000, within: str | None = None) -> DataFrame:
    """``rows`` (chunk_id, text) -> term_id, term, df, total, idf: at most ``max_features`` rows. ``within``: as for ``together``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in _chunks(batches):
            row, code, words = found_terms(batch.column("text"))
            n = len(words)
            total = np.bincount(code, minlength=n)
            pairs = np.sort(chunk[row] * n + code)
            df = np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] % max(n, 1), minlength=n)
            used = np.flatnonzero(total)
            # One more, without a term: the number of rows.
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.take(pa.array(used)), pa.nulls(1, words.type)]), pa.array(np.append(df[used], batch.num_rows)), pa.array(np.append(total[used], 0))], ["term", "df", "total"])

    counted = together(rows.select("chunk_id", "text", *([within] if within else [])), within=within).mapInArrow(run, "term string, df long, total long")
    top = counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).orderBy(F.col("term").isNotNull(), F.desc("total"), "term").limit(max_features + 1)
    n = F.max(F.when(F.col("term").isNull(), F.col("df"))).over(Window.partitionBy())
    numbered = top.select((F.row_number().over(Window.orderBy("term")) - 2).alias("term_id"), "term", "df", "total", F.round(F.log((1 + n) / (1 + F.col("df"))) + 1, 9).alias("idf"))
    return numbered.where("term is not null")


def vectors(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` (chunk_id, text) -> the sparse rows in long form: chunk_id, term_id, weight. ``terms`` has at
    most ``max_features`` rows, so it is broadcast."""
    found = _counts(rows).join(F.broadcast(terms.select("term", "term_id", "idf")), "term").select("chunk_id", "term_id", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("chunk_id")))
    return found.select("chunk_id", "term_id", F.round(F.col("w") / norm, 6).alias("weight"))


def sparse(weights: DataFrame) -> DataFrame:
    """Long form -> one row per chunk with parallel arrays ``indices`` and ``values``."""
    rows = weights.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("term_id", "weight"))).alias("p"))
    return rows.select("chunk_id", F.col("p.term_id").alias("indices"), F.col("p.weight").alias("values"))


def weigher(terms: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, Terms]]]:
    """Adds ``indices`` array<int> and ``values`` array<double> to rows as given by ``together``: what ``sparse`` gives, empty arrays where it gives no row. With each
    batch come the terms of its texts. ``terms``, at most ``max_features`` rows, is taken at once and goes to every task."""
    given = sorted((r.term_id, r.term, r.idf) for r in terms.select("term_id", "term", "idf").collect())
    ids, names, idf = np.array([x[0] for x in given], dtype=np.int32), pa.array([x[1] for x in given], pa.string()), np.array([x[2] for x in given], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Terms]]:
        for batch, chunk in _chunks(batches):
            row, code, words = found_terms(batch.column("text"))
            at = pc.fill_null(pc.index_in(words, value_set=names.cast(words.type)), -1).to_numpy(zero_copy_only=False)[code]
            cells, tf = np.unique(chunk[row[at >= 0]] * len(ids) + at[at >= 0], return_counts=True)
            of, at = np.divmod(cells, max(len(ids), 1))
            weight = tf * idf[at]
            norm = np.sqrt(np.bincount(of, weight * weight, minlength=chunk[-1] + 1))
            ends = pa.array(np.searchsorted(of, np.arange(chunk[-1] + 2)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids[at], rounded(weight / norm[of]))]
            if len(chunk) > chunk[-1] + 1:  # rows of one chunk
                lists = [x.take(pa.array(chunk)) for x in lists]
            yield batch.append_column("indices", lists[0]).append_column("values", lists[1]), (row, code, words)

    return run


def rounded(values: np.ndarray) -> np.ndarray:
    """Six digits; halves away from zero, as in SQL."""
    whole = np.floor(np.abs(values) * 1e6)
    return np.copysign(whole + (np.abs(values) * 1e6 - whole >= 0.5), values) / 1e6
