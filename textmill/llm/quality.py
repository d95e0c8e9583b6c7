"""Quality classifier: naive Bayes support vectors (operator 10).

Features are indicators of n-grams, hashed to ``BUCKETS`` columns: words, word pairs, and
runs of one to three word shapes (capitals, last character, length class, same word as
before), which carry over to words never seen. Each indicator is scaled by its log-count
ratio between the classes, the vector brought to length one, and a linear hinge-loss model
fitted by dual coordinate descent; a logistic curve over margins of rows kept back from the
fit turns margins into probabilities.

The fit is on bounded samples of the labelled training rows, those of each class with the least
hash of their id: counts come from at most ``COUNTED`` rows, half of them for each class, summed
in the tasks and then by column, so that at most ``BUCKETS`` rows reach the driver; the hinge
loss from at most ``SAMPLE`` of them, half for each class. A class with fewer rows gives all it
has. The labels of ``COUNTED`` rows are
broadcast, so no text is shuffled. Scoring is a map over all rows with two vectors of ``BUCKETS``
numbers.

Edge cases: a null or empty text has no features and gets the score of the bias; labels
without a class, and ids without a document, are not used; several labels of one id count
as the least; without rows of both classes all scores are the share of class 1, or 0.5;
empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.storage import materialize
from textmill.llm.subwords import in_slices
from textmill.llm.vectext import U64, mix, parts, word_hashes, words_of

BUCKETS = 1 << 18
COUNTED = 40_000
SAMPLE = 4000
THRESHOLD = 0.7
SLICE = 1 << 19


class Model(NamedTuple):
    """``ratios`` scale the indicators, ``weights`` the scaled ones; then the logistic curve."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def _shapes(words, hashes: np.ndarray) -> np.ndarray:
    """A number below 512 for each word."""
    data, starts, ends = words.data, words.starts, words.ends
    upper = (data >= 0x41) & (data <= 0x5A)
    lower = (data >= 0x61) & (data <= 0x7A)
    digit = (data >= 0x30) & (data <= 0x39)
    symbol = (data > 0x20) & (data < 0x80) & ~upper & ~lower & ~digit

    def inside(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return sums[ends] > sums[starts]

    has_lower, has_upper = inside(lower), inside(upper)
    caps = np.where(has_lower, np.where(upper[starts], 1, 0), np.where(has_upper, 2, 3))
    last = data[ends - 1]
    kind = np.select([last == 0x2E, last == 0x2C, last == 0x21, digit[ends - 1], symbol[ends - 1]], [1, 2, 3, 4, 5], 0)
    doubled = symbol[ends - 1] & symbol[np.maximum(ends - 2, 0)] & (ends - starts > 1)
    size = np.searchsorted([1, 3, 7], ends - starts)
    again = np.zeros(len(hashes), dtype=np.int64)
    again[1:] = hashes[1:] == hashes[:-1]
    firsts = words.docs[:-1]
    again[firsts[firsts < len(again)]] = 0
    return (((caps * 8 + kind) * 2 + doubled) * 4 + size) * 2 + again


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of all texts one after another, and where each text's begin (one more). A very long
    text is taken in parts."""
    keys = [_feature_keys(part) for _, part in parts(texts, 2)]
    keys = keys[0] if len(keys) == 1 else np.unique(np.concatenate(keys))
    begins = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=U64) << U64(18))
    return (keys & U64(BUCKETS - 1)).astype(np.int32), begins


def _feature_keys(texts: pa.Array) -> np.ndarray:
    """Text number and feature in one number, ascending."""
    words = words_of(texts, lower=False)
    n_texts = len(texts)
    hashes = word_hashes(words)
    shapes = (_shapes(words, hashes) + 1).astype(U64)
    doc = np.repeat(np.arange(n_texts, dtype=U64), np.diff(words.docs))
    found = []
    with np.errstate(over="ignore"):
        for kind, (codes, n) in enumerate(((hashes, 1), (hashes, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
            if len(codes) < n:
                continue
            h = codes[: len(codes) - n + 1].copy()
            for k in range(1, n):
                h = h * U64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k]
            h = mix(h + U64(kind + 1) * U64(0xD1B54A32D192ED03)) >> U64(46)
            same = doc[: len(h)] == doc[n - 1 :] if n > 1 else slice(None)
            found.append(((doc[: len(h)] << U64(18)) | h)[same])
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=U64)


def held_out(doc_id: Column, of: int = 4, remainder: int = 2) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo ``of``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == remainder, F.lit(False))


def _gather(sampled: set[int]):
    """Counts of features by class, summed over the task, and the features of sampled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("feature", pa.int32()), ("ones", pa.int64()), ("zeros", pa.int64()), ("doc_id", pa.int64()), ("label", pa.int32()), ("features", pa.list_(pa.int32()))])
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        rows = np.zeros(2, dtype=np.int64)
        for batch, texts in in_slices(batches, "text", SLICE):
            found, begins = features(texts)
            labels = batch.column("label").to_numpy()
            each = np.repeat(labels, np.diff(begins))
            for c in (0, 1):
                counts[c] += np.bincount(found[each == c], minlength=BUCKETS)
                rows[c] += (labels == c).sum()
            keep = [(d, int(labels[i]), found[begins[i] : begins[i + 1]]) for i, d in enumerate(batch.column("doc_id").to_pylist()) if d in sampled]
            if keep:
                doc, label, lists = zip(*keep)
                yield pa.RecordBatch.from_arrays([pa.array([-2] * len(keep), pa.int32()), pa.nulls(len(keep), pa.int64()), pa.nulls(len(keep), pa.int64()), pa.array(doc, pa.int64()), pa.array(label, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], schema=schema)
        some = np.flatnonzero(counts.any(axis=0))
        index = np.append(some, -1)
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), pa.array(np.append(counts[1][some], rows[1])), pa.array(np.append(counts[0][some], rows[0])), pa.nulls(len(index), pa.int64()), pa.nulls(len(index), pa.int32()), pa.nulls(len(index), pa.list_(pa.int32()))], schema=schema)

    return run


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias by dual coordinate descent; rows are lists of features. The rarer class
    costs as much in all as the other."""
    y = np.where(labels == 1, 1.0, -1.0)
    most = cost * len(y) / (2 * np.array([np.sum(y == s) for s in (-1, 1)]))
    bound = np.where(y > 0, most[1], most[0])
    values = [(v := ratios[f]) / max(np.sqrt(v @ v), 1e-12) for f in rows]
    square = np.array([v @ v + 1.0 for v in values])
    weights, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, v = rows[i], values[i]
            gradient = y[i] * (weights[f] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weights[f] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def margins(rows: list[np.ndarray], ratios: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(rows), bias)
    for i, f in enumerate(rows):
        v = ratios[f]
        out[i] += (weights[f] @ v) / max(np.sqrt(v @ v), 1e-12)
    return out


def fit_logistic(x: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with targets drawn in by the class counts."""
    ones, zeros = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps, held back by a small ridge
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, counted: int = COUNTED) -> Model:
    """A model of ``labels`` (doc_id, <label> 0/1) from ``docs`` (doc_id, text) that are not held out."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    of_class = [wanted.where(F.col("label") == c).orderBy(order, "doc_id").limit(counted // 2) for c in (0, 1)]
    wanted = materialize(of_class[0].unionByName(of_class[1]), "quality-labels")
    by_class = [{r["doc_id"] for r in wanted.where(F.col("label") == c).orderBy(order, "doc_id").select("doc_id").limit(sample // 2).collect()} for c in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out(F.col("doc_id"))).join(F.broadcast(wanted), "doc_id")
    got = materialize(rows.mapInArrow(_gather(by_class[0] | by_class[1]), "feature int, ones long, zeros long, doc_id long, label int, features array<int>"), "quality-counts")
    counts = np.zeros((2, BUCKETS))
    n = np.zeros(2)
    for f, ones, zeros in got.where("feature >= -1").groupBy("feature").agg(F.sum("ones"), F.sum("zeros")).toPandas().itertuples(index=False):
        if f < 0:
            n[:] = zeros, ones
        else:
            counts[:, f] = zeros, ones
    if not n.all():
        p = (n[1] / n.sum()) if n.sum() else 0.5
        p = min(max(p, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, float(np.log(p / (1 - p))))
    p, q = counts[1] + 1, counts[0] + 1
    ratios = np.log(p / p.sum()) - np.log(q / q.sum())
    picked = got.where("feature = -2").select("doc_id", "label", "features").toPandas()
    lists = [np.asarray(f, dtype=np.int64) for f in picked["features"]]
    y = picked["label"].to_numpy()
    # By a hash of the id, and by features where rows share one: not the order of arrival.
    order = sorted(range(len(y)), key=lambda i: (zlib.crc32(str(picked["doc_id"][i]).encode()), picked["doc_id"][i], lists[i].tobytes()))
    lists, y = [lists[i] for i in order], y[order]
    fold = np.arange(len(y)) % 4 == 0
    if len(np.unique(y[fold])) == 2 and len(np.unique(y[~fold])) == 2:
        weights, bias = fit_hinge([f for f, k in zip(lists, fold) if not k], y[~fold], ratios)
        slope, shift = fit_logistic(margins([f for f, k in zip(lists, fold) if k], ratios, weights, bias), y[fold])
    else:
        slope, shift = 2.0, 0.0
    weights, bias = fit_hinge(lists, y, ratios)
    return Model(ratios, weights, bias, max(slope, 1e-3), shift)


def _scores(texts: pa.Array, scaled: np.ndarray, squares: np.ndarray, model: Model) -> np.ndarray:
    found, begins = features(texts)
    dot, square = np.zeros((2, len(texts)))
    some = np.flatnonzero(np.diff(begins))
    if len(some):  # each text is summed by itself, so its score does not depend on its neighbours
        dot[some], square[some] = (np.add.reduceat(v[found], begins[some]) for v in (scaled, squares))
    x = model.bias + dot / np.maximum(np.sqrt(square), 1e-12)
    return 1 / (1 + np.exp(-(model.slope * x + model.shift)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""
    scaled, squares = model.ratios * model.weights, model.ratios**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in in_slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(texts, scaled, squares, model))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the rows that score below ``threshold``; all columns are kept."""
    model = train(docs, labels)
    scaled, squares = model.ratios * model.weights, model.ratios**2
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in in_slices(iter([batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])]), f"c{column}", SLICE):
                keep = _scores(texts, scaled, squares, model) >= threshold
                yield rows.filter(pa.array(keep)).rename_columns(batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
