"""Benchmark decontamination (operator 7): documents that hold a benchmark item, edits allowed.

Texts are sequences of words (A-Z in lower case). A document holds an item of m words if one of
its windows of m words is within ``floor(SHARE * m)`` word edits of it.

Search: the CGK random walk writes a window as 2m symbols; at each step it puts out the current
word and moves on if a random bit of (step, word) says so, so that a small edit distance becomes
a small Hamming distance. A key joins ``BITS`` sampled places of the output; there are ``PER_WALK``
keys for each of ``walks_of`` walks. A window and an item of its size that meet in some table are
verified by their exact edit distance. The number of tables is set by the recall wanted at the
full edit distance (see the tests); any one hit among the windows around a passage suffices.

Windows are item-sized and start at a word. Those that cannot match are left out before the
walk, without loss: of m words with d edits, runs of ``n = min(RUN, m // (d + 1))`` words stay as
they were, at most d places off, and at least ``m - n + 1 - n * d`` of them, so only windows with
that many runs of items of their size, one of them at about its place, are embedded.

Scale: documents are not shuffled. Items are taken in blocks of ``ITEM_BLOCK`` words at most, one at
a time on the driver and in the tasks; each takes one pass over the documents, whose findings are written.

Edge cases: null and empty texts hold nothing; items without words match nothing; items of fewer
than five words must occur exactly; repeated rows and items give a row each; an item id may be
null; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.storage import materialize
from textmill.llm.subwords import in_slices
from textmill.llm.vectext import U64, mix, parts, word_hashes, words_of

SHARE = 0.2
RUN = 3
WALKS, PER_WALK, BITS = 12, 5, 3
ITEM_BLOCK = 1_000_000
PAIRS = 2_000_000
HELD = 2_000_000
SLICE = 1 << 19
FOUND = "doc_id long, item_id long, start_word int, n_words int, distance int"
GOLDEN = U64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4096)
def _seed(*parts: int) -> np.uint64:
    h = np.zeros(1, dtype=U64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = mix(h * GOLDEN + U64(p + 1))
    return h[0]


def walks_of(m: int) -> int:
    """Walks for items of ``m`` words: two walks drift apart with length, so long items get more."""
    return WALKS * (1 + m // 150)


def walk_keys(words: np.ndarray, m: int) -> np.ndarray:
    """Rows of ``m`` word hashes -> their key in each table, (tables, rows)."""
    n, steps, walks = len(words), 2 * m, walks_of(m)
    flat = np.concatenate([words, np.zeros((n, 1), dtype=U64)], axis=1).ravel()  # zero: beyond the end
    base = np.arange(n) * (m + 1)
    out = np.empty((walks * PER_WALK, n), dtype=U64)
    with np.errstate(over="ignore"):
        for walk in range(walks):
            at = np.zeros(n, dtype=np.int64)
            put = np.empty((steps, n), dtype=U64)
            bits = mix(flat + _seed(7, walk))
            for j in range(steps):
                if j % 64 == 0 and j:
                    bits = mix(bits + GOLDEN)
                place = base + at
                put[j] = flat[place]
                at = np.minimum(at + ((bits[place] >> U64(j % 64)) & U64(1)).astype(np.int64), m)
            for t in range(PER_WALK):
                rng = np.random.default_rng([m, walk, t])
                key = np.full(n, _seed(11, walk, t, m), dtype=U64)
                for j in np.sort(rng.choice(steps, min(BITS, steps), replace=False)):
                    key = mix(key * GOLDEN + put[j])
                out[walk * PER_WALK + t] = key
    return out


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance of each pair of rows (pairs, m)."""
    n, m = a.shape
    row = np.repeat(np.arange(m + 1, dtype=np.int16)[:, None], n, axis=1)
    for i in range(m):
        last, row[0] = row[0].copy(), i + 1
        for j in range(m):
            best = np.minimum(np.minimum(row[j + 1], row[j]) + 1, last + (a[:, i] != b[:, j]))
            last, row[j + 1] = row[j + 1].copy(), best
    return row[m]


class Items:
    """What the tasks need to know of a block of items."""

    def __init__(self, ids: list[int | None], texts: list[str], share: float):
        words = words_of(pa.array(texts, pa.large_string()))
        codes = word_hashes(words)
        self.ids, self.sizes = ids, np.diff(words.docs)
        self.words = [codes[a:b] for a, b in zip(words.docs, words.docs[1:])]
        self.edits = (share * self.sizes + 1e-9).astype(np.int64)
        self.by_size: dict[int, tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}
        seeds: dict[int, set[tuple[int, int, int]]] = {}
        for m in sorted(set(self.sizes.tolist()) - {0}):
            which = np.flatnonzero(self.sizes == m)
            rows = np.stack([self.words[i] for i in which])
            keys = walk_keys(rows, m)
            order = np.argsort(keys, axis=1, kind="stable")
            self.by_size[m] = (which, [(k[o], o) for k, o in zip(keys, order)])
            run = min(RUN, max(1, m // (int(share * m + 1e-9) + 1)))
            for row in rows:
                seeds.setdefault(run, set()).update((int(h), o, m) for o, h in enumerate(runs_of(row, run)))
        self.seeds = {}
        for run, found in seeds.items():
            rows = np.array(sorted(found), dtype=U64)
            self.seeds[run] = (rows[:, 0], rows[:, 1].astype(np.int64), rows[:, 2].astype(np.int64))


def runs_of(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words."""
    h = codes[: max(0, len(codes) - n + 1)].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            h = mix(h * GOLDEN + codes[k : len(codes) - n + 1 + k])
    return h


def window_starts(codes: np.ndarray, docs: np.ndarray, items: Items, share: float) -> dict[int, np.ndarray]:
    """For each item size, the places where a window of it may be near an item."""
    found: dict[int, list[np.ndarray]] = {}
    doc_of = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
    for run, (hashes, offsets, sizes) in items.seeds.items():
        h = runs_of(codes, run)
        lo = np.searchsorted(hashes, h, side="left")
        hit = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == h)
        lo = lo[hit]
        many = np.searchsorted(hashes, h[hit], side="right") - lo
        place = np.repeat(hit, many)
        entry = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        for m in np.unique(sizes[entry]).tolist():
            own = sizes[entry] == m
            d = int(share * m + 1e-9)
            start = (place[own] - offsets[entry[own]])[:, None] + np.arange(-d, d + 1)
            doc = np.broadcast_to(doc_of[place[own]][:, None], start.shape)
            ok = (start >= docs[doc]) & (start + m <= docs[doc + 1])
            start = np.unique(start[ok])
            held = np.zeros(len(codes) + 1, dtype=np.int32)
            held[place[own] + 1] = 1
            held = np.cumsum(held)
            enough = held[start + m - run + 1] - held[start] >= max(1, m - run + 1 - run * d)
            found.setdefault(m, []).append(start[enough])
    return {m: np.unique(np.concatenate(parts)) for m, parts in found.items()}


class Windows:
    """Windows gathered over many texts, so that all of one size are embedded at once."""

    def __init__(self, items: Items, share: float):
        self.items, self.share = items, share
        self.rows, self.held = 0, 0
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def add(self, texts: pa.Array) -> None:
        """Texts count on from those added before. A very long one is taken in parts, each window of it once."""
        for before, part in parts(texts, max(self.items.by_size, default=1) - 1):
            words = words_of(part)
            codes = word_hashes(words)
            for m, starts in window_starts(codes, words.docs, self.items, self.share).items():
                if len(starts):
                    doc = np.searchsorted(words.docs, starts, side="right") - 1
                    self.parts.setdefault(m, []).append((codes[starts[:, None] + np.arange(m)], doc + self.rows, starts - words.docs[doc] + before))
                    self.held += len(starts) * m
        self.rows += len(texts)

    def matches(self) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, distance): the nearest window of each text and item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for m, parts in self.parts.items():
            windows, docs, starts = (np.concatenate(x) for x in zip(*parts))
            which, tables = self.items.by_size[m]
            for some in np.array_split(np.arange(len(docs)), max(1, len(docs) * 4 * m // PAIRS)):
                self._verify(m, windows[some], docs[some], starts[some], which, tables, best)
        self.rows, self.held, self.parts = 0, 0, {}
        return [(doc, item, start, m, near) for (doc, item), (near, start, m) in sorted(best.items())]

    def _verify(self, m: int, windows: np.ndarray, docs: np.ndarray, starts: np.ndarray, which: np.ndarray, tables: list, best: dict) -> None:
        d = int(self.share * m + 1e-9)
        pairs = []
        for key, (table, order) in zip(walk_keys(windows, m), tables):
            lo = np.searchsorted(table, key, side="left")
            many = np.searchsorted(table, key, side="right") - lo
            w = np.repeat(np.arange(len(key)), many)
            entry = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
            pairs.append(w * len(which) + order[entry])
        met = np.unique(np.concatenate(pairs))
        for some in np.array_split(met, max(1, len(met) * 2 * m // PAIRS)):
            if not len(some):
                continue
            w, i = np.divmod(some, len(which))
            near = edit_distances(windows[w], np.stack([self.items.words[k] for k in which[i]]))
            for k in np.flatnonzero(near <= d):
                key, value = (int(docs[w[k]]), int(which[i[k]])), (int(near[k]), int(starts[w[k]]), m)
                best[key] = min(best.get(key, value), value)


def matches(texts: pa.Array, items: Items, share: float) -> list[tuple[int, int, int, int, int]]:
    """The matches in a few texts."""
    windows = Windows(items, share)
    windows.add(texts)
    return windows.matches()


def _search(docs: DataFrame, items: Items, share: float) -> DataFrame:
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, ids = Windows(items, share), []

        def found() -> Iterator[pa.RecordBatch]:
            rows = windows.matches()
            if rows:
                doc, item, start, m, near = (list(x) for x in zip(*rows))
                columns = [pa.array([ids[i] for i in doc], pa.int64()), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(start, pa.int32()), pa.array(m, pa.int32()), pa.array(near, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names)
            ids.clear()

        for batch, texts in in_slices(batches, "text", SLICE):
            windows.add(texts)
            ids += batch.column(0).to_pylist()
            if windows.held > HELD:
                yield from found()
        yield from found()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def item_blocks(benchmark: DataFrame, words: int = ITEM_BLOCK) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the items, at most ``words`` words at a time (or one longer item)."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    for row in rows.toLocalIterator():  # one partition of the benchmark at a time
        n = len(row["text"].split())
        if texts and size + n > words:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if texts:
        yield ids, texts


def find_items(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block: int = ITEM_BLOCK) -> DataFrame:
    """``docs`` (doc_id, text), ``benchmark`` (item_id, text) -> a row for each document and item
    that it holds, in ``FOUND``, with its nearest window."""
    found = [materialize(_search(docs, Items(ids, texts, share), share), "items-found") for ids, texts in item_blocks(benchmark, block)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], FOUND)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` without the documents that hold an item of ``benchmark``; all columns are kept, whatever their names.
    The ids of those documents are written first, so that the join knows their size: only a small table is
    broadcast, and then no text is shuffled."""
    bad = materialize(find_items(docs, benchmark, share).select(F.col("doc_id").alias("held")).distinct(), "contaminated")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(bad, F.col("row.doc_id").cast("long").eqNullSafe(F.col("held")), "left_anti").select("row.*")
