"""Language-model scores of whole texts (operator 3).

Tokens: words (A-Z in lower case), then one end. ``base_score`` sums log10((c + 1) / (N + V + 1))
with the counts of the training texts. ``score`` is the log10 probability of the same words by
a causal self-attention model over subword ids: each word, with a blank before it, is cut into
the longest pieces among the first ids of a public byte-level vocabulary (its first 256 ids are
the single bytes, so every word has a coding), and the text ends with an id of its own. Texts
are scored in overlapping windows, each id once.

What is learnt, from texts that are not held out: counts of all words; counts of all ids after the
one or two ids before them, which give the prior of the output; and the attention weights, fitted to every
id of every text once, in windows of ``WINDOW`` ids. Texts are dealt to shards in runs of at most ``RUN`` ids, by a
hash of their ids, and are taken in its order: half of them in each of ``ROUNDS`` rounds, in which each shard
fits its windows from the same weights, which are then averaged. So the weights depend on the texts alone, not on how
the input is partitioned.

Scale: texts are read once and become blocks of at most ``BLOCK_WORDS`` words, each with a
dictionary of its distinct words. Word counts are summed over dictionaries: a block's words, ascending by hash, are cut
at the same ``BUCKETS`` ranges of hashes in all blocks, each a row; the rows of a range meet, and its total counts go back
to the blocks, a row for each. So words cross one shuffle, as 8 bytes and a little for the count, and a range holds
1 / ``BUCKETS`` of all dictionaries. Shuffles and kinds of rows that nothing reads any more are let go of. Only the id
counts (at most ``(PAIRS + SIZE) * SIZE`` cells, whatever the input) and averaged weights reach the
driver; the cells of the prior, of bounded number, go to the tasks.

Edge cases: a null text is empty and scores its end alone; a null id counts as training; with no
training text the counts are zero; repeated ids and texts are separate rows; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm import attention
from textmill.llm.attention import END, SIZE, WINDOW
from textmill.llm.runs import sorted_runs
from textmill.llm.storage import discard, materialize, release
from textmill.llm.subwords import give_back, in_slices, public_path
from textmill.llm.vectext import word_hashes, words_of

BLOCK_WORDS = 2_200_000
BUCKETS = 4096  # ranges of word hashes, a power of two
FIT_STRIDE = WINDOW
RUN, MIXED = 64 * WINDOW, 256  # ids of a run; runs whose windows are mixed
SHARD, MOST_SHARDS = 80_000, 4096
STEPS, LEAST_BATCH, BATCH = 1250, 16, 64
ROUNDS = 2
RATES = (0.02, 0.01)
SLICES = 8
LONGEST = 8
CHUNK_WORDS = 200_000
SLICE = 1 << 21
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
CODED = "kind int, block long, doc_id long, held_out boolean, n long, place long, data binary, count long"
TOTALS = "place long, block long, known long, seen long, data binary"


def held_out(doc_id: Column, of: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == remainder, F.lit(False))


class Pieces:
    """Cuts words into the longest pieces among the ids below ``END`` of a byte-level vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # The public byte alphabet: printable bytes stand for themselves, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.tables = {}
        # By the next two bytes: the ids of the first and of both (-1 if none), and the size of the longest piece that begins so.
        self.one, self.two, self.longest = np.zeros(1 << 16, dtype=np.uint16), np.full(1 << 16, -1, dtype=np.int32), np.ones(1 << 16, dtype=np.uint8)
        self.begins_word = np.zeros(SIZE, dtype=bool)
        self.begins_word[END] = True
        for size in range(1, LONGEST + 1):
            rows = sorted((int.from_bytes(bytes(byte_of[c] for c in t), "little"), i) for t, i in vocabulary.items() if i < END and len(t) == size and all(c in byte_of for c in t))
            if rows:
                keys, ids = np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows], dtype=np.uint16)
                self.tables[size] = keys, ids
                if size == 1:
                    self.one.reshape(256, 256)[:, keys.astype(np.int64)] = ids
                else:
                    self.longest[(keys & np.uint64(0xFFFF)).astype(np.int64)] = size
                if size == 2:
                    self.two[keys.astype(np.int64)] = ids
                self.begins_word[ids[keys & np.uint64(0xFF) == 0x20]] = True

    def cut(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words ``data[start:end]`` one after another, and how many each has."""
        rounds, left, at = [], np.arange(len(starts)), starts.copy()
        w8 = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        while len(left):
            here = w8[at]
            room = ends[left] - at
            next_ = (here & np.uint64(0xFFFF)).astype(np.int64)
            ids, two, most = self.one[next_], self.two[next_], np.minimum(self.longest[next_], room)
            both = (two >= 0) & (room > 1)
            ids[both] = two[both]
            took = both + np.int64(1)
            for size, (keys, values) in self.tables.items():  # a longer piece takes the place of a shorter one
                if size > 2:
                    open_ = np.flatnonzero(most >= size)
                    code = here[open_] & np.uint64((1 << 8 * size) - 1)
                    k = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
                    ok = keys[k] == code
                    ids[open_[ok]], took[open_[ok]] = values[k[ok]], size
            rounds.append((left, ids))
            at = at + took
            more = at < ends[left]
            left, at = left[more], at[more]
        n = np.zeros(len(starts), dtype=np.int64)
        for words, _ in rounds:
            n[words] += 1
        begins = np.cumsum(n) - n
        out = np.empty(int(n.sum()), dtype=np.uint16)
        for k, (words, ids) in enumerate(rounds):
            out[begins[words] + k] = ids
        return out, n


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """This worker's table for a vocabulary file; kept from task to task."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of ranges, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Block:
    """Texts as numbers in a dictionary of their distinct words."""

    def __init__(self, cutter: Pieces):
        self.cutter, self.n_words = cutter, 0
        self.ids, self.held, self.texts = [], [], []
        self.hashes, self.coded, self.lengths, self.inverse, self.n_each = [], [], [], [], []

    def add(self, ids: list, held: list, texts: pa.Array) -> None:
        words = words_of(texts)
        codes = word_hashes(words).view(np.int64)
        distinct, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
        # A blank before the word: that of the separator, or the padding in front of the first.
        data = np.concatenate([np.full(1, 0x20, dtype=np.uint8), words.data])
        coded, n = self.cutter.cut(data, words.starts[first], words.ends[first] + 1)
        blank = data[words.starts[first]] != 0x20
        if blank.any():  # the first word of a text that follows another one directly
            again = np.concatenate([np.r_[np.uint8(0x20), words.data[words.starts[i] : words.ends[i]]] for i in first[blank]] + [np.full(8, 0x20, dtype=np.uint8)])
            size = words.ends[first[blank]] - words.starts[first[blank]] + 1
            stop = np.cumsum(size)
            fixed, m = self.cutter.cut(again, stop - size, stop)
            keep = np.repeat(~blank, n)
            every = np.concatenate([coded[keep], fixed])
            n2 = n.copy()
            n2[blank] = m
            begin = np.empty(len(n), dtype=np.int64)
            begin[~blank] = np.cumsum(n[~blank]) - n[~blank]
            begin[blank] = keep.sum() + np.cumsum(m) - m
            coded, n = every[spread(begin, n2)], n2
        self.hashes.append(distinct)
        self.coded.append(coded)
        self.lengths.append(n)
        self.inverse.append(inverse.astype(np.int32))
        self.n_each.append(np.diff(words.docs))
        self.ids += ids
        self.held += held
        self.n_words += len(codes)

    def close(self) -> tuple[np.ndarray, ...]:
        """Per distinct word: hash, count in training texts, ids and number of ids; then for all texts
        the words' numbers, how many words each text has, and whether each word is for training."""
        begins = np.cumsum([0, *(len(h) for h in self.hashes)])
        every, first, where = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        where = where.astype(np.int32)
        numbers = np.concatenate([where[b:][i] for b, i in zip(begins.tolist(), self.inverse)])
        self.hashes, self.inverse = [], []
        n = np.concatenate(self.lengths)
        at = np.cumsum(n) - n
        coded = np.concatenate(self.coded)[spread(at[first], n[first])]
        each = np.concatenate(self.n_each)
        training = np.repeat(~np.array(self.held, dtype=bool), each)
        counts = np.bincount(numbers[training], minlength=len(every))
        return every, counts, coded, n[first], numbers, each


def text_ids(numbers: np.ndarray, each: np.ndarray, coded: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts one after another, each with its END, and where each text ends."""
    begins = np.cumsum(n) - n
    sizes = n[numbers]
    ids = coded[spread(begins[numbers], sizes)]
    upto = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(each)]
    return np.insert(ids, upto, END), upto + np.arange(1, len(each) + 1)


def code(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Rows of five kinds, in ``CODED``. 0: a text, its words as numbers in its block's dictionary.
    1: the words of a block in a range of hashes (``place``), as hashes and counts in training texts, compressed. 2: a count of an id in a context. 3: a run of ids
    of a training text, compressed, led by the id before, with its number of windows. 4: the number of ids and the ids of all words of a block, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=1)
        names = [c.split()[0] for c in CODED.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

        def rows(kind: int, size: int, **columns) -> pa.RecordBatch:
            columns["kind"] = np.full(size, kind, dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(names, types)], names)

        def finish(block: Block, number: int) -> Iterator[pa.RecordBatch]:
            hashes, counts, coded, n, numbers, each = block.close()
            own = np.full(len(each), number)
            upto = np.cumsum(each)
            small = [press.compress(numbers[b - m : b].tobytes()) for b, m in zip(upto, each)]
            yield rows(0, len(each), block=own, doc_id=block.ids, held_out=block.held, n=each, data=small)
            ranges, cuts = word_ranges(hashes)
            spans = list(zip(cuts.tolist(), cuts[1:].tolist()))
            raw, many = memoryview(hashes).cast("B"), memoryview(counts.astype(np.int32)).cast("B")
            yield rows(1, len(ranges), block=own[:1].repeat(len(ranges)), place=ranges, n=np.diff(cuts), data=[press.compress(b"".join((raw[8 * a : 8 * b], many[4 * a : 4 * b]))) for a, b in spans])
            yield rows(4, 1, block=own[:1], n=[len(hashes)], data=[press.compress(n.astype(np.int32).tobytes() + coded.tobytes())])
            learn = np.flatnonzero(~np.array(block.held, dtype=bool))
            cells = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
            for some in np.array_split(learn, max(1, block.n_words // CHUNK_WORDS)):
                if not len(some):
                    continue
                words = spread(upto[some] - each[some], each[some])
                ids, ends = text_ids(numbers[words], each[some], coded, n)
                sizes = np.diff(ends, prepend=0)
                begins = ends - sizes
                last = np.concatenate([[np.uint16(END)], ids[:-1]])
                last[begins] = END  # END in front of each text
                before = np.concatenate([[np.uint16(END)], last[:-1]])
                before[begins] = END
                cells = added(cells, np.unique(attention.cells_of(last, before, ids, block.cutter.begins_word), return_counts=True))
                runs = fit_runs(ids, begins, ends)
                yield rows(3, len(runs), n=[-(-(len(r) - 1) // WINDOW) for r in runs], data=[press.compress(r.tobytes()) for r in runs])
            yield rows(2, len(cells[0]), place=cells[0], count=cells[1])

        block = Block(pieces(tokenizer_path))
        for batch, texts in in_slices(batches, "text", SLICE):
            block.add(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts)
            if block.n_words >= BLOCK_WORDS:
                yield from finish(block, (part << 20) + k)
                block, k = Block(pieces(tokenizer_path)), k + 1
                give_back()
        if block.ids:
            yield from finish(block, (part << 20) + k)
        del block
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, CODED)


def word_ranges(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the ranges of ascending hashes, and where each begins (and the end)."""
    of = hashes >> (64 - (BUCKETS.bit_length() - 1))
    begins = np.flatnonzero(np.diff(of, prepend=np.iinfo(np.int64).min))
    return of[begins], np.append(begins, len(of))


def word_totals(coded: DataFrame) -> DataFrame:
    """Total counts of the words of each block's ranges, in ``TOTALS``, in the order of hashes, compressed; on one row of each
    range also how many of its words were seen in training (``known``) and how often (``seen``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for table, begins in sorted_runs(batches, 1):
            sizes, blobs = table.column("n").to_numpy(), table.column("data").to_pylist()
            known, seen, data = np.zeros(len(blobs), dtype=np.int64), np.zeros(len(blobs), dtype=np.int64), []
            for a, b in zip(begins.tolist(), begins[1:].tolist()):
                plain = [open_.decompress(x) for x in blobs[a:b]]
                hashes = np.concatenate([np.frombuffer(x, dtype=np.int64, count=m) for x, m in zip(plain, sizes[a:b])])
                counts = np.concatenate([np.frombuffer(x, dtype=np.int32, offset=8 * m) for x, m in zip(plain, sizes[a:b])])
                every, where = np.unique(hashes, return_inverse=True)
                total = np.bincount(where, weights=counts, minlength=len(every)).astype(np.int64)
                known[a], seen[a] = (total > 0).sum(), total.sum()
                data += [press.compress(x.tobytes()) for x in np.split(total[where], np.cumsum(sizes[a : b - 1]))]
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("place", "block")), pa.array(known), pa.array(seen), pa.array(data, pa.binary())], ["place", "block", "known", "seen", "data"])

    return coded.where("kind = 1").select("place", "block", "n", "data").repartition("place").sortWithinPartitions("place", "block").mapInArrow(run, TOTALS)


def added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two tables of (cells, counts)."""
    some, where = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return some, np.bincount(where, weights=np.concatenate([a[1], b[1]])).astype(np.int64)


def fit_runs(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """All ids of texts in runs of at most ``RUN``, as int16, each led by the id before it: END before a text's first."""
    led = np.insert(ids, begins, END).astype(np.int16)
    begins, sizes = begins + np.arange(len(begins)), ends - begins
    return [led[a + k : a + min(k + RUN, n) + 1] for a, n in zip(begins.tolist(), sizes.tolist()) for k in range(0, n, RUN)]


def fit_windows(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, led: bool = False) -> np.ndarray:
    """Windows that hold each id of texts once: (n, WINDOW + 1) int16, the first id of each being the one before it, and -1 after a
    text's last. The first windows of all texts come first, then the second ones. ``led``: runs that begin with the id before."""
    if not led:
        ids, begins, ends = np.insert(ids, begins, END), begins + np.arange(len(begins)), ends + np.arange(1, len(ends) + 1)
    per_text = -(-(ends - begins - 1) // FIT_STRIDE)
    number = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    order = np.argsort(number, kind="stable")
    place = (np.repeat(begins, per_text) + number * FIT_STRIDE)[order, None] + np.arange(WINDOW + 1)
    out = ids[np.minimum(place, max(len(ids) - 1, 0))].astype(np.int16)
    out[place >= np.repeat(ends, per_text)[order, None]] = -1
    return out


def mixed_windows(runs: list[bytes]) -> np.ndarray:
    """The windows of compressed runs in an order that parts those of one text."""
    open_ = zstandard.ZstdDecompressor()
    ids = [np.frombuffer(open_.decompress(r), dtype=np.int16) for r in runs]
    ends = np.cumsum([len(x) for x in ids])
    windows = fit_windows(np.concatenate(ids), ends - [len(x) for x in ids], ends, led=True)
    return windows[np.random.default_rng(len(windows)).permutation(len(windows))]


def shards_of(n_windows: int) -> int:
    """How many shards fit side by side; a number of the windows alone."""
    return min(max(1, -(-n_windows // (ROUNDS * SHARD))), MOST_SHARDS)


def batch_of(n_windows: int) -> int:
    """How many windows make a step: so many that a shard takes about ``STEPS``, within bounds."""
    return min(max(n_windows // (ROUNDS * shards_of(n_windows) * STEPS), LEAST_BATCH), BATCH)


def prior_of(given) -> attention.Prior:
    """The tables of a broadcast of counts."""
    cells, counts, path = given.value
    return attention.Prior(np.frombuffer(zstandard.decompress(cells), dtype="<i4").astype(np.int64), np.frombuffer(zstandard.decompress(counts), dtype="<f4"), pieces(path).begins_word)


def fit_weights(windows: DataFrame, n_windows: int, given) -> np.ndarray:
    """``windows`` (data: compressed runs) -> attention weights, averaged over shards in each round; ``given``: a broadcast of
    the prior's counts."""
    flat = attention.fresh()
    bounds = np.linspace(0, attention.N_WEIGHTS, SLICES + 1).astype(int)
    shards, step = shards_of(n_windows), batch_of(n_windows)
    # Other bits than those that order the runs.
    key = F.xxhash64("data")
    spread_ = F.xxhash64(key)
    dealt = windows.select(F.pmod(spread_, F.lit(shards)).cast("int").alias("shard"), F.pmod(F.shiftright(spread_, 20), F.lit(ROUNDS)).alias("round"), key.alias("hash"), "data")
    for r in range(ROUNDS):
        start = flat

        def run(batches: Iterator[pa.RecordBatch], r: int = r, start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            at, fitter, prior, waiting = None, None, prior_of(given), []

            def done() -> pa.RecordBatch:
                if waiting:
                    fitter.add(mixed_windows(waiting))
                    waiting.clear()
                fitter.add(fitter.waiting[:0], last=True)
                return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([at] * SLICES, pa.int32()), pa.array([float(fitter.seen)] * SLICES), pa.array([fitter.flat[a:b].astype(np.float64).tobytes() for a, b in zip(bounds, bounds[1:])])], ["slice", "shard", "weight", "data"])

            for batch in batches:
                shard = batch.column(0).to_numpy()
                cuts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist() + [len(shard)] if len(shard) else []
                for a, b in zip(cuts, cuts[1:]):
                    if shard[a] != at:
                        if fitter is not None:
                            yield done()
                        at, fitter = int(shard[a]), attention.Fitter(start, prior, RATES[r], step)
                    for run_ in batch.column(1).slice(a, b - a).to_pylist():
                        waiting.append(run_)
                        if len(waiting) == MIXED:
                            fitter.add(mixed_windows(waiting))
                            waiting.clear()
            if fitter is not None:
                yield done()
            del fitter, prior
            give_back()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    value = np.frombuffer(row["data"]) * row["weight"]
                    if row["slice"] in sums:
                        sums[row["slice"]][0] += row["weight"]
                        sums[row["slice"]][1] += value
                    else:
                        sums[row["slice"]] = [row["weight"], value]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(v / w).tobytes() for w, v in sums.values()], pa.binary())], ["slice", "data"])

        own = dealt.where(F.col("round") == r).repartition(shards, "shard").sortWithinPartitions("shard", "hash", "data").select("shard", "data")
        fitted = own.mapInArrow(run, "slice int, shard int, weight double, data binary")
        averaged = fitted.repartition(SLICES, "slice").sortWithinPartitions("slice", "shard").mapInArrow(add, "slice int, data binary").collect()
        if averaged:
            flat = np.concatenate([np.frombuffer(x["data"]) for x in sorted(averaged, key=lambda x: x["slice"])]).astype(np.float32)
        del own, fitted, averaged
        release(windows.sparkSession)
    return flat


def score_texts(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text), in ``RESULT``."""
    spark = docs.sparkSession
    path = tokenizer_path or public_path()
    coded = materialize(code(docs, path), "lm-coded", by="kind")
    totals = materialize(word_totals(coded), "lm-totals")
    sums = totals.agg(F.sum("known").alias("v"), F.sum("seen").alias("n")).first()
    discard(coded, part="kind=1")
    release(spark)
    texts = coded.where("kind = 0").agg(F.count(F.when(~F.col("held_out"), 1)).alias("ends")).first()
    n_ends = texts["ends"]
    n_train, distinct = (sums["n"] or 0) + n_ends, (sums["v"] or 0) + (n_ends > 0)
    cells = coded.where("kind = 2").groupBy("place").agg(F.sum("count").alias("n")).select(F.col("place").cast("int").alias("place"), F.col("n").cast("float").alias("n")).toPandas().sort_values("place")
    # Compressed, since most cells are empty; each task makes its tables and lets go of them.
    given = spark.sparkContext.broadcast((zstandard.compress(cells["place"].to_numpy(dtype="<i4").tobytes(), 1), zstandard.compress(cells["n"].to_numpy(dtype="<f4").tobytes(), 1), path))
    del cells
    runs = coded.where("kind = 3")
    n_windows = runs.agg(F.sum("n").alias("n")).first()["n"] or 0
    flat = fit_weights(runs.select("data"), n_windows, given)
    for done in (2, 3):
        discard(coded, part=f"kind={done}")
    scale = np.log10(n_train + distinct + 1)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        scorer = attention.Scorer(flat, prior_of(given))
        right = right.combine_chunks()
        open_ = zstandard.ZstdDecompressor()
        is_word = right.column("size").is_null()
        dictionary, right = right.filter(pc.invert(is_word)), right.filter(is_word).sort_by("place")
        size = dictionary.column("size")[0].as_py() if len(dictionary) else 0
        plain = open_.decompress(dictionary.column("data")[0].as_py()) if size else b""
        n = np.frombuffer(plain, dtype=np.int32, count=size).astype(np.int64)
        pieces_ = np.frombuffer(plain, dtype=np.uint16, offset=4 * size)
        known = np.concatenate([np.empty(0, dtype=np.int64), *(np.frombuffer(open_.decompress(x), dtype=np.int64) for x in right.column("data").to_pylist())])
        logs = np.log10(known + 1)
        each = left.column("n").to_numpy()
        raw = left.column("words").to_pylist()
        base, n_known, score = np.empty(len(each)), np.empty(len(each), dtype=np.int64), np.empty(len(each))
        upto = np.cumsum(each)
        cuts = np.unique(np.searchsorted(upto, np.arange(0, (upto[-1] if len(upto) else 0) + CHUNK_WORDS, CHUNK_WORDS)))
        cuts = np.unique(np.append(cuts, [0, len(each)]))
        for a, b in zip(cuts, cuts[1:]):
            numbers = np.frombuffer(b"".join(open_.decompress(x) if m else b"" for x, m in zip(raw[a:b], each[a:b])), dtype=np.int32)
            ends = np.cumsum(each[a:b])
            for out, values in ((base, logs), (n_known, (known > 0).astype(np.int64))):
                reached = np.concatenate([[0], np.cumsum(values[numbers])])[np.concatenate([[0], ends])]
                out[a:b] = np.diff(reached)
            ids, stops = text_ids(numbers, each[a:b], pieces_, n)
            score[a:b] = np.add.reduceat(scorer.ids(ids, stops), np.concatenate([[0], stops[:-1]]), dtype=np.float64) / np.log(10)
        del scorer
        give_back()
        base += np.log10(n_ends + 1) - (each + 1) * scale
        n_known += n_ends > 0
        return pa.Table.from_arrays([left.column("doc_id"), left.column("held_out"), pa.array(each + 1), pa.array(n_known), pa.array(np.full(len(each), n_train)), pa.array(base), pa.array(score)], names)

    dictionaries = coded.where("kind = 4").select("block", F.lit(None).cast("long").alias("place"), F.col("n").alias("size"), "data")
    counted = totals.select("block", "place", F.lit(None).cast("long").alias("size"), "data").unionByName(dictionaries)
    rows = coded.where("kind = 0").select(F.col("block").alias("of"), "doc_id", "held_out", "n", F.col("data").alias("words"))
    return rows.groupBy("of").cogroup(counted.groupBy("block")).applyInArrow(run, RESULT)
