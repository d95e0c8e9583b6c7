"""Exact token counts at every prefix of a text, without encoding it again (operator 11).

For a vocabulary of byte-pair merges over words (white space dropped, a mark at each word's end).
Every prefix of a word has one last token: the one token that ends there and whose neighbour on the
left, the last token of what comes before it, would not have merged with it. So one pass over the
ends of a word gives the last token and the number of tokens at every prefix, from those at shorter
ones (``PrefixCounter``). Two tokens may be neighbours if no merge across their boundary comes up
while both of its sides are there; the tree of merges of either token tells when they are. All
words of a batch advance together, an end at a time.

A text is the row of its words, so its count at any place is the sum over the words before and the
count at a prefix of the word that is cut. ``count`` gives totals; ``prefixes`` stores the counts at
all places of each text, from which ``tokens_before`` and ``longest_prefix`` answer how many tokens a
beginning has and how long a beginning fits a budget, without the text.

Scale: a scan, no shuffle. Each distinct piece between blanks is counted once in a worker (which
keeps a bounded number of them).

Edge cases: a null text is empty and has no tokens; the strings of special tokens inside a text count as one
token each, as the library does by default; a text of any length is taken whole, and one without
blanks costs time in proportion to its length (pieces that are not in composed form, or end in a special string,
cost the square of their length in ``prefixes``); repeated ids and texts are rows of their own; a null id stays
null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from textmill.llm.subwords import in_slices, public_path

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
NEVER = 1 << 30
LONG = 64  # bytes: longer words go one by one
GROUP = 1 << 17  # bytes of words that advance together
MOST_KEPT = 1 << 20
COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
STORED = "doc_id long, n_chars long, n_tokens long, counts binary"
PIECE = re.compile(r"[^\x20\x09-\x0D]+")


class PrefixCounter:
    """Token counts at the prefixes of words, pieces (what stands between blanks) and texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)  # for its normal form, and its words, of distinct pieces
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not self.end:
            raise ValueError("a vocabulary of merges with a mark at the end of words is needed")
        self._tables(model)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = set(special)
        self.at_special = re.compile("|".join(f"({re.escape(t)})" for t in special) or r"(?!)")
        self.upto_special = re.compile(rf"(?s).*?(?:{'|'.join(re.escape(t) for t in special) or r'(?!)'})|.+")
        self.clear()

    def _tables(self, model: dict) -> None:
        """The merges as arrays over token numbers, and the tokens as two tries in one: with and without the mark."""
        number = model["vocab"]
        # The public byte alphabet: printable bytes stand for themselves, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.byte_of = {**{b: chr(b) for b in plain}, **{256 + i: chr(b) for i, b in enumerate(others)}}
        size = max(number.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank, self.left, self.right = (np.full(size, -1, dtype=np.int64) for _ in range(3))
        keys = np.array([number[a] << 32 | number[b] for a, b in pairs], dtype=np.int64)
        made = np.array([number[a + b] for a, b in pairs], dtype=np.int64)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(pairs)), keys >> 32, keys & 0xFFFFFFFF
        order = np.argsort(keys)
        self.pairs, self.ranks = keys[order], order
        if len(np.unique(made)) < len(made) or (np.maximum(self.rank[self.left[made]], self.rank[self.right[made]]) >= self.rank[made]).any():
            raise ValueError("each token must come from one merge, of tokens that come earlier")
        # A token counts if its own merges make it: nothing across its last merge comes up before.
        good = np.ones(size, dtype=bool)
        good[made] = self.crossing(self.left[made], self.right[made]) == self.rank[made]
        for t in made:  # in order of rank
            good[t] &= good[self.left[t]] and good[self.right[t]]
        children: dict[int, int] = {}
        inner, final = [-1], [-1]
        for token, i in number.items():
            if not good[i]:
                continue
            closed = token.endswith(self.end)
            node = 0
            for byte in self._bytes(token.removesuffix(self.end) if closed else token):
                node = children.setdefault(node << 8 | byte, len(inner))
                if node == len(inner):
                    inner.append(-1)
                    final.append(-1)
            (final if closed else inner)[node] = i
        self.children, self.inner_of, self.final_of = children, inner, final
        edges = np.array(sorted(children), dtype=np.int64)
        self.edges, self.next = edges, np.array([children[int(e)] for e in edges], dtype=np.int64)
        self.inner, self.final = np.array(inner, dtype=np.int64), np.array(final, dtype=np.int64)
        self.one_by_one = self.rank.tolist(), self.left.tolist(), self.right.tolist(), dict(zip(self.pairs.tolist(), self.ranks.tolist()))

    def _bytes(self, mapped: str) -> bytes:
        return mapped.translate(self.byte_of).encode("latin-1")

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {}

    def crossing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least rank of a merge across the boundary of tokens ``a`` and ``b`` that comes up while both its sides are there, or
        ``NEVER``. The sides are followed back in time: the one that was made last is taken apart."""
        a, b = a.copy(), b.copy()
        out = np.full(len(a), NEVER, dtype=np.int64)
        # Ranks at which a side goes into a larger one. Equal merges go from left to right, hence the "or equal" on the right.
        gone_a, gone_b = out.copy(), out.copy()
        at = np.arange(len(a))
        while len(at):
            x, y = a[at], b[at]
            key = x << 32 | y
            k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            r = np.where(self.pairs[k] == key, self.ranks[k], NEVER)
            r[(r >= gone_a[at]) | (r > gone_b[at])] = NEVER
            out[at] = np.minimum(out[at], r)
            from_a = self.rank[x] > self.rank[y]
            open_ = from_a | (self.rank[y] >= 0)
            one, other = at[from_a], at[~from_a & open_]
            gone_a[one], a[one] = self.rank[a[one]], self.right[a[one]]
            gone_b[other], b[other] = self.rank[b[other]], self.left[b[other]]
            at = at[open_]
        return out

    def _beside(self, a: int, b: int) -> bool:
        """Whether ``crossing`` of two tokens is ``NEVER``, for one pair."""
        rank, left, right, pairs = self.one_by_one
        gone_a = gone_b = NEVER
        while True:
            r = pairs.get(a << 32 | b, NEVER)
            if r < gone_a and r <= gone_b:
                return False
            if rank[a] > rank[b]:
                gone_a, a = rank[a], right[a]
            elif rank[b] >= 0:
                gone_b, b = rank[b], left[b]
            else:
                return True

    def counts(self, words: list[bytes]) -> list[np.ndarray]:
        """Of each word the tokens of every prefix, taken as a word."""
        out: list = [None] * len(words)
        group, held = [], 0
        for k, word in enumerate(words):
            if len(word) > LONG:
                out[k] = self._alone(word)
                continue
            group.append(k)
            held += len(word)
            if held > GROUP:
                self._together(words, group, out)
                group, held = [], 0
        if group:
            self._together(words, group, out)
        return out

    def _together(self, words: list[bytes], group: list[int], out: list) -> None:
        sizes = np.array([len(words[k]) for k in group])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words[k] for k in group), dtype=np.uint8).astype(np.int64)
        n = len(data)
        begin, left = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes) - np.arange(n)
        at, node, found = np.arange(n), np.zeros(n, dtype=np.int64), []
        for size in range(1, LONG + 1):
            code = node << 8 | data[at + size - 1]
            k = np.minimum(np.searchsorted(self.edges, code), len(self.edges) - 1)
            hit = self.edges[k] == code
            at, node = at[hit], self.next[k[hit]]
            found.append((at, at + size - 1, self.inner[node], self.final[node]))
            on = left[at] > size
            at, node = at[on], node[on]
            if not len(at):
                break
        start, stop, inner, final = (np.concatenate(x) for x in zip(*found))
        wave = stop - begin[stop]
        order = np.argsort(wave, kind="stable")
        start, stop, inner, final, wave = start[order], stop[order], inner[order], final[order], wave[order]
        last, upto, closed = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        cuts = np.searchsorted(wave, np.arange(int(sizes.max(initial=0)) + 1))
        for a, b in zip(cuts, cuts[1:]):
            s, e = start[a:b], stop[a:b]
            first = s == begin[s]
            before = np.where(first, -1, last[s - 1])
            many = np.where(first, 0, upto[s - 1]) + 1
            for token, count in ((inner[a:b], upto), (final[a:b], closed)):
                ok = token >= 0
                ask = np.flatnonzero(ok & ~first)
                ok[ask] = self.crossing(before[ask], token[ask]) == NEVER
                count[e[ok]] = many[ok]
                if count is upto:
                    last[e[ok]] = token[ok]
        for k, a, b in zip(group, ends - sizes, ends):
            out[k] = closed[a:b]

    def _alone(self, word: bytes) -> np.ndarray:
        """The same for one long word, from start to start."""
        last, upto, closed = [-1] * (len(word) + 1), [0] * (len(word) + 1), np.zeros(len(word), dtype=np.int32)
        children, inner, final, beside = self.children, self.inner_of, self.final_of, self._beside
        for i in range(len(word)):
            node, before, many = 0, last[i], upto[i] + 1
            for j in range(i, len(word)):
                node = children.get(node << 8 | word[j])
                if node is None:
                    break
                if inner[node] >= 0 and (i == 0 or beside(before, inner[node])):
                    last[j + 1], upto[j + 1] = inner[node], many
                if final[node] >= 0 and (i == 0 or beside(before, final[node])):
                    closed[j] = many
        return closed

    def _split(self, piece: str) -> list[bytes]:
        """The words of a piece without special strings, as the vocabulary's own rules find them."""
        if piece.isascii() and piece.isalpha():
            return [piece.lower().encode()]
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(piece))
        return [self._bytes(mapped) for mapped, _ in found]

    def totals(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each whole piece."""
        if len(self.pieces) > MOST_KEPT or len(self.words) > MOST_KEPT:
            self.clear()
        new: dict[str, tuple[int, list[bytes]]] = {}
        for piece in pieces:
            if piece not in self.pieces and piece not in new:
                parts = [p for p in self.at_special.split(piece) if p] if "<" in piece else [piece]
                words = [w for p in parts if p not in self.special for w in self._split(p)]
                new[piece] = sum(p in self.special for p in parts), words
        missing = list({w: None for _, words in new.values() for w in words if w not in self.words})
        self.words.update((w, int(c[-1])) for w, c in zip(missing, self.counts(missing)))
        self.pieces.update((p, n + sum(self.words[w] for w in words)) for p, (n, words) in new.items())
        return np.fromiter((self.pieces[p] for p in pieces), dtype=np.int64, count=len(pieces))

    def piece_counts(self, piece: str) -> np.ndarray:
        """Tokens of every prefix of a piece: one number for each character."""
        out, base = [], 0
        for part in self.upto_special.findall(piece):
            own = self._part_counts(part)
            out.append(own + base)
            base += int(own[-1])
        return np.concatenate(out)

    def _part_counts(self, part: str) -> np.ndarray:
        form = self.tokenizer.normalizer.normalize_str
        each = [form(c) for c in part]
        if self.at_special.search(part) or not unicodedata.is_normalized("NFC", part) or "".join(each) != form(part):
            return self.totals([part[: i + 1] for i in range(len(part))])
        plain = "".join(each)
        at = np.zeros(len(plain) + 1, dtype=np.int64)
        base, reached = 0, 0
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)
        for (mapped, (a, b)), own in zip(found, self.counts([self._bytes(m) for m, _ in found])):
            at[reached + 1 : a + 1] = base
            ends = np.cumsum([len(c.encode()) for c in plain[a:b]])
            at[a + 1 : b + 1] = base + own[ends - 1]
            if b - a == 3 and plain[a] == "'":  # a shortened word of two letters: without the second, a mark and a letter
                at[a + 2] = base + int(self.totals(["'", plain[a + 1]]).sum()) if plain[a + 1].isalpha() else at[a + 2]
            base, reached = base + int(own[-1]), b
        at[reached + 1 :] = base
        return at[np.cumsum([len(c) for c in each])]

    def text_counts(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text, the empty one first."""
        out = np.zeros(len(text) + 1, dtype=np.int64)
        base, reached = 0, 0
        for m in PIECE.finditer(text):
            own = self.piece_counts(m.group())
            out[reached : m.start() + 1] = base
            out[m.start() + 1 : m.end() + 1] = base + own
            base, reached = base + int(own[-1]), m.end()
        out[reached:] = base
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """This worker's counter for a vocabulary file; kept from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``docs`` (doc_id, text) -> ``COUNTED``: bytes and tokens of each text, and whether they are more than ``limit``."""
    path = path or public_path(VOCABULARY)
    names = [c.split()[0] for c in COUNTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch, texts in in_slices(batches, "text"):
            found = pc.ascii_split_whitespace(texts)
            offsets = found.offsets.to_numpy().astype(np.int64)
            coded = found.flatten().dictionary_encode()
            each = own.totals(coded.dictionary.to_pylist())
            reached = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])])
            n = np.diff(reached[offsets - offsets[0]])
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n, pa.int64()), pa.array(n > limit)], names)
        own.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTED)


def prefixes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> ``STORED``: ``counts`` holds the tokens of every prefix, as compressed differences from each place to the next."""
    path = path or public_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press = counter(path), zstandard.ZstdCompressor(level=3)
        for batch, texts in in_slices(batches, "text"):
            found = [own.text_counts(t) for t in texts.to_pylist()]
            data = [press.compress(np.diff(c).astype("<i2").tobytes()) for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) - 1 for c in found]), pa.array([int(c[-1]) for c in found]), pa.array(data, pa.binary())], ["doc_id", "n_chars", "n_tokens", "counts"])
        own.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, STORED)


def _opened(data: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.frombuffer(zstandard.decompress(data), dtype="<i2"))]).astype(np.int64)


@F.arrow_udf(LongType())
def tokens_before(counts: pa.Array, place: pa.Array) -> pa.Array:
    """Tokens of the first ``place`` characters of a text, from its stored ``counts``; a place beyond its end is its end."""
    rows = zip(counts.to_pylist(), place.to_pylist())
    return pa.array([None if c is None or p is None else int((v := _opened(c))[min(max(p, 0), len(v) - 1)]) for c, p in rows], pa.int64())


@F.arrow_udf(LongType())
def longest_prefix(counts: pa.Array, budget: pa.Array) -> pa.Array:
    """Characters of the longest prefix that has at most ``budget`` tokens (which may fall from one place to the next)."""
    rows = zip(counts.to_pylist(), budget.to_pylist())
    return pa.array([None if c is None or b is None else int(np.flatnonzero(_opened(c) <= max(b, 0))[-1]) for c, b in rows], pa.int64())


def truncated(docs: DataFrame, stored: DataFrame, budget: int) -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``budget`` tokens, by what ``prefixes`` stored of it; ids must be unique."""
    room = stored.select("doc_id", longest_prefix("counts", F.lit(budget)).cast("int").alias("_room"))
    return docs.join(room, "doc_id", "left").withColumn("text", F.substring("text", F.lit(1), F.coalesce("_room", F.lit(0)))).drop("_room")
