"""Byte-pair tokens: a text is cut into pieces by the vocabulary's pattern (a Spark expression), and the bytes of each
piece are merged by rank, the lowest first and the leftmost of equal ones, until no neighbours make a token.

Each distinct piece is merged once in a worker: the pieces of a batch are told apart by Arrow, and those not known
yet are merged together, one merge of every piece at a time, as arrays. What is kept is bounded.

A vocabulary is a file of lines with a token in base 64 and its rank, which is its id; its bytes travel with the
job, so executors need no file. Special strings have ids beyond the ranks; a text that holds one raises, unless they are taken as
ordinary text.
"""

from __future__ import annotations

import base64
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Fixed value: the published pattern of the first byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int64).max
LONG = 128  # bytes: longer pieces are merged one by one
MOST_KEPT = 1 << 19
TOGETHER = 32  # new pieces of a text, from which on they are merged as arrays


class Vocabulary(NamedTuple):
    """``data``: the compressed file; ``special``: strings that a text must not hold, with their ids."""

    data: bytes
    pattern: str = PATTERN
    special: tuple[tuple[str, int], ...] = ()
    as_text: bool = False


def vocabulary(path: str, pattern: str = PATTERN, special: dict[str, int] | None = None, as_text: bool = False) -> Vocabulary:
    """The vocabulary in a file of ranks."""
    with open(path, "rb") as f:
        return Vocabulary(zlib.compress(f.read(), 6), pattern, tuple((special or {}).items()), as_text)


class Merger:
    """Merges the bytes of pieces; keeps the ids of those it has seen."""

    def __init__(self, given: Vocabulary):
        lines = (line.split() for line in zlib.decompress(given.data).splitlines())
        self.rank = {base64.b64decode(x[0]): int(x[1]) for x in lines if x}
        self.token = {i: t for t, i in self.rank.items()} | {i: t.encode() for t, i in given.special}
        self.n_bytes = np.zeros(max(self.token, default=0) + 1, dtype=np.int64)
        for i, t in self.token.items():
            self.n_bytes[i] = len(t)
        self.byte = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte < 0).any():
            raise ValueError("a vocabulary needs a token for each byte")
        pairs = {}
        for token, i in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.pieces = regex.compile(given.pattern)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes: dict[str, int] = {}
        self.ids = np.empty(1 << 16, dtype=np.int32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _looked_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), NONE)
        key = a << 32 | b
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.made[k], NONE)

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and how many each has: in each round every piece makes its first merge of least rank."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        ids = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            made = np.full(len(ids), NONE)
            made[:-1] = self._looked_up(ids[:-1], ids[1:])
            made[:-1][piece[:-1] != piece[1:]] = NONE
            begins = np.flatnonzero(np.diff(piece, prepend=-1))
            least = np.minimum.reduceat(made, begins)
            each = np.diff(begins, append=len(ids))
            on = np.repeat(least < NONE, each)
            if not on.all():
                done.append((piece[~on], ids[~on]))
                if not on.any():
                    break
            hit = np.flatnonzero(on & (made == np.repeat(least, each)))
            first = hit[np.flatnonzero(np.diff(piece[hit], prepend=-1))]
            ids[first] = made[first]
            on[first + 1] = False
            ids, piece = ids[on], piece[on]
        if not done:
            return np.empty(0, dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        piece, ids = (np.concatenate(x) for x in zip(*done))
        return ids[np.argsort(piece, kind="stable")], np.bincount(piece, minlength=len(pieces))

    def _alone(self, piece: bytes) -> list[int]:
        """The same for one long piece: merges wait in a heap by rank and place."""
        import heapq

        ids = [int(self.byte[b]) for b in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pairs = self.pairs
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        gone = [False] * len(ids)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j] = r, True
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids) and (m := pairs.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [x for x, dead in zip(ids, gone) if not dead]

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        raw = [p.encode() for p in new]
        short = [k for k, p in enumerate(raw) if len(p) <= LONG]
        flat, n = self._merged([raw[k] for k in short])
        each: list = [None] * len(raw)
        for k, part in zip(short, np.split(flat, np.cumsum(n)[:-1])):
            each[k] = part
        for k, p in enumerate(raw):
            if each[k] is None:
                each[k] = np.array(self._alone(p), dtype=np.int64)
        ids, n = np.concatenate(each).astype(np.int32), np.array([len(x) for x in each])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        first = len(self.known)
        while first + len(new) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[first + 1 : first + len(new) + 1] = self.used + np.cumsum(n)
        self.used += len(ids)
        self.known.update(zip(new, range(first, first + len(new))))

    def encode(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each a list of pieces, one after another, and the number of ids of each text."""
        n_pieces = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
        if len(self.known) + len(pieces) > MOST_KEPT or self.used > MOST_KEPT * 8:
            self.clear()
        self._learn([p for p in pieces if p not in self.known])
        place = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.starts[place + 1] - self.starts[place]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.starts[place] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_pieces)])]
        return ids, np.diff(upto)

    def count(self, text: str) -> int:
        """Tokens of one text, for splitting by length."""
        total, sizes = 0, self.sizes
        found = self.pieces.findall(text)
        if len(found) > 1:  # new pieces of a longer text together
            new = [p for p in dict.fromkeys(found) if p not in sizes]
            if len(new) >= TOGETHER:
                raw = [p.encode() for p in new]
                short = [k for k, p in enumerate(raw) if len(p) <= LONG]
                sizes.update(zip([new[k] for k in short], self._merged([raw[k] for k in short])[1].tolist()))
        for piece in found:
            n = sizes.get(piece)
            if n is None:
                if len(sizes) > MOST_KEPT:
                    sizes.clear()
                n = sizes[piece] = len(self._alone(piece.encode()))
            total += n
        return total

    def decode(self, ids) -> str:
        """The text of ids; what isn't valid UTF-8, as where a character is cut, becomes U+FFFD."""
        return b"".join(self.token[int(i)] for i in ids).decode("utf-8", errors="replace")


_MERGERS: dict[Vocabulary, Merger] = {}


def merger(given: Vocabulary) -> Merger:
    """This worker's merger for a vocabulary, kept from task to task."""
    if given not in _MERGERS:
        _MERGERS[given] = Merger(given)
    return _MERGERS[given]
