"""Subword ids of whole texts, by the ``tokenizers`` library, many texts at a time.

A byte-level BPE never merges across the boundary between a non-space character and a
single blank or line end, so a text is the concatenation of its pieces cut in front of
those. Pieces repeat heavily: each distinct piece goes through the library once per worker
and its ids are looked up afterwards. The ids equal those of encoding the whole text.

The strings of a vocabulary's added tokens (``<|endoftext|>``) become their ids wherever they stand,
as the library does by default; a text that holds one goes through the library whole. With
``as_text`` they are ordinary text.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Two white-space characters in a row, or the separator used below: such texts are cut by ODD_CUT.
ODD = r"[\s\x0b\x85\x1c-\x1e\p{Z}]{2}|\x1f"
ODD_CUT = re.compile(r"(?= \S)")
SAFE = re.compile(r"[ \n]\S.*\S\Z|[ \n]\S\Z", re.S)
SEPARATOR = "\x1f"
JOINED = 2000
MOST_KEPT = 1 << 25
TEXT_BYTES = 2 << 20


def public_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary file of that name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def give_back() -> None:
    """Memory that this process has freed, back to the system: what waits for the next task else counts for the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may be another one
        ctypes.CDLL(None).malloc_trim(0)


class PieceEncoder:
    """Encodes batches of texts; keeps the ids of at most ``max_pieces`` distinct pieces of ``MOST_KEPT``
    characters in all."""

    def __init__(self, path: str, max_pieces: int = 700_000, as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = as_text
        self.added = [] if as_text else sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.max_pieces = max_pieces
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.kept = 0
        self.ids = np.empty(1 << 16, dtype=np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 14, dtype=np.int64)
        self.lengths = np.empty(1 << 14, dtype=np.int32)
        give_back()

    def _keep(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(self.known), len(pieces)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + m > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + m] = lengths
        self.used += len(ids)
        self.known.update(zip(pieces, range(n, n + m)))
        self.kept += sum(map(len, pieces))

    def _encode(self, pieces: list[str]) -> None:
        """Add pieces that are not known yet."""
        safe, alone = [], []
        for p in pieces:
            (safe if SAFE.match(p) else alone).append(p)
        groups = [safe[i : i + JOINED] for i in range(0, len(safe), JOINED)]
        found = self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)
        for group, one in zip(groups, found):
            ids = np.array(one.ids, dtype=np.uint32)
            ends = np.cumsum(np.array([len(p.encode()) for p in group], dtype=np.int64))
            reached = np.cumsum(self.n_bytes[ids])
            at = np.searchsorted(reached, ends)
            if len(ids) and at[-1] == len(ids) - 1 and np.array_equal(reached[at], ends):
                self._keep(group, ids, np.diff(at, prepend=-1))
            else:
                alone += group
        if alone:
            found = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
            each = [one.ids for one in found]
            flat = np.array([i for ids in each for i in ids], dtype=np.uint32)
            self._keep(alone, flat, np.array([len(ids) for ids in each], dtype=np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and the number of ids of each text."""
        if len(texts) == 0:
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        whole = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if odd.any() or whole.any():
            cut = lambda t, o, w: [t] if w else ODD_CUT.split(t) if o else re.split(r"(?=[ \n])", t)
            lists = pa.array([cut(*x) for x in zip(texts.to_pylist(), odd, whole)], pa.large_list(pa.large_string()))
        else:
            cut = pc.replace_substring(texts, " ", SEPARATOR + " ")
            lists = pc.split_pattern(pc.replace_substring(cut, "\n", SEPARATOR + "\n"), SEPARATOR)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
        if len(self.known) + len(pieces) > self.max_pieces or self.kept > MOST_KEPT:
            self.clear()
        new = [p for p in pieces if p not in self.known]
        if new:
            self._encode(new)
        place = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        place = place[coded.indices.to_numpy()]
        lengths = self.lengths[place].astype(np.int64)
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[place] - (ends - lengths), lengths)
        at += np.arange(len(at))
        reached = np.concatenate([[0], ends])[offsets - offsets[0]]
        return self.ids[at], np.diff(reached)


_ENCODERS: dict[tuple[str, int, bool], PieceEncoder] = {}


def encoder(path: str, max_pieces: int = 700_000, as_text: bool = False) -> PieceEncoder:
    """This worker's encoder for a vocabulary file; kept from task to task. Those of a longer chain clear it when they end, so
    that a worker does not hold its pieces while it does other work."""
    key = (path, max_pieces, as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, max_pieces, as_text)
    return _ENCODERS[key]


def in_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = TEXT_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Each batch in slices of about ``most`` bytes of text, with the text column, nulls as empty.
    One text longer than that makes a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
        reached = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = reached[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(reached, before + most, side="right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop
