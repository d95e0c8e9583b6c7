"""Words and their hashes for many texts at once, as numpy arrays over the UTF-8 bytes.

Words are runs of bytes other than the six ASCII white-space characters, A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words(NamedTuple):
    """``data``: lower-case bytes, one blank between the words of a text, padded at the end;
    word ``i`` is ``data[starts[i]:ends[i]]``; text ``d`` has words ``docs[d]`` to ``docs[d + 1] - 1``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    """The words of a large_string array without nulls; with ``lower`` A-Z in lower case."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[first:last]
    bounds = offsets - first
    space = SPACE[raw]
    apart = np.ones(len(raw) + 1, dtype=bool)  # position i: byte i - 1 and byte i belong to different words
    apart[1:-1] = space[:-1] | space[1:]
    apart[bounds] = True
    starts = np.flatnonzero(~space & apart[:-1])
    ends = np.flatnonzero(~space & apart[1:]) + 1
    del apart
    docs = np.searchsorted(starts, bounds)
    keep = ~space
    inner = ends[ends < len(raw)]
    blank = np.zeros(len(ends), dtype=bool)  # whether a blank follows the word
    blank[: len(inner)] = space[inner]
    keep[inner] = True
    data = np.full(int(keep.sum()) + 40, 0x20, dtype=np.uint8)
    data[: len(data) - 40] = np.where(space, 0x20, LOWER[raw] if lower else raw)[keep]
    lengths = ends - starts
    new_ends = np.cumsum(lengths + blank) - blank
    return Words(data, new_ends - lengths, new_ends, docs)


def parts(texts: pa.Array, overlap: int, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """A slice of texts as it is, unless it is one text of more than ``most`` bytes: that comes in parts cut at
    white space, so that the arrays made of it stay small. Each part but the first begins with the last
    ``overlap`` words of the one before, so every run of ``overlap + 1`` words lies in exactly one part. With
    each part comes the number of words of the text before it. A text whose first part has no such run,
    because its words are so long, stays whole."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + 2] if len(texts) == 1 else np.zeros(2, dtype=np.int64)
    if offsets[1] - offsets[0] <= most:
        yield 0, texts
        return
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[int(offsets[0]) : int(offsets[1])]
    begin, stop, before = 0, 0, 0
    while stop < len(raw):
        stop = min(stop + most, len(raw))
        while stop < len(raw) and not SPACE[raw[stop]]:
            blanks = np.flatnonzero(SPACE[raw[stop : stop + 4096]])
            stop = min(stop + 4096, len(raw)) if not len(blanks) else stop + int(blanks[0])
        here = raw[begin:stop]
        space = SPACE[here]
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if len(starts) > overlap:
            yield before, pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(here)], dtype=np.int64)), pa.py_buffer(here)])
        elif begin == 0:
            yield 0, texts
            return
        again = min(overlap, len(starts))
        before += len(starts) - again
        begin = begin + int(starts[len(starts) - again]) if again else stop


def windows(docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``n`` words, in a shorter text of all its words: first and last word of each run,
    and where each text's runs begin (one more than the texts)."""
    counts = np.diff(docs)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(runs)])
    first = np.repeat(docs[:-1] - begins[:-1], runs) + np.arange(begins[-1])
    last = first + np.repeat(np.minimum(counts, n) - 1, runs)
    return first, last, begins


# The constants of the public 64-bit xxHash.
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << U64(k)) | (x >> U64(64 - k))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many byte ranges of ``data``, which has at least 8 bytes after the last of them."""
    n = len(starts)
    out = np.empty(n, dtype=U64)
    if n == 0:
        return out
    order = np.argsort(lengths, kind="stable")
    at, size = starts[order], lengths[order]
    # Unaligned words at every byte position, without a copy.
    w8 = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    w4 = np.ndarray((len(data) - 3,), dtype="<u4", buffer=data, strides=(1,))
    with np.errstate(over="ignore"):
        s = U64(seed)
        h = np.full(n, s + P5, dtype=U64)
        done = np.zeros(n, dtype=np.int64)
        big = int(np.searchsorted(size, 32))
        if big < n:
            stripes = size[big:] // 32
            v = [np.full(n - big, x, dtype=U64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            for k in range(int(stripes[-1])):
                i = int(np.searchsorted(stripes, k + 1))
                base = at[big + i :] + 32 * k
                for j in range(4):
                    v[j][i:] = _round(v[j][i:], w8[base + 8 * j])
            m = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                m = (m ^ _round(U64(0), x)) * P1 + P4
            h[big:] = m
            done[big:] = 32 * stripes
        h += size.astype(U64)
        while True:
            i = np.flatnonzero(size - done >= 8)
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ _round(U64(0), w8[at[i] + done[i]]), 27) * P1 + P4
            done[i] += 8
        i = np.flatnonzero(size - done >= 4)
        h[i] = _rotl(h[i] ^ (w4[at[i] + done[i]].astype(U64) * P1), 23) * P2 + P3
        done[i] += 4
        while True:
            i = np.flatnonzero(size > done)
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ (data[at[i] + done[i]].astype(U64) * P5), 11) * P1
            done[i] += 1
        h ^= h >> U64(33)
        h *= P2
        h ^= h >> U64(29)
        h *= P3
        h ^= h >> U64(32)
    out[order] = h
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BASE = 0x9E3779B97F4A7C15 | 1
PART = 1 << 18


def _powers(x: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(PART + 1, x, dtype=U64)
        p[0] = 1
        return np.cumprod(p, dtype=U64)


UP, DOWN = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, then mixed. Worked out over ``PART`` bytes at
    a time, so that the sums stay small whatever the length of a text."""
    h, lengths = np.empty(len(words.starts), dtype=U64), words.ends - words.starts

    def sums(a: int, b: int) -> np.ndarray:
        out = np.zeros(b - a + 1, dtype=U64)
        np.cumsum((words.data[a:b].astype(U64) + U64(1)) * UP[: b - a], out=out[1:])
        return out

    i = 0
    with np.errstate(over="ignore"):
        while i < len(h):
            a = int(words.starts[i])
            j = int(np.searchsorted(words.ends, a + PART, side="right"))
            if j > i:
                s = sums(a, int(words.ends[j - 1]))
                h[i:j] = (s[words.ends[i:j] - a] - s[words.starts[i:j] - a]) * DOWN[words.starts[i:j] - a]
            else:  # one word longer than a part
                j, total = i + 1, 0
                for k in range(a, int(words.ends[i]), PART):
                    total += int(sums(k, min(k + PART, int(words.ends[i])))[-1]) * pow(BASE, k - a, 1 << 64)
                h[i] = total & (1 << 64) - 1
            i = j
        return mix(h + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))
