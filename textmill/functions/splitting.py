"""Helpers that array expressions cannot state: recursive splitting of a text, bag-of-words similarity
and clustering of sentences. They run inside Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from textmill.functions.text import TOKENS

_TOKENS = regex.compile(TOKENS)
SEPARATORS = ("\n\n", "\n", " ", "")  # fixed values, in order of preference


def n_tokens(text: str) -> int:
    return sum(1 for _ in _TOKENS.finditer(text))


def _merge(pieces: list[tuple[str, int]], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces (with their lengths) joined up to ``size``, each chunk starting with up to ``overlap`` of the last."""
    out: list[str] = []
    window: list[tuple[str, int]] = []
    total = 0
    for piece, n in pieces:
        if window and total + n > size:
            out.append("".join(p for p, _ in window).strip())
            while window and (total > overlap or total + n > size):
                total -= window.pop(0)[1]
        window.append((piece, n))
        total += n
    if window:
        out.append("".join(p for p, _ in window).strip())
    return [chunk for chunk in out if chunk]


def recursive_split(text: str, size: int, overlap: int, length: Callable[[str], int] = len, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` where the separators allow it, the coarsest separator first."""
    k = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[k], separators[k + 1 :]
    if separator:
        first, *rest = text.split(separator)
        parts = [first, *(separator + r for r in rest)]
    else:
        parts = list(text)
    out: list[str] = []
    short: list[tuple[str, int]] = []
    for part in (p for p in parts if p):
        n = length(part)
        if n < size:
            short.append((part, n))
            continue
        out += _merge(short, size, overlap)
        short = []
        out += recursive_split(part, size, overlap, length, finer) if finer else [part]
    return out + _merge(short, size, overlap)


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as SQL rounds; ``np.round`` takes a half to the even neighbour."""
    return np.copysign(np.floor(np.abs(values) * 10.0**digits + 0.5) / 10.0**digits, values)


def _counts(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``words`` (a list of words for each sentence) -> sentence, word and count of each pair that occurs, in that order,
    and the number of distinct words."""
    codes = words.flatten().dictionary_encode()
    n = max(len(codes.dictionary), 1)
    sentence = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    pairs, counts = np.unique(sentence * n + codes.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return pairs // n, pairs % n, counts, n


def adjacent_similarities(texts: pa.Array, reach: int = 0) -> pa.Array:
    """For each text (a list of sentences, each a list of words) the cosines of the word counts of each sentence and the
    next, with ``reach`` neighbours on either side. The offline stand-in for a sentence encoder; all
    texts of a batch at once."""
    sentences = texts.flatten()
    per_text = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(per_text)
    text_of = np.repeat(np.arange(len(per_text)), per_text)
    sentence, word, count, n = _counts(sentences)
    rows, total = [sentence], len(sentences)
    for d in range(1, reach + 1):  # a sentence counts for its neighbours in the text as well
        rows += [sentence - d, sentence + d]
    near = np.concatenate(rows)
    own = np.tile(sentence, 2 * reach + 1)
    inside = (near >= 0) & (near < total)
    inside[inside] = text_of[near[inside]] == text_of[own[inside]]
    keys, where = np.unique((near * n + np.tile(word, 2 * reach + 1))[inside], return_inverse=True)
    weight = np.bincount(where, weights=np.tile(count, 2 * reach + 1)[inside], minlength=len(keys))
    row = keys // n
    square = np.bincount(row, weights=weight * weight, minlength=total + 1)
    # The same word in the next sentence, if it is there.
    at = np.minimum(np.searchsorted(keys, keys + n), max(len(keys) - 1, 0))
    both = keys[at] == keys + n if len(keys) else np.zeros(0, dtype=bool)
    dot = np.bincount(row[both], weights=weight[both] * weight[at[both]], minlength=total + 1)
    pairs = np.flatnonzero(text_of[:-1] == text_of[1:]) if total else np.zeros(0, dtype=np.int64)
    both_squares = square[pairs] * square[pairs + 1]
    cosine = np.divide(dot[pairs], np.sqrt(both_squares), out=np.zeros(len(pairs)), where=both_squares > 0)
    lengths = np.maximum(per_text - 1, 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rounded(cosine, 9)))


MATRIX = 1500  # clusters: up to here the similarities of all are held


class Matrix:
    """Clusters by the mean similarities of all pairs."""

    def __init__(self, similar: np.ndarray):
        self.similar, self.size = np.round(similar, 12), np.ones(len(similar))

    def to(self, a: int) -> np.ndarray:
        """Mean similarity of cluster ``a`` to every other; below all others to itself and to those merged away."""
        out = np.where(self.size > 0, self.similar[a], -1)
        out[a] = -1
        return out

    def merge(self, a: int, b: int) -> None:
        """``b`` into ``a``."""
        both = self.size[a] + self.size[b]
        row = np.round((self.size[a] * self.similar[a] + self.size[b] * self.similar[b]) / both, 12)
        self.similar[a], self.similar[:, a] = row, row
        self.size[a], self.size[b] = both, 0


class Centroids:
    """Clusters by the sums of their unit vectors, whose product is the sum of all similarities: no matrix is held."""

    def __init__(self, unit: np.ndarray):
        self.sums, self.size = unit.copy(), np.ones(len(unit))

    def to(self, a: int) -> np.ndarray:
        out = np.round(self.sums @ self.sums[a] / (np.maximum(self.size, 1) * self.size[a]), 12)
        out[self.size == 0] = -1
        out[a] = -1
        return out

    def merge(self, a: int, b: int) -> None:
        self.sums[a] += self.sums[b]
        self.size[a], self.size[b] = self.size[a] + self.size[b], 0


class Bags:
    """The same for many sentences as sparse counts of words: a neighbour is looked for in one pass over the words of all."""

    def __init__(self, sentence: np.ndarray, word: np.ndarray, unit: np.ndarray, n: int, n_words: int):
        self.sentence, self.word, self.unit, self.n_words = sentence, word, unit, n_words
        self.cluster, self.size = np.arange(n), np.ones(n)
        self.begins = np.searchsorted(sentence, np.arange(n + 1))
        self.members: list[list[int]] = [[i] for i in range(n)]

    def to(self, a: int) -> np.ndarray:
        cells = np.concatenate([np.arange(self.begins[i], self.begins[i + 1]) for i in self.members[a]])
        total = np.bincount(self.word[cells], weights=self.unit[cells], minlength=self.n_words)
        out = np.bincount(self.cluster[self.sentence], weights=self.unit * total[self.word], minlength=len(self.size)) / (np.maximum(self.size, 1) * self.size[a])
        out = np.round(out, 12)
        out[self.size == 0] = -1
        out[a] = -1
        return out

    def merge(self, a: int, b: int) -> None:
        self.cluster[self.members[b]] = a
        self.members[a], self.members[b] = self.members[a] + self.members[b], []
        self.size[a], self.size[b] = self.size[a] + self.size[b], 0


def numbered(merges: list[tuple[int, int]], n: int) -> list[int]:
    """Labels of ``n`` sentences after merges, numbered by first appearance."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in merges:
        parent[root(b)] = root(a)
    names: dict[int, int] = {}
    return [names.setdefault(root(i), len(names)) for i in range(n)]


def linked(clusters: Matrix | Centroids | Bags, threshold: float) -> list[int]:
    """Labels by average linkage, merged below the distance ``threshold``, numbered by first appearance. A chain of nearest
    neighbours finds the merges."""
    n = len(clusters.size)
    least = list(range(n))  # a sentence of each cluster
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(clusters.size)[0])]
        while True:
            found = clusters.to(chain[-1])
            b = int(np.argmax(found))
            if len(chain) > 1 and found[chain[-2]] >= found[b]:
                b = chain[-2]
                break
            chain.append(b)
        a = chain[-1]
        merges.append((1 - found[b], least[a], least[b]))
        chain = chain[:-2]
        clusters.merge(a, b)
    return numbered([(a, b) for distance, a, b in merges if distance < threshold], n)


def linked_below(clusters: Matrix | Centroids | Bags, threshold: float) -> list[int] | None:
    """What ``linked`` gives, without the merges at the threshold and beyond: a cluster whose nearest lies there is done with, as means of
    such distances are no smaller. Two that are each other's only nearest are merged in any order of the merges; None where
    others are as near, since ``linked`` then takes the one that its order meets first (but for equal sentences, all of one cluster)."""
    n = len(clusters.size)
    merges, chain, tied, start = [], [], [], 0
    while True:
        if not chain:
            while start < n and clusters.size[start] == 0:
                start += 1
            if start == n:
                return numbered(merges, n)
            chain, tied = [start], [False]
        a = chain[-1]
        found = clusters.to(a)
        b = int(np.argmax(found))
        top = found[b]
        if top < 0 or not 1 - top < threshold:
            clusters.size[a] = 0
            chain.pop()
            tied.pop()
            continue
        tied[-1] = top < 1 and np.count_nonzero(found == top) > 1
        if len(chain) > 1 and found[chain[-2]] >= top:
            if tied[-1] or tied[-2]:
                return None
            merges.append((a, chain[-2]))
            clusters.merge(a, chain[-2])
            chain, tied = chain[:-2], tied[:-2]
        else:
            chain.append(b)
            tied.append(False)


def topic_labels(words: pa.Array, threshold: float) -> list[int]:
    """Clusters of sentences (each a list of words) by average linkage over the cosine distance of their word counts."""
    n = len(words)
    sentence, word, count, n_words = _counts(words)
    unit = count / np.sqrt(np.bincount(sentence, weights=count * count, minlength=n))[sentence]
    if n > MATRIX:
        bags = lambda: Bags(sentence, word, unit, n, n_words)
        return linked_below(bags(), threshold) or linked(bags(), threshold)
    similar = np.zeros((n, n))
    order = np.argsort(word, kind="stable")
    for some in np.array_split(np.arange(n_words), max(1, n_words // 500)):  # some words at a time
        if not len(some):
            continue
        a, b = np.searchsorted(word[order], [some[0], some[-1] + 1])
        cells = order[a:b]
        part = np.zeros((n, len(some)))
        part[sentence[cells], word[cells] - some[0]] = unit[cells]
        similar += part @ part.T
    # Sentences that are near no other are clusters of their own.
    near = np.round(similar, 12)
    np.fill_diagonal(near, -1)
    kept = np.flatnonzero(1 - near.max(axis=1, initial=-1) < threshold)
    labels = np.arange(n) + n
    found = linked_below(Matrix(similar[np.ix_(kept, kept)]), threshold)
    if found is None:
        return linked(Matrix(similar), threshold)
    labels[kept] = found
    names: dict[int, int] = {}
    return [names.setdefault(x, len(names)) for x in labels.tolist()]
