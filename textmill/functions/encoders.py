"""Sentence encoders inside chunkers: similarities of neighbours, and topics.

An encoder takes a list of texts and gives a matrix with a row for each. It is made once in a worker by a factory: a callable, or the
name of one as ``module:attribute``, so that a specification in JSON can name it. It gets the distinct sentences of a whole
batch of documents in one call.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textmill.functions import splitting

Encoder = Callable[[list[str]], np.ndarray]
Factory = Callable[[], Encoder] | str
_MADE: dict = {}


def made(factory: Factory) -> Encoder:
    """This worker's encoder of a factory."""
    if factory not in _MADE:
        if isinstance(factory, str):
            module, _, name = factory.partition(":")
            _MADE[factory] = getattr(importlib.import_module(module), name)()
        else:
            _MADE[factory] = factory()
    return _MADE[factory]


def vectors(factory: Factory, texts: pa.Array) -> np.ndarray:
    """A row of length one (or zero) for each text; each distinct text is encoded once, all in one call."""
    coded = texts.dictionary_encode()
    if not len(coded):
        return np.zeros((0, 1))
    found = np.asarray(made(factory)(coded.dictionary.to_pylist()), dtype=np.float64)
    norm = np.linalg.norm(found, axis=1, keepdims=True)
    found = np.divide(found, norm, out=np.zeros_like(found), where=norm > 0)
    return found[coded.indices.to_numpy(zero_copy_only=False)]


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def adjacent(factory: Factory, reach: int) -> Callable[[pa.Array], pa.Array]:
    """Lists of sentences -> the cosines of each sentence and the next; with ``reach`` a sentence is encoded together with so many
    neighbours on either side."""

    def run(lists: pa.Array) -> pa.Array:
        sizes, sentences = _sizes(lists), lists.flatten()
        ends = np.cumsum(sizes)
        if reach:
            plain = sentences.to_pylist()
            around = [" ".join(plain[max(a, i - reach) : min(b, i + reach + 1)]) for a, b in zip(ends - sizes, ends) for i in range(a, b)]
            sentences = pa.array(around, pa.string())
        unit = vectors(factory, sentences)
        cosine = np.einsum("ij,ij->i", unit[:-1], unit[1:]) if len(unit) else np.zeros(0)
        text = np.repeat(np.arange(len(sizes)), sizes)
        inside = text[:-1] == text[1:]
        offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes - 1, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(splitting.rounded(cosine[inside], 9)))

    return run


def topics(factory: Factory, threshold: float) -> Callable[[pa.Array], pa.Array]:
    """Lists of sentences -> their clusters by average linkage over cosine distance, numbered by first appearance."""

    def run(lists: pa.Array) -> pa.Array:
        sizes = _sizes(lists)
        unit = vectors(factory, lists.flatten())
        ends = np.cumsum(sizes)
        labels = [splitting.linked(splitting.Centroids(unit[a:b]), threshold) for a, b in zip(ends - sizes, ends)]
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array([x for own in labels for x in own], pa.int32()))

    return run
