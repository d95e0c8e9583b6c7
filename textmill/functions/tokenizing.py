"""Ways to cut a text into tokens, for chunkers that count them: by pattern, or by a byte-pair vocabulary."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions import bpe, splitting
from textmill.functions import text as T
from textmill.functions.lifted import PerValue


class Tokens(NamedTuple):
    """``units`` of a text (and of what ``python`` made of ``ask``, if there is one); of units their number, the text of a run (start,
    length) and the texts of all; ``count`` for Python code that needs the number alone."""

    units: Callable[[Column, Column | None], Column]
    size: Callable[[Column], Column]
    run: Callable[[Column, Column, Column], Column]
    each: Callable[[Column], Column]
    count: Callable[[], Callable[[str], int]]
    ask: Callable[[Column], Column] | None = None
    python: PerValue | None = None


BY_PATTERN = Tokens(
    units=lambda text, _: T.tokens(text),
    size=F.size,
    run=lambda u, start, n: F.array_join(F.slice(u, start + 1, n), ""),
    each=lambda u: u,
    count=lambda: splitting.n_tokens,
)


def checked(text: Column, given: bpe.Vocabulary) -> Column:
    """The text; raises if it holds a special string."""
    if given.as_text or not given.special:
        return text
    held = F.lit(False)
    for literal, _ in given.special:
        held = held | F.contains(text, F.lit(literal))
    names = ", ".join(s for s, _ in given.special)
    return F.when(held, F.raise_error(F.lit(f"the text holds a special token ({names}); as_text=True takes it as ordinary text"))).otherwise(text)


def pieces(text: Column, given: bpe.Vocabulary) -> Column:
    """What the vocabulary's pattern finds; white space and classes are those of Unicode."""
    return F.regexp_extract_all(checked(text, given), F.lit("(?U)" + given.pattern), F.lit(0))


def _listed(values: np.ndarray, n: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def ids(given: bpe.Vocabulary) -> PerValue:
    """Lists of pieces -> their ids."""
    return PerValue(lambda lists: _listed(*bpe.merger(given).encode(lists)), "array<int>")


def _ends(given: bpe.Vocabulary) -> PerValue:
    """Lists of pieces -> the byte at which each token ends."""

    def run(lists: pa.Array) -> pa.Array:
        own = bpe.merger(given)
        found, n = own.encode(lists)
        reached = np.cumsum(own.n_bytes[found])
        before = np.concatenate([[0], reached])[np.cumsum(n) - n]
        return _listed(reached - np.repeat(before, n), n)

    return PerValue(run, "array<int>")


def decoded(given: bpe.Vocabulary) -> PerValue:
    """Lists of ids -> the text, with U+FFFD where a character is cut."""
    return PerValue(lambda lists: pa.array([None if x is None else bpe.merger(given).decode(x) for x in lists.to_pylist()], pa.string()), "string")


def byte_pairs(given: bpe.Vocabulary) -> Tokens:
    """Tokens of a vocabulary as byte ranges of the text, so that a run is one slice of its bytes; a character that is cut becomes U+FFFD."""

    def run(u: Column, start: Column, n: Column) -> Column:
        begin = F.when(start > 0, F.get(u["ends"], start - 1)).otherwise(0)
        stop = F.get(u["ends"], F.least(start + n, F.size(u["ends"])) - 1)
        return F.make_valid_utf8(F.substring(u["bytes"], begin + 1, stop - begin).cast("string"))

    return Tokens(
        units=lambda text, ends: F.struct(F.encode(text, "utf-8").alias("bytes"), ends.alias("ends")),
        size=lambda u: F.size(u["ends"]),
        run=run,
        each=lambda u: F.transform(u["ends"], lambda e, i: run(u, i, F.lit(1))),
        count=lambda: bpe.merger(given).count,
        ask=lambda text: pieces(text, given),
        python=_ends(given),
    )


def tokens(tokenizer: Tokens | dict | None) -> Tokens:
    """By pattern if none is given; a dictionary holds the parameters of ``bpe.vocabulary``."""
    if tokenizer is None:
        return BY_PATTERN
    return byte_pairs(bpe.vocabulary(**tokenizer)) if isinstance(tokenizer, dict) else tokenizer
