"""What a chunker is, and how chunkers are put together.

A chunker turns a text into an array of chunks by up to three steps, each computed once: an expression over the text, a Python function over a whole
batch, and an expression that makes the chunks of both. Applied to a table (``add``) each step is a column of its own, without a shuffle. Applied
to arrays of texts (``add_many``) the expressions go into lambdas and the Python function takes the arrays whole, so any chunker
can cut what another has made (``Hybrid``), also on a stream.

A chunk is a struct: ``text``; ``metadata`` (JSON); ``doc_suffix`` and ``id_suffix``, which
follow the document's id in the chunk's ``doc_id`` and ``chunk_id``. A null or empty text has
no chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.lifted import PerValue

CHUNKS = "array<struct<text string, metadata string, doc_suffix string, id_suffix string>>"
_NUMBERS = count()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a plain reuse would be computed at each use."""
    return F.get(F.transform(F.array(value), body), 0)


def rounded(value: Column, digits: int) -> Column:
    """Rounded half away from zero as a product with a power of ten, as SQL does it. ``F.round`` goes by the shortest decimal, which is another
    number where a value lies within an ulp of a half."""
    return F.round(value * 10.0**digits, 0) / 10.0**digits


def now() -> Column:
    """An executor's clock in nanoseconds, read when this part of an expression is computed."""
    return F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")


def step(df: DataFrame, out: str, over: Column, body: Callable[[Column], Column], spent: str | None) -> DataFrame:
    """``df`` with a step of a chunker as a column. The nanoseconds it took are added to the column ``spent``: all of it is computed
    inside a lambda, between two looks at the clock, since Spark may compute parts of a plain expression beforehand."""
    if spent is None:
        return df.withColumn(out, body(over))
    df = df.withColumn(out, let(over, lambda x: F.struct(now().alias("began"), body(x).alias("v"), now().alias("ended"))))
    return df.withColumns({spent: F.col(spent) + F.col(out)["ended"] - F.col(out)["began"], out: F.col(out)["v"]})


def python_step(df: DataFrame, out: str, python: PerValue, asked: Column, spent: str | None) -> DataFrame:
    return python.add(df, asked, out) if spent is None else python.add_timed(df, asked, out, spent)


class Given(NamedTuple):
    """What the last step of a chunker gets: the text, what was prepared of it, what the Python function found, the document's id."""

    text: Column
    prepared: Column | None
    found: Column | None
    doc: Column


def _name(kind: str) -> str:
    return f"_{kind}_{next(_NUMBERS)}"


class Chunker:
    def __init__(self, body: Callable[[Given], Column], prepare: Callable[[Column], Column] | None = None, python: PerValue | None = None, ask: Callable[[Column, Column | None], Column] | None = None):
        """``prepare``: of the text; ``ask``: of the text and what was prepared, for ``python``; ``body``: the chunks."""
        self.body, self.prepare, self.python, self.ask = body, prepare, python, ask

    def __call__(self, text: Column, doc: Column | None = None) -> Column:
        """The chunks of a text as one expression; what is prepared is computed for the Python function and again for the body."""
        doc = F.col("doc_id") if doc is None else doc
        found = F.lit(None)
        if self.python:
            found = self.python.one(let(self.prepare(text), lambda p: self.ask(text, p)) if self.prepare else self.ask(text, None))
        once = F.struct(text.alias("t"), (self.prepare(text) if self.prepare else F.lit(None)).alias("p"), found.alias("f"))
        return let(once, lambda x: self.body(Given(x["t"], x["p"], x["f"], doc)))

    def add(self, df: DataFrame, text: str, doc: str, out: str, spent: str | None = None) -> DataFrame:
        """``df`` with the chunks of the column ``text``. ``spent`` names a column of nanoseconds to which the time of each step is added."""
        prepared, found = _name("prepared"), _name("found")
        null = F.lit(None)
        p = f = None
        if self.prepare:
            df = step(df, prepared, F.col(text), self.prepare, spent)
            p = F.col(prepared)
        if self.python:
            df = python_step(df, found, self.python, self.ask(F.col(text), p), spent)
            f = F.col(found)
        once = F.struct(F.col(text).alias("t"), (null if p is None else p).alias("p"), (null if f is None else f).alias("f"), F.col(doc).alias("d"))
        return step(df, out, once, lambda v: let(v, lambda x: self.body(Given(x["t"], x["p"], x["f"], x["d"]))), spent).drop(prepared, found)

    def add_many(self, df: DataFrame, texts: str, docs: str, out: str, spent: str | None = None) -> DataFrame:
        """``df`` with the chunks of each text of the array ``texts``, which belong to the ids of the array ``docs``."""
        prepared, found = _name("prepared"), _name("found")
        fields = {"t": F.col(texts), "d": F.col(docs)}
        if self.prepare:
            df = step(df, prepared, F.col(texts), lambda many: F.transform(many, lambda t: self.prepare(t)), spent)
            fields["p"] = F.col(prepared)
        if self.python:
            asked = F.arrays_zip(*(v.alias(k) for k, v in fields.items() if k != "d"))
            df = python_step(df, found, self.python.over_lists(), F.transform(asked, lambda x: self.ask(x["t"], x["p"] if self.prepare else None)), spent)
            fields["f"] = F.col(found)
        every = F.arrays_zip(*(v.alias(k) for k, v in fields.items()))
        made = lambda many: F.transform(many, lambda x: self.body(Given(x["t"], x["p"] if self.prepare else None, x["f"] if self.python else None, x["d"])))
        return step(df, out, every, made, spent).drop(prepared, found)


class Hybrid(Chunker):
    """The primary's chunks; those of more than ``max_primary_size`` characters are cut by the secondary, with the primary's chunk as document."""

    def __init__(self, primary: Chunker, secondary: Chunker, max_primary_size: int = 1000):
        self.primary, self.secondary, self.most = primary, secondary, max_primary_size

    def __call__(self, text: Column, doc: Column | None = None) -> Column:
        """For chunkers without a Python function; ``add`` takes any."""
        doc = F.col("doc_id") if doc is None else doc
        again = lambda c: self._joined(c, self.secondary(F.when(F.length(c["text"]) > self.most, c["text"]).otherwise(""), F.concat(doc, c["id_suffix"])))
        return F.flatten(F.transform(self.primary(text, doc), again))

    def _joined(self, c: Column, inner: Column) -> Column:
        """A primary chunk, or the secondary's chunks of it."""
        own = F.transform(inner, lambda x: F.struct(x["text"].alias("text"), x["metadata"].alias("metadata"), F.concat(c["id_suffix"], x["doc_suffix"]).alias("doc_suffix"), F.concat(c["id_suffix"], x["id_suffix"]).alias("id_suffix")))
        return F.when(F.length(c["text"]) <= self.most, F.array(c)).otherwise(own)

    def _again(self, df: DataFrame, chunks: str, docs: str, out: str, spent: str | None) -> DataFrame:
        """``chunks``: an array of primary chunks, of the documents in ``docs`` -> an array with the final chunks of each."""
        texts, ids, inner = _name("texts"), _name("ids"), _name("inner")
        df = df.withColumn(texts, F.transform(chunks, lambda c: F.when(F.length(c["text"]) > self.most, c["text"]).otherwise("")))
        df = df.withColumn(ids, F.transform(F.arrays_zip(F.col(chunks).alias("c"), F.col(docs).alias("d")), lambda x: F.concat(x["d"], x["c"]["id_suffix"])))
        df = self.secondary.add_many(df, texts, ids, inner, spent)
        both = F.arrays_zip(F.col(chunks).alias("c"), F.col(inner).alias("i"))
        return df.withColumn(out, F.transform(both, lambda x: self._joined(x["c"], x["i"]))).drop(texts, ids, inner)

    def add(self, df: DataFrame, text: str, doc: str, out: str, spent: str | None = None) -> DataFrame:
        chunks, docs, each = _name("chunks"), _name("docs"), _name("each")
        df = self.primary.add(df, text, doc, chunks, spent).withColumn(docs, F.array_repeat(doc, F.size(chunks)))
        return self._again(df, chunks, docs, each, spent).withColumn(out, F.flatten(each)).drop(chunks, docs, each)

    def add_many(self, df: DataFrame, texts: str, docs: str, out: str, spent: str | None = None) -> DataFrame:
        lists, chunks, ids, each = _name("lists"), _name("chunks"), _name("docs"), _name("each")
        df = self.primary.add_many(df, texts, docs, lists, spent).withColumn(chunks, F.flatten(lists))
        of = F.arrays_zip(F.col(lists).alias("l"), F.col(docs).alias("d"))
        df = self._again(df.withColumn(ids, F.flatten(F.transform(of, lambda x: F.array_repeat(x["d"], F.size(x["l"]))))), chunks, ids, each, spent)
        # Each text takes as many of the arrays as its primary has chunks. All that a lambda needs comes in by its arguments: a column
        # named in its body would be put in place of its name, Python function and all.
        before = lambda v, i: F.aggregate(F.slice(v["l"], 1, i), F.lit(0), lambda n, x: n + F.size(x))
        apart = lambda v: F.transform(v["l"], lambda x, i: F.flatten(F.slice(v["e"], before(v, i) + 1, F.size(x))))
        return df.withColumn(out, let(F.struct(F.col(lists).alias("l"), F.col(each).alias("e")), apart)).drop(lists, chunks, ids, each)
