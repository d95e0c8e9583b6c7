"""Sentence boundaries learnt from the corpus itself, without labels, after the published method of Kiss and Strunk (2006).

``types`` and ``pairs`` are aggregates over all words: how often each word type stands with and without a period, in
lower case and with a capital inside a sentence, and what follows a period. From these ``fit`` finds abbreviations (by a
likelihood ratio, scaled by length, inner periods and occurrences without a period), collocations across a period, words that often start a
sentence, and words whose capital means a start. ``sentences`` applies the model as a column expression.

A period ends a sentence unless its word is an abbreviation, an initial or a number. After an abbreviation or an initial a sentence ends only
before a capital word that often starts sentences (after an abbreviation also before one that has a capital nowhere else), and never inside
a collocation; after a number it ends unless a word in lower case follows. Other marks always end one. A mark may be followed by
closing quotes and brackets. White space between sentences is dropped.

Counts are of words as they stand, summed before they are shuffled; patterns are applied to distinct ones. ``tables`` gives a model of any size, which
``marked`` applies by joins. ``fit`` makes lists of it for use in expressions; ``MOST`` bounds each of them, beyond that it raises.
A null or empty text has no words and no sentences; an empty corpus gives a model without entries.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from textmill.functions.text import BLANKS
from textmill.operators.chunker import let

# The published thresholds.
ABBREVIATION = 0.3
COLLOCATION = 7.88
STARTER = 30
MOST = 20_000

WORD = f"[^{BLANKS[1:-1]}]+"
OPENING, CLOSING = "\"'(\\[{“‘«", "\"')\\]}”’»"
OUTER = f"^[{OPENING}]+|[{CLOSING},;:]+$"
END = f"[.?!…][{CLOSING}]*$"
NUMBER = "##"


class Model(NamedTuple):
    """Word types without their final period, in lower case."""

    abbreviations: tuple[str, ...] = ()
    collocations: tuple[tuple[str, str], ...] = ()
    starters: tuple[str, ...] = ()
    capitals: tuple[str, ...] = ()


def core(word: Column) -> Column:
    """A word without quotes, brackets and commas around it."""
    return F.regexp_replace(word, OUTER, "")


def type_of(core_: Column) -> Column:
    """Lower case, without a final period; all numbers are one type."""
    plain = F.lower(F.regexp_replace(core_, r"\.$", ""))
    return F.when(plain.rlike(r"^[+-]?[0-9]+([.,:/-][0-9]+)*$"), NUMBER).otherwise(plain)


def _dotted(core_: Column) -> Column:
    return core_.rlike(r"[^.]\.$")


def words(docs: DataFrame) -> DataFrame:
    """The distinct words of ``docs`` (text) as they stand, each inside a sentence and at the beginning of one, with their number."""
    found = docs.select(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)).alias("w")).where("size(w) > 0")
    inside = lambda i: F.coalesce(~F.get("w", i - 1).rlike(END), F.lit(False))
    return found.select(F.inline(F.transform("w", lambda x, i: F.struct(x.alias("word"), inside(i).alias("inside"))))).groupBy("word", "inside").agg(F.count("*").alias("k"))


def followed(docs: DataFrame) -> DataFrame:
    """The distinct words of ``docs`` (text) that hold a period, each with the word behind it, and their number."""
    found = docs.select(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)).alias("w")).where("size(w) > 0")
    both = F.transform("w", lambda x, i: F.struct(x.alias("word"), F.get("w", i + 1).alias("behind")))
    return found.select(F.inline(F.filter(both, lambda x: F.contains(x["word"], F.lit(".")) & x["behind"].isNotNull()))).groupBy("word", "behind").agg(F.count("*").alias("k"))


def types(docs: DataFrame) -> DataFrame:
    """Of each word type: ``n``, with a period (``n_dot``), in lower case, with a capital inside a sentence; and its score as an abbreviation, null if it can't be one."""
    n = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    c = F.col("c")
    each = words(docs).select("inside", "k", core(F.col("word")).alias("c")).withColumn("type", type_of(c)).where("type <> ''")
    counted = each.groupBy("type").agg(F.sum("k").alias("n"), n(_dotted(c)).alias("n_dot"), n(c.rlike(r"^\p{Ll}")).alias("n_low"), n(c.rlike(r"^\p{Lu}") & F.col("inside")).alias("n_capital"))
    total = counted.agg(F.sum("n").alias("total"), F.sum("n_dot").alias("total_dot"))
    share = F.col("total_dot") / F.col("total")
    plain = F.col("n") - F.col("n_dot")
    null = F.col("n_dot") * F.ln(share) + plain * F.ln(1 - share)
    other = F.col("n_dot") * F.ln(F.lit(0.99)) + plain * F.ln(F.lit(0.01))
    inner = F.regexp_count("type", F.lit(r"\."))
    letters = F.length("type") - inner
    score = -2 * (null - other) * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -plain.cast("double"))
    may = (F.col("n_dot") > 0) & (F.col("type") != NUMBER) & F.col("type").rlike(r"^\p{L}") & (F.col("total_dot") < F.col("total"))
    return counted.crossJoin(F.broadcast(total)).select("type", "n", "n_dot", "n_low", "n_capital", F.when(may, F.round(score, 9)).alias("score"))  # one row


def pairs(docs: DataFrame) -> DataFrame:
    """What follows a word with a period, and how often, in all and with a capital."""
    each = followed(docs).select("k", core(F.col("word")).alias("c"), core(F.col("behind")).alias("b")).where(_dotted(F.col("c")))
    each = each.select("k", type_of(F.col("c")).alias("type"), type_of(F.col("b")).alias("next"), F.col("b").rlike(r"^\p{Lu}").alias("capital")).where("next <> '' and type <> ''")
    return each.groupBy("type", "next").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("capital"), F.col("k")).otherwise(0)).alias("n_capital"))


def likelihood(a: Column, b: Column, both: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of two things that occur ``a`` and ``b`` times, together ``both`` times, among ``total``."""
    log = lambda k, p: F.when(k > 0, k * F.ln(p)).otherwise(0.0)
    of = lambda hits, rest, p: log(hits, p) + log(rest, 1 - p)
    neither = total - a - b + both
    p, p1, p2 = b / total, both / a, F.try_divide(b - both, total - a)
    return -2 * (of(both, a - both, p) + of(b - both, neither, p) - of(both, a - both, p1) - of(b - both, neither, p2))


def _list(rows: DataFrame, *columns: str) -> tuple:
    found = rows.select(*columns).distinct().limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} entries in a list of the model")
    return tuple(sorted(r[0] if len(columns) == 1 else tuple(r) for r in found))


class Tables(NamedTuple):
    """A model of any size: a row for each entry of the lists of ``Model``. ``held`` are the tables that it is made of, kept on disk."""

    abbreviations: DataFrame
    collocations: DataFrame
    starters: DataFrame
    capitals: DataFrame
    held: tuple[DataFrame, ...]


def tables(docs: DataFrame) -> Tables:
    """The model of ``docs`` (text): abbreviations (type), collocations (type, next), starters and capitals (next). Only two sums pass through the driver."""
    known = types(docs).persist(StorageLevel.DISK_ONLY)  # both are read several times
    follow = pairs(docs).persist(StorageLevel.DISK_ONLY)
    total = known.agg(F.sum("n")).first()[0] or 0
    short = known.where(F.col("score") >= ABBREVIATION).select("type")
    open_ = (F.col("type") == NUMBER) | F.col("type").rlike(r"^\p{L}$")
    of = follow.join(short.withColumn("short", F.lit(True)), "type", "left").withColumn("open", open_ | F.col("short").isNotNull())
    firsts = known.select(F.col("type"), F.col("n").alias("n_type"))
    nexts = known.select(F.col("type").alias("next"), F.col("n").alias("n_next"), "n_low", F.col("n_capital").alias("inner_capital"))
    held = of.where("open").join(firsts, "type").join(nexts, "next")
    tied = held.where(likelihood(F.col("n_type"), F.col("n_next"), F.col("n"), F.lit(total)) >= COLLOCATION).where(F.lit(total) / F.col("n_type") > F.col("n_next") / F.col("n"))
    ends = of.where("not open")
    breaks = ends.agg(F.sum("n")).first()[0] or 0
    after = ends.groupBy("next").agg(F.sum("n").alias("n")).join(nexts, "next")
    starts = after.where(likelihood(F.lit(breaks), F.col("n_next"), F.col("n"), F.lit(total)) >= STARTER).where(F.col("n") / F.col("n_next") > F.lit(breaks) / F.lit(total or 1))
    capitals = held.where("n_capital > 0 and n_low > 0 and inner_capital = 0")
    return Tables(short, tied.select("type", "next"), starts.select("next"), capitals.select("next").distinct(), (known, follow))


def fit(docs: DataFrame) -> Model:
    """The model of ``docs`` (text) as lists, for expressions; a larger one stays in ``tables``."""
    made = tables(docs)
    try:
        return Model(_list(made.abbreviations, "type"), _list(made.collocations, "type", "next"), _list(made.starters, "next"), _list(made.capitals, "next"))
    finally:
        for x in made.held:
            x.unpersist()


def _units(text: Column) -> Column:
    """Words with the white space behind them; what comes before the first word belongs to it."""
    return F.regexp_extract_all(text, F.lit(f"^{BLANKS}*{WORD}{BLANKS}*|{WORD}{BLANKS}*"), F.lit(0))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{BLANKS}+|{BLANKS}+$", "")


def _places(units: Column, cut: Callable[[Column, Column], Column]) -> Column:
    """Numbers of the units, from 1, behind which a sentence ends: the last, and those with a mark for which ``cut`` of the word and the next one holds."""
    marked = f"[.?!…][{CLOSING}]*{BLANKS}*$"
    return F.filter(F.transform(units, lambda x, i: F.when((i == F.size(units) - 1) | (x.rlike(marked) & cut(_strip(x), _strip(F.get(units, i + 1)))), i + 1)), lambda e: e.isNotNull())


def _between(units: Column, places: Column) -> Column:
    """The units joined up to each of the places."""
    made = let(places, lambda at: F.transform(at, lambda e, k: _strip(F.array_join(F.slice(units, F.coalesce(F.get(at, k - 1), F.lit(0)) + 1, e - F.coalesce(F.get(at, k - 1), F.lit(0))), ""))))
    return F.filter(made, lambda s: s != "")


def marked(docs: DataFrame, model: Tables) -> DataFrame:
    """``docs`` (with a column text) with ``inside``: the numbers of the units whose period ends no sentence, as ``model`` has it. A decision is a join for each
    abbreviation, initial and number with a period; texts meet theirs by a digest, so equal texts share them."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", F.sha2("text", 256))

    def asked(x: Column, i: Column, units: Column) -> Column:
        # The last word ends the text, whatever it is.
        ready = (i < F.size(units) - 1) & x.rlike(rf"\.[{CLOSING}]*{BLANKS}*$")
        return F.when(ready, let(F.struct(core(_strip(x)).alias("c"), core(_strip(F.get(units, i + 1))).alias("n")), lambda v: F.struct((i + 1).alias("place"), v["c"].alias("c"), v["n"].alias("n"))))

    each = rows.select("digest", F.inline(let(_units(F.col("text")), lambda u: F.filter(F.transform(u, lambda x, i: asked(x, i, u)), lambda x: x.isNotNull()))))
    each = each.where(_dotted(F.col("c"))).select("digest", "place", type_of(F.col("c")).alias("type"), type_of(F.col("n")).alias("next"), F.col("n").rlike(r"^\p{Lu}").alias("capital"), F.col("n").rlike(r"^\p{Ll}").alias("low"))
    number, initial = F.col("type") == NUMBER, F.col("type").rlike(r"^\p{L}$")
    for given, keys, name in ((model.abbreviations, ["type"], "short"), (model.collocations, ["type", "next"], "tied"), (model.starters, ["next"], "starts"), (model.capitals, ["next"], "raised")):
        each = each.join(given.withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.col(name).isNotNull())
        each = each.where(number | initial | F.col("short"))  # nothing else is ever inside
    inside = F.when(F.col("tied"), True).when(number, F.col("low")).when(initial, ~(F.col("capital") & F.col("starts"))).otherwise(~(F.col("capital") & (F.col("starts") | F.col("raised"))))
    found = each.where(inside).groupBy("digest").agg(F.collect_set("place").alias("inside"))
    return rows.join(found, "digest", "left").withColumn("inside", F.coalesce("inside", F.array().cast("array<int>"))).drop("digest")


def marked_sentences(text: Column) -> Column:
    """The sentences of a row of ``marked``."""
    inside = F.col("inside")
    return let(_units(text), lambda u: _between(u, F.array_except(_places(u, lambda *_: F.lit(True)), inside)))


def _in(value: Column, values: tuple[str, ...]) -> Column:
    return value.isin(*values) if values else F.lit(False)


def sentences(model: Model) -> Callable[[Column], Column]:
    """The sentences of a text by a model, as an expression."""
    joint = tuple(f"{a}\x1f{b}" for a, b in model.collocations)

    def cut(word: Column, after: Column) -> Column:
        """Whether a sentence ends behind ``word``, which ``after`` follows."""
        c, n = core(word), core(after)
        kind, then = type_of(c), type_of(n)
        capital = n.rlike(r"^\p{Lu}")
        short, initial = _in(kind, model.abbreviations), kind.rlike(r"^\p{L}$")
        inside = F.when(_in(F.concat(kind, F.lit("\x1f"), then), joint), True).when(kind == NUMBER, n.rlike(r"^\p{Ll}"))
        inside = inside.when(initial, ~(capital & _in(then, model.starters))).when(short, ~(capital & (_in(then, model.starters) | _in(then, model.capitals)))).otherwise(False)
        return word.rlike(END) & ~(_dotted(c) & inside)

    return lambda text: let(_units(text), lambda u: _between(u, _places(u, cut)))


def splitter(given: Model | dict | Callable[[Column], Column] | None, default: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A model, its fields in a dictionary (as in a specification), or an expression; the default for none."""
    if given is None:
        return default
    if isinstance(given, dict):
        given = Model(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) for k, v in given.items()})
    return sentences(given) if isinstance(given, Model) else given
