"""Text primitives as Spark columns; the patterns work alike in Java and RE2."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default patterns of the engine.
TOKENS = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s+"
WORDS = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
TERMS = r"[\p{L}\p{N}_]{2,}"
SENTENCE_END = r"([.!?…])\s+"
PLAIN_SENTENCE_END = r"([.!?])\s+"
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]"
BREAK = "\x1f"


def tokens(text: Column) -> Column:
    """Lossless pieces: joined they give the text back."""
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


# The published rules of Treebank words for English, in their order: a pattern and what takes its place. They work alike in Java and
# RE2; the opening double quotes become two backquotes, the closing ones two apostrophes, as there.
TREEBANK = (
    (r'^"', "`` "),
    (r"(``)", r" \1 "),
    (r"""([ (\[{<])("|'')""", r"\1 `` "),
    (r"""([^.])(\.)([\])}>"'»”’ ]*)\s*$""", r"\1 \2 \3 "),
    (r"([:,])([^0-9])", r" \1 \2"),
    (r"([:,])$", r" \1 "),
    (r"(\.{2,})", r" \1 "),
    (r"([;@#$%&?!])", r" \1 "),
    (r"([^'])' ", r"\1 ' "),
    (r"([\]\[(){}<>])", r" \1 "),
    (r"(--)", r" \1 "),
    (r"('')", r" \1 "),
    (r'"', " '' "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
    (r"(?i)\b(can)(not)\b", r" \1 \2 "),
    (r"(?i)\b(d)('ye)\b", r" \1 \2 "),
    (r"(?i)\b(gim|lem)(me)\b", r" \1 \2 "),
    (r"(?i)\b(gon)(na)\b", r" \1 \2 "),
    (r"(?i)\b(got)(ta)\b", r" \1 \2 "),
    (r"(?i)\b(more)('n)\b", r" \1 \2 "),
    (r"(?i)\b(wan)(na)\s", r" \1 \2 "),
    (r"(?i) ('t)(is|was)\b", r" \1 \2 "),
)


# What a match of the rules for quotes (and apostrophes) must hold; the other rules neither need nor make them. To look for a plain text costs a small part
# of a search for a pattern.
QUOTES = ('"', "'", "``")
# Rules that look at neighbours of marks, and what a match of one must hold.
MARKS, HELD_BY_MARKS = slice(4, 7), (":", ",", "..")
# Those that set a mark apart whatever stands beside it, as one.
APART = r"([;@#$%&?!\]\[(){}<>]|--)"
# Those for words, which ignore case, and what a match of one must hold in lower case: first what is cheap to look for. The lower case of I has no dot in some
# places.
CLITICS, MAYBE_CLITICS = slice(15, 23), ("'", "nn", "mm", "tt")
HELD_BY_CLITICS = ("cannot", "d'ye", "gimme", "gımme", "lemme", "gonna", "gotta", "more'n", "wanna", "'t")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _holds(text: Column, any_of: tuple[str, ...]) -> Column:
    return functools.reduce(operator.or_, (F.contains(text, F.lit(x)) for x in any_of))


def _ruled(apart: Column, rules: slice) -> Column:
    for pattern, put in TREEBANK[rules]:
        if pattern.endswith(" ") or pattern == TREEBANK[-1][0]:
            # These look for the blank around a word, which the ends of the sentence lack.
            apart = F.concat(F.lit(" "), apart, F.lit(" "))
        apart = F.regexp_replace(apart, pattern, put.replace("\\", "$"))
    return apart


def _without_quotes(text: Column) -> Column:
    """The rules before those for words, for a text that holds none of ``QUOTES``."""
    single = ~F.endswith(text, F.lit("..")) & (text != ".")
    last = F.when(F.endswith(text, F.lit(".")), F.when(single, F.concat(F.left(text, F.length(text) - 1), F.lit(" . "))).otherwise(text))
    ended = last.when(F.contains(text, F.lit(".")), _ruled(text, slice(3, 4))).otherwise(text)
    marked = _once(ended, lambda x: F.when(_holds(x, HELD_BY_MARKS), _ruled(x, MARKS)).otherwise(x))
    return F.concat(F.lit(" "), F.regexp_replace(marked, APART, " $1 "), F.lit(" "))


def treebank_words(text: Column) -> Column:
    """Words of a sentence by the Treebank rules: each rule in turn sets marks and clitics apart by blanks. Rules that can't match are left out."""

    def clitics(x: Column) -> Column:
        held = _once(F.lower(x), lambda low: _holds(low, MAYBE_CLITICS) & _holds(low, HELD_BY_CLITICS))
        return F.when(held, _ruled(x, CLITICS)).otherwise(x)

    plain = lambda x: F.when(_holds(x, QUOTES), _ruled(x, slice(0, CLITICS.start))).otherwise(_without_quotes(x))
    return F.regexp_extract_all(_once(_once(text, plain), clitics), F.lit(r"[^ \t-\r]+"), F.lit(0))


def sentences(text: Column, end: str = SENTENCE_END) -> Column:
    """Parts that end in a sentence mark followed by white space; that white space is dropped."""
    return F.filter(F.split(F.regexp_replace(text, end, f"$1{BREAK}"), BREAK), lambda s: s != "")


def strip(text: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


def paragraphs(text: Column) -> Column:
    """Stripped parts between blank lines, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")


def json_size(text: Column) -> Column:
    """Bytes of the text as an ASCII-escaped JSON string: two quotes, one more for a short escape,
    five more for another control or non-ASCII character, eleven for one outside the basic plane."""
    short = F.regexp_count(text, F.lit(r'["\\\x08\x09\x0a\x0c\x0d]'))
    long = F.regexp_count(text, F.lit(r"[\x00-\x07\x0b\x0e-\x1f\x7f-\x{ffff}]"))
    astral = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10ffff}]"))
    return 2 + F.length(text) + short + 5 * long + 11 * astral
