"""The chunkers: each function gives a ``Chunker`` (see ``chunker``), so a strategy is a chain of columns over a scan, without a shuffle, and runs
on streams as well. ``tokenizer=`` takes ``Tokens`` or the parameters of a byte-pair vocabulary; without it tokens are found by pattern. ``encoder=`` takes a
sentence encoder's factory or its name (``module:attribute``), ``similar=`` an expression instead; without either, sentences are compared by word counts. ``sentences=`` takes
a model of sentence ends (``punkt``), as such or as a dictionary, or an expression; without it a sentence ends behind a mark that white space follows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions import encoders, splitting
from textmill.functions import text as T
from textmill.functions.lifted import PerValue
from textmill.functions.tokenizing import Tokens, tokens
from textmill.operators import punkt
from textmill.operators.chunker import CHUNKS, Chunker, Given, Hybrid
from textmill.operators.chunker import let as _let
from textmill.operators.chunker import rounded


class Plain(NamedTuple):
    """A number of at most six decimals, to be written without an exponent, which Spark takes below a thousandth and SQL does not."""

    value: Column

    def text(self) -> Column:
        return F.regexp_replace(self.value.cast("decimal(20,6)").cast("string"), r"(\.[0-9]+?)0+$", "$1")


def _chunk(text: Column, metadata: dict, suffix: Column) -> Column:
    """Metadata values are columns, ``Plain`` or constants; null values are left out."""
    column = lambda v: v.text() if isinstance(v, Plain) else v if isinstance(v, Column) else F.lit(v)
    json = F.to_json(F.struct(*(column(v).alias(k) for k, v in metadata.items())))
    for k, v in metadata.items():
        if isinstance(v, Plain):
            json = F.regexp_replace(json, f'"{k}":"([^"]*)"', f'"{k}":$1')
    return F.struct(text.alias("text"), json.alias("metadata"), F.lit("").alias("doc_suffix"), suffix.alias("id_suffix"))


def _numbered(i: Column, kind: str = "chunk") -> Column:
    return F.format_string(f"_{kind}_%04d", i)


def _starts(n: Column, step: int) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


Run = Callable[[Column, Column, Column], Column]
Sentences = punkt.Model | dict | Callable[[Column], Column] | None


def _sentences(given: Sentences) -> Callable[[Column], Column]:
    return punkt.splitter(given, lambda text: T.sentences(text))


def _joined(joiner: str) -> Run:
    """The text of a run (start, length) of an array of texts."""
    return lambda units, start, n: F.array_join(F.slice(units, start + 1, n), joiner)


def _pieces(units: Column, starts: Column, metadata: Callable[[Column, Column, Column], dict], size: Callable[[Column], Column] = F.size, run: Run = _joined(" ")) -> Column:
    """One chunk from each start to the next; ``metadata`` gets the piece's number, text and start."""

    def one(s: Column, i: Column) -> Column:
        text = run(units, s, F.coalesce(F.get(starts, i + 1), size(units)) - s)
        return _chunk(text, metadata(i, text, s), _numbered(i))

    return F.when(size(units) > 0, F.transform(starts, one)).otherwise(F.array().cast(CHUNKS))


def _windows(units: Column, number: Column, run: Run, size: int, step: int, name: str, keys: dict, ends: tuple[str, str], kind: str = "chunk") -> Column:
    """Runs of ``size`` units every ``step``; emitted as long as a run has a unit, so the last one may
    repeat the end of the one before."""

    def of(v: Column) -> Column:
        u, n = v["u"], v["n"]

        def one(s: Column, i: Column) -> Column:
            meta = {"chunker": name, **keys, ends[0]: s, ends[1]: F.least(s + size, n)}
            return _chunk(run(u, s, F.lit(size)), meta, _numbered(i, kind))

        return F.transform(_starts(n, step), one)

    return _let(F.struct(units.alias("u"), number.alias("n")), of)


def windows(units: Callable[[Column], Column], size: int, step: int, joiner: str, name: str, keys: dict, ends: tuple[str, str], kind: str = "chunk") -> Chunker:
    """Windows over texts in an array."""
    if step < 1 or size < 1:
        raise ValueError("size and step must be at least 1")
    return Chunker(lambda x: _windows(x.prepared, F.size(x.prepared), _joined(joiner), size, step, name, keys, ends, kind), prepare=units)


def token_windows(size: int, step: int, name: str, keys: dict, kind: str = "chunk", tokenizer: Tokens | dict | None = None) -> Chunker:
    """Windows over tokens."""
    if step < 1 or size < 1:
        raise ValueError("size and step must be at least 1")
    t = tokens(tokenizer)

    def body(x: Given) -> Column:
        return _let(t.units(x.text, x.found), lambda u: _windows(u, t.size(u), t.run, size, step, name, keys, ("start_token", "end_token"), kind))

    return _over_tokens(t, body)


def _over_tokens(t: Tokens, body: Callable[[Given], Column]) -> Chunker:
    return Chunker(body, python=t.python, ask=t.ask and (lambda text, _: t.ask(text)))


def fixed_character(chunk_size: int, overlap: int, name: str = "fixed_character_chunking") -> Chunker:
    step = max(1, chunk_size - overlap)

    def chunk(x: Given) -> Column:
        text = x.text
        n = F.length(text)

        def one(s: Column, i: Column) -> Column:
            meta = {"chunker": name, "chunk_size": chunk_size, "overlap": overlap, "start_char": s, "end_char": F.least(s + chunk_size, n)}
            return _chunk(F.substring(text, s + 1, F.lit(chunk_size)), meta, _numbered(i))

        return F.transform(_starts(n, step), one)

    return Chunker(chunk)


def fixed_token(chunk_size: int, overlap: int = 0, name: str = "fixed_token_chunking", tokenizer: Tokens | dict | None = None) -> Chunker:
    return token_windows(chunk_size, max(1, chunk_size - overlap), name, {"chunk_size": chunk_size, "overlap": overlap}, tokenizer=tokenizer)


def overlapping_token(chunk_size: int, overlap_size: int, tokenizer: Tokens | dict | None = None) -> Chunker:
    return token_windows(chunk_size, max(1, chunk_size - overlap_size), "overlapping_token_chunking", {"chunk_size": chunk_size, "overlap_size": overlap_size}, tokenizer=tokenizer)


def sliding_token(window_size: int, step_size: int, tokenizer: Tokens | dict | None = None) -> Chunker:
    return token_windows(window_size, step_size, "sliding_window_token_chunking", {"window_size": window_size, "step_size": step_size}, tokenizer=tokenizer)


def token_span(span_size: int, step_size: int, tokenizer: Tokens | dict | None = None) -> Chunker:
    return token_windows(span_size, step_size, "late_chunking_token_spans", {"span_size": span_size, "step_size": step_size}, "span", tokenizer)


def sentence_group(sentences_per_chunk: int, overlap: int, sentences: Sentences = None) -> Chunker:
    return windows(_sentences(sentences), sentences_per_chunk, max(1, sentences_per_chunk - overlap), " ", "sentence_group_chunking", {"sentences_per_chunk": sentences_per_chunk, "overlap": overlap}, ("start_sentence_index", "end_sentence_index"))


def paragraph_group(paragraphs_per_chunk: int, overlap: int) -> Chunker:
    return windows(T.paragraphs, paragraphs_per_chunk, max(1, paragraphs_per_chunk - overlap), "\n\n", "paragraph_group_chunking", {"paragraphs_per_chunk": paragraphs_per_chunk, "overlap": overlap}, ("start_paragraph_index", "end_paragraph_index"))


def each_unit(units: Callable[[Column], Column], name: str, index: str, total: str | None = None, kind: str = "chunk") -> Chunker:
    """A chunk for each unit."""

    def of(u: Column) -> Column:
        return F.transform(u, lambda x, i: _chunk(x, {"chunker": name, index: i, **({total: F.size(u)} if total else {})}, _numbered(i, kind)))

    return Chunker(lambda x: _let(x.prepared, of), prepare=units)


def sentence(sentences: Sentences = None) -> Chunker:
    return each_unit(_sentences(sentences), "sentence_based_chunking", "sentence_index")


def paragraph() -> Chunker:
    return each_unit(T.paragraphs, "paragraph_based_chunking", "paragraph_index")


def late_sentence(sentences: Sentences = None) -> Chunker:
    return each_unit(_sentences(sentences), "late_chunking_sentence_indexing", "sentence_index", "total_sentences", "sent")


def late_paragraph() -> Chunker:
    return each_unit(T.paragraphs, "late_chunking_paragraph_indexing", "paragraph_index", "total_paragraphs", "para")


def _greedy_starts(lengths: Column, limits: Column) -> Column:
    """Starts of groups filled up to the limit of the unit that comes next."""
    begin = F.struct(F.lit(0).alias("len"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        cut = (F.size(acc["starts"]) == 0) | ((acc["len"] + x["len"] > x["limit"]) & (acc["len"] >= 0))
        return F.struct(F.when(cut, x["len"]).otherwise(acc["len"] + x["len"]).alias("len"), F.when(cut, F.concat(acc["starts"], F.array(x["at"]))).otherwise(acc["starts"]).alias("starts"))

    units = F.transform(F.arrays_zip(lengths.alias("len"), limits.alias("limit")), lambda x, i: F.struct(x["len"].alias("len"), x["limit"].alias("limit"), i.alias("at")))
    return F.aggregate(units, begin, step, lambda acc: acc["starts"])


def length_aware(target_length: int, tolerance: int, sentences: Sentences = None) -> Chunker:
    def of(s: Column) -> Column:
        starts = _greedy_starts(F.transform(s, lambda x: F.length(x)), F.transform(s, lambda x: F.lit(target_length + tolerance)))
        return _let(starts, lambda at: _pieces(s, at, lambda i, t, _: {"chunker": "length_aware_chunking", "length": F.length(t)}))

    return Chunker(lambda x: _let(x.prepared, of), prepare=_sentences(sentences))


WORDS = {"pattern": T.words, "treebank": T.treebank_words}


def content_density(base_chunk_size: int, sentences: Sentences = None, words: str = "pattern") -> Chunker:
    """The limit falls with the share of distinct words; the factor of the sentence that closes a chunk
    is recorded with it."""

    def of(v: Column) -> Column:
        s, factors = v["s"], v["f"]
        starts = _greedy_starts(F.transform(s, lambda x: F.length(x)), F.transform(factors, lambda f: f * base_chunk_size))
        return _let(starts, lambda at: _pieces(s, at, lambda i, t, _: {"chunker": "content_density_adaptive_chunking", "density_factor": rounded(F.get(factors, F.get(at, i + 1)), 6)}))

    factor = lambda x: _let(WORDS[words](x), lambda w: 1.5 - F.try_divide(F.size(F.array_distinct(w)), F.size(w)))

    def kept(text: Column) -> Column:
        return F.filter(F.transform(_sentences(sentences)(text), lambda x: F.struct(x.alias("s"), factor(x).alias("f"))), lambda x: x["f"].isNotNull())

    return Chunker(lambda x: _let(F.struct(x.prepared["s"].alias("s"), x.prepared["f"].alias("f")), of), prepare=kept)


def dynamic_token(min_chunk_size: int, max_chunk_size: int, tokenizer: Tokens | dict | None = None) -> Chunker:
    """A chunk ends after the last token with a sentence mark or line feed between the sizes, else at the most."""

    def starts_of(n: Column, ends: Column) -> Column:
        """One pass over the ends: ``m`` is the last one that the chunk from ``s`` may end at. Beyond the reach of ``s`` the
        chunk ends there, or else at the most, and again until the end is in reach."""
        begin = F.struct(F.lit(0).alias("s"), F.lit(0).alias("m"), F.array(F.lit(0)).alias("starts"))

        def step(acc: Column, e: Column) -> Column:
            s, m = acc["s"], acc["m"]
            beyond = e > s + max_chunk_size
            at = F.when(beyond & (m > s), m).otherwise(s)
            many = F.greatest(F.floor((e - 1 - at) / max_chunk_size).cast("int"), F.lit(0))
            now = at + many * max_chunk_size
            hard = F.transform(F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.slice(F.array(F.lit(0)), 1, 0)), lambda k: at + k * max_chunk_size)
            found = F.when(beyond, F.concat(acc["starts"], F.when(at > s, F.array(at)).otherwise(F.slice(F.array(F.lit(0)), 1, 0)), hard)).otherwise(acc["starts"])
            last = F.when(e - now > min_chunk_size, e).when(beyond, 0).otherwise(m)
            return F.struct(now.alias("s"), last.alias("m"), found.alias("starts"))

        # The end of the text closes what is open, at the last of the marks unless the text itself ends with one.
        closed = F.exists(ends, lambda e: e == n)
        marks = F.filter(ends, lambda e: e < n)
        folded = F.aggregate(F.concat(marks, F.array(n + 0)), begin, lambda acc, e: _let(step(acc, e), lambda x: F.struct(x["s"].alias("s"), F.when(e < n, x["m"]).otherwise(F.when((acc["m"] > x["s"]) & ~closed, acc["m"]).otherwise(0)).alias("m"), x["starts"].alias("starts"))))
        return F.filter(_let(folded, lambda x: F.when(x["m"] > x["s"], F.concat(x["starts"], F.array(x["m"]))).otherwise(x["starts"])), lambda s: s < n)

    k = tokens(tokenizer)

    def of(t: Column) -> Column:
        ends = F.filter(F.transform(k.each(t), lambda x, i: F.when(x.rlike(r"[.\n?!]"), i + 1)), lambda e: e.isNotNull())
        starts = _let(F.struct(k.size(t).alias("n"), ends.alias("e")), lambda v: starts_of(v["n"], v["e"]))
        return _let(starts, lambda at: _pieces(t, at, lambda i, x, s: {"chunker": "dynamic_token_size_chunking", "token_count": F.coalesce(F.get(at, i + 1), k.size(t)) - s}, k.size, k.run))

    return _over_tokens(k, lambda x: _let(k.units(x.text, x.found), of))


Similarity = Callable[[Column], Column]


def _compared(of: Callable[[Column, Column, Column], Column], sentences: Callable[[Column], Column], reach: int, similar: Similarity | None, encoder: encoders.Factory | None) -> Chunker:
    """A chunker of the text, its sentences and the similarities of neighbours: by an expression, an encoder, or word counts."""
    if similar is not None:
        return Chunker(lambda x: _let(F.struct(x.prepared.alias("s"), similar(x.prepared).alias("v")), lambda y: of(x.text, y["s"], y["v"])), prepare=sentences)
    if encoder is not None:
        python, ask = PerValue(encoders.adjacent(encoder, reach), "array<double>"), lambda _, s: s
    else:
        python, ask = PerValue(lambda words: splitting.adjacent_similarities(words, reach), "array<double>"), lambda _, s: F.transform(s, T.words)
    return Chunker(lambda x: of(x.text, x.prepared, x.found), prepare=sentences, python=python, ask=ask)


def _cuts(values: Column, cut: Callable[[Column, Column], Column]) -> Column:
    """The first sentence, and every one whose step from the one before is a cut."""
    return F.concat(F.array(F.lit(0)), F.filter(F.transform(values, lambda x, i: F.when(cut(x, i), i + 1)), lambda x: x.isNotNull()))


def similarity_threshold(threshold: float, similar: Similarity | None = None, encoder: encoders.Factory | None = None, sentences: Sentences = None) -> Chunker:
    """A sentence starts a chunk when it is less like the one before than the threshold."""

    def of(_: Column, s: Column, sims: Column) -> Column:
        meta = lambda at: lambda i, t, a: {"chunker": "semantic_similarity_threshold_chunking", "threshold": threshold, "sentence_count": F.coalesce(F.get(at, i + 1), F.size(s)) - a}
        return _let(_cuts(sims, lambda x, i: x < threshold), lambda at: _pieces(s, at, meta(at)))

    return _compared(of, _sentences(sentences), 0, similar, encoder)


def semantic_variance(sensitivity: float, similar: Similarity | None = None, encoder: encoders.Factory | None = None, sentences: Sentences = None) -> Chunker:
    """A cut where the similarity falls below the mean of the last three by more than ``sensitivity``."""

    def of(text: Column, s: Column, sims: Column) -> Column:
        recent = lambda i: F.slice(sims, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
        mean = lambda i: F.aggregate(recent(i), F.lit(0.0), lambda a, x: a + x) / F.least(i, F.lit(3))
        cut = lambda x, i: F.when(i > 0, rounded(x - mean(i) + sensitivity, 9) < 0)
        whole = F.array(_chunk(text, {"chunker": "semantic_variance_adaptive_chunking"}, F.lit("_chunk_0000")))
        meta = lambda at: lambda i, t, _: {"chunker": "semantic_variance_adaptive_chunking", "split_score": Plain(rounded(F.get(sims, F.get(at, i + 1) - 1), 6))}
        return F.when(F.size(s) == 1, whole).otherwise(_let(_cuts(sims, cut), lambda at: _pieces(s, at, meta(at))))

    return _compared(of, _sentences(sentences), 0, similar, encoder)


def percentile(values: Column, q: float) -> Column:
    """Linear interpolation between the order statistics of an array."""
    ordered = F.array_sort(values)
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.coalesce(F.get(ordered, low + 1), F.get(ordered, low))
    return a + (b - a) * (at - low)


def semantic_breakpoints(name: str, gradient: bool = False, q: float = 0.95, similar: Similarity | None = None, encoder: encoders.Factory | None = None) -> Chunker:
    """Cuts after sentences whose distance to the next (with a neighbour on either side), or its
    gradient, is above the document's percentile."""

    def of(_: Column, s: Column, sims: Column) -> Column:
        return _let(F.transform(sims, lambda x: rounded(1 - x, 9)), lambda d: steps(s, d))

    def steps(s: Column, d: Column) -> Column:
        n, at = F.size(d), lambda i: F.get(d, i)
        slope = lambda i: F.when(i == 0, at(i + 1) - at(i)).when(i == n - 1, at(i) - at(i - 1)).otherwise((at(i + 1) - at(i - 1)) / 2)
        values = F.transform(d, lambda x, i: rounded(slope(i), 9)) if gradient else d
        return _let(values, lambda v: _let(rounded(percentile(v, q), 9), lambda top: pieces(s, v, top)))

    def pieces(s: Column, values: Column, top: Column) -> Column:
        starts = F.when(F.size(s) > (2 if gradient else 1), _cuts(values, lambda x, i: x > top)).otherwise(F.array(F.lit(0)))
        return _let(starts, lambda at: _pieces(s, at, lambda i, t, _: {"chunker": name}))

    return _compared(of, lambda text: T.sentences(text, T.PLAIN_SENTENCE_END), 1, similar, encoder)


def topic(distance_threshold: float, encoder: encoders.Factory | None = None, sentences: Sentences = None) -> Chunker:
    """Runs of neighbouring sentences of one cluster."""

    def of(text: Column, s: Column, label: Column) -> Column:
        starts = F.filter(F.transform(label, lambda x, i: F.when((i == 0) | (x != F.get(label, i - 1)), i)), lambda x: x.isNotNull())
        whole = F.array(_chunk(text, {"chunker": "topic_based_chunking"}, F.lit("_chunk_0000")))
        meta = lambda at: lambda i, t, a: {"chunker": "topic_based_chunking", "topic_label": F.get(label, a), "sentence_count": F.coalesce(F.get(at, i + 1), F.size(s)) - a}
        return F.when(F.size(s) == 1, whole).otherwise(_let(starts, lambda at: _pieces(s, at, meta(at))))

    if encoder is not None:
        python, ask = PerValue(encoders.topics(encoder, distance_threshold), "array<int>"), lambda _, s: s
    else:
        labels = lambda texts: pa.array([None if t is None else splitting.topic_labels(t, distance_threshold) for t in (x.values for x in texts)], pa.list_(pa.int32()))
        python, ask = PerValue(labels, "array<int>"), lambda _, s: F.transform(s, T.words)
    return Chunker(lambda x: of(x.text, x.prepared, x.found), prepare=_sentences(sentences), python=python, ask=ask)


def recursive(chunk_size: int, chunk_overlap: int, name: str = "recursive_chunking", by_tokens: bool = False, tokenizer: Tokens | dict | None = None) -> Chunker:
    if chunk_overlap > chunk_size:
        raise ValueError("the overlap is larger than the chunk")
    t = tokens(tokenizer)

    def split(texts: pa.Array) -> pa.Array:
        length = t.count() if by_tokens else len
        return pa.array([splitting.recursive_split(x, chunk_size, chunk_overlap, length) if x else [] for x in texts.to_pylist()], pa.list_(pa.string()))

    one = lambda x, i: _chunk(x, {"chunker": name, "chunk_size": chunk_size, "chunk_overlap": chunk_overlap}, _numbered(i))
    return Chunker(lambda x: F.transform(x.found, one), python=PerValue(split, "array<string>"), ask=lambda text, _: text)


def recursive_token(chunk_size: int, chunk_overlap: int, tokenizer: Tokens | dict | None = None) -> Chunker:
    return recursive(chunk_size, chunk_overlap, "recursive_token_fallback_chunking", True, tokenizer)


def parent_child(parent_chunk_size: int, child_chunk_size: int, chunk_overlap: int) -> Chunker:
    """Each parent, followed by its children."""
    if chunk_overlap > child_chunk_size:
        raise ValueError("the overlap is larger than the chunk")

    def split(texts: pa.Array) -> pa.Array:
        both = lambda t: [[p, *splitting.recursive_split(p, child_chunk_size, chunk_overlap)] for p in splitting.recursive_split(t, parent_chunk_size, chunk_overlap)]
        return pa.array([both(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.list_(pa.string())))

    def body(given: Given) -> Column:
        def one(x: Column, i: Column, j: Column) -> Column:
            parent = _numbered(i, "parent")
            meta = {"chunker": "parent_child_chunking", "chunk_type": F.when(j == 0, "parent").otherwise("child"), "parent_id": F.when(j > 0, F.concat(given.doc, parent)), "chunk_size": F.when(j == 0, parent_chunk_size).otherwise(child_chunk_size)}
            return _chunk(x, meta, F.when(j == 0, parent).otherwise(F.concat(parent, F.format_string("_child_%04d", j - 1))))

        return F.flatten(F.transform(given.found, lambda p, i: F.transform(p, lambda x, j: one(x, i, j))))

    return Chunker(body, python=PerValue(split, "array<array<string>>"), ask=lambda text, _: text)


def _lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n|\r", "\n")


def _grouped(units: Column, limits: Column, joiner: str, extra: int = 0) -> Column:
    """Units joined in groups, each filled up to the limit of the unit that comes next; ``extra`` is added to each length."""
    starts = _greedy_starts(F.transform(units, lambda x: F.length(x) + extra), limits)
    join = lambda at: F.transform(at, lambda s, i: F.array_join(F.slice(units, s + 1, F.coalesce(F.get(at, i + 1), F.size(units)) - s), joiner))
    return _let(starts, join)


def _boundary_chunks(text: Column, most: int, lossless: bool) -> Column:
    """Two levels of groups. The sentences of a paragraph make groups of up to ``most`` characters; the last of
    each paragraph may be joined with those of its neighbours, the others are chunks by themselves. Chunks come
    in the order in which they are full: those of a paragraph before the joined one that it closes. What follows
    the last sentence mark of a paragraph is left out. With ``lossless`` neither happens: a paragraph of several
    groups closes the joined one first, and all text is kept."""
    sentences = lambda p: F.split(F.regexp_replace(p, r"([.!?…]+\s+)", f"$1{T.BREAK}"), T.BREAK)
    whole = lambda u: F.filter(u, lambda x: x != "") if lossless else F.slice(u, 1, F.size(u) - 1)
    groups = lambda p: _let(whole(sentences(p)), lambda u: _grouped(u, F.transform(u, lambda _: F.lit(most)), ""))
    found = F.filter(F.transform(F.filter(F.split(text, "\n\n"), lambda p: T.strip(p) != ""), groups), lambda g: F.size(g) > 0)

    def ordered(g: Column) -> Column:
        last = F.transform(g, lambda x: F.element_at(x, -1))
        # A joined chunk of m parts has 2 * (m - 1) characters between them, hence the two on each length.
        limits = F.transform(g, lambda x: F.when(F.size(x) > 1, -1).otherwise(most + 4)) if lossless else F.transform(g, lambda _: F.lit(most + 4))
        starts = _greedy_starts(F.transform(last, lambda x: F.length(x) + 2), limits)
        early = F.flatten(F.transform(g, lambda x, p: F.transform(F.slice(x, 1, F.size(x) - 1), lambda c, j: F.struct(p.alias("at"), F.lit(1).alias("late"), j.alias("n"), c.alias("text")))))

        def joined(at: Column) -> Column:
            end = lambda i: F.coalesce(F.get(at, i + 1), F.size(g))
            return F.transform(at, lambda s, i: F.struct(end(i).alias("at"), F.lit(0 if lossless else 2).alias("late"), F.lit(0).alias("n"), F.array_join(F.slice(last, s + 1, end(i) - s), "\n\n").alias("text")))

        return F.transform(F.sort_array(F.concat(early, _let(starts, joined))), lambda x: T.strip(x["text"]))

    return _let(found, ordered)


def _uneven(chunks: Column, most: int) -> Column:
    """Three chunks or more, of which many are short or whose sizes vary much."""
    n = F.size(chunks)
    sizes = F.transform(chunks, lambda c: F.length(c))
    mean = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / n
    variance = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return (n >= 3) & ((F.size(F.filter(sizes, lambda x: x < 0.35 * most)) > 0.3 * n) | (variance > most**2))


def cut_at(text: Column, cuts: Column) -> Column:
    """The text between the cuts that lie strictly inside it, stripped and without blanks."""
    inside = F.sort_array(F.array_distinct(F.filter(cuts, lambda c: (c > 0) & (c < F.length(text)))))
    pieces = lambda at: F.transform(F.concat(F.array(F.lit(0)), at), lambda a, i: T.strip(F.substring(text, a + 1, F.coalesce(F.get(at, i), F.length(text)) - a)))
    return F.filter(_let(inside, pieces), lambda p: p != "")


def llm_boundary(max_chars: int = 1500, overlap: int = 80, lossless: bool = False, boundaries: PerValue | None = None) -> Chunker:
    """Two-level chunks, each but the first led by the end of the one before. ``boundaries`` may ask a model
    (``providers.boundaries``): it gives, for a text whose chunks are uneven (others are not asked), the places to cut at, or null where no answer is
    usable; then the text is cut at the sums of the chunks' lengths. The default is none."""

    def prepare(text: Column) -> Column:
        plain = F.coalesce(T.strip(_lines(text)), F.lit(""))
        return _let(plain, lambda t: F.struct(t.alias("t"), _boundary_chunks(t, max_chars, lossless).alias("c")))

    def refined(x: Given) -> Column:
        chunks = x.prepared["c"]
        if boundaries is None:
            return chunks
        reached = lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda _, i: F.aggregate(F.slice(c, 1, i + 1), F.lit(0), lambda n, y: n + F.length(y)))
        return F.when(_uneven(chunks, max_chars), cut_at(x.prepared["t"], F.coalesce(x.found, reached(chunks)))).otherwise(chunks)

    def led(c: Column) -> Column:
        return F.transform(c, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.right(F.get(c, i - 1), F.lit(overlap)), F.lit("\n\n"), x))) if overlap > 0 else c

    def body(given: Given) -> Column:
        meta = lambda x, i: {"chunker": "hybrid_boundary_chunker", "char_count": F.length(x), "used_llm_refinement": F.lit(False) if boundaries is None else _uneven(given.prepared["c"], max_chars), "chunk_index": i}
        return F.transform(_let(refined(given), led), lambda x, i: _chunk(x, meta(x, i), _numbered(i)))

    return Chunker(body, prepare=prepare, python=boundaries, ask=lambda _, p: F.when(_uneven(p["c"], max_chars), p["t"]))


_KINDS = (("code", "^```"), ("heading_block", r"^#{1,6}\s+"), ("list", r"^(-|\*|\d+\.)\s+"))


def _parts(block: Column, most: int) -> Column:
    """A block in parts of at most ``most`` characters, cut after sentence marks where there are any; what
    follows the last mark of a block that is cut is a part by itself."""
    units = F.regexp_extract_all(block, F.lit(rf"[^.!?…]{{0,{most - 1}}}[.!?…]|[^.!?…]{{1,{most}}}"), F.lit(0))
    limits = lambda u: F.transform(u, lambda x: F.when(x.rlike("[.!?…]$"), most).otherwise(-1))
    return F.when(F.length(block) <= most, F.array(block)).otherwise(_let(units, lambda u: _grouped(u, limits(u), "")))


def _valid(segments: Column, size: Column) -> Column:
    """Segments (start, end, type) inside the text, each from where the one before ends; null if none is left."""
    inside = F.filter(segments, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= size))
    reach = lambda i: F.coalesce(F.array_max(F.transform(F.slice(inside, 1, i), lambda s: s["end"])), F.lit(0))
    kept = F.filter(F.transform(inside, lambda s, i: F.struct(F.greatest(s["start"], reach(i)).alias("start"), s["end"].alias("end"), F.coalesce(s["type"], F.lit("paragraph")).alias("type"))), lambda s: s["start"] < s["end"])
    return F.when(F.size(kept) > 0, kept)


def llm_segment(max_chars: int = 1500, overlap: int = 80, segments: PerValue | None = None, ask_above: int = 1200) -> Chunker:
    """Typed blocks between blank lines, cut to size, each chunk led by the end of the one before. ``segments``
    may ask a model (``providers.segments``) for the parts of a block of more than ``ask_above`` characters:
    it gives an array of (start, end, type), or null to keep the block."""

    def typed(block: Column) -> Column:
        kind = F.lit("paragraph")
        for name, pattern in reversed(_KINDS):
            kind = F.when(T.strip(block).rlike(pattern), name).otherwise(kind)
        return F.struct(kind.alias("kind"), block.alias("text"))

    def apart(blocks: Column, asked: Column | None) -> Column:
        if segments is None:
            return blocks
        cut = lambda b, found: F.transform(found, lambda s: F.struct(s["type"].alias("kind"), F.substring(b["text"], s["start"] + 1, s["end"] - s["start"]).alias("text")))
        checked = lambda x: F.coalesce(cut(x["b"], _valid(x["s"], F.length(x["b"]["text"]))), F.array(x["b"]))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), asked.alias("s")), checked))

    def led(parts: Column) -> Column:
        # The end of a chunk is that of all parts so far; a part and what joins it have three characters at least.
        before = lambda i: F.array_join(F.transform(F.slice(parts, F.greatest(i - overlap // 3, F.lit(1)), F.least(i, F.lit(overlap // 3 + 1))), lambda x: x["text"]), "\n\n")
        lead = lambda x, i: F.when(i == 0, x["text"]).otherwise(F.concat(F.right(before(i), F.lit(overlap)), F.lit("\n\n"), x["text"]))
        return F.transform(parts, lambda x, i: F.struct(x["kind"].alias("kind"), (lead(x, i) if overlap > 0 else x["text"]).alias("text")))

    def prepare(text: Column) -> Column:
        plain = T.strip(F.regexp_replace(_lines(F.coalesce(text, F.lit(""))), "\n{3,}", "\n\n"))
        return F.transform(F.filter(F.split(plain, "\n{2,}"), lambda b: T.strip(b) != ""), typed)

    def body(x: Given) -> Column:
        parts = F.flatten(F.transform(apart(x.prepared, x.found), lambda b: F.transform(_parts(b["text"], max_chars), lambda p: F.struct(b["kind"].alias("kind"), p.alias("text")))))
        return F.transform(_let(parts, led), lambda c, i: _chunk(c["text"], {"chunker": "efficient_llm_segment_then_chunk", "unit_type": c["kind"], "chunk_index": i, "char_count": F.length(c["text"])}, _numbered(i)))

    # The model is asked for all blocks of a text at once.
    ask = lambda _, blocks: F.transform(blocks, lambda b: F.when(F.length(b["text"]) > ask_above, b["text"]))
    return Chunker(body, prepare=prepare, python=segments, ask=ask)


def hybrid(primary: Chunker, secondary: Chunker, max_primary_size: int = 1000) -> Chunker:
    """The primary's chunks; longer ones are cut by the secondary, with the primary's chunk as document."""
    return Hybrid(primary, secondary, max_primary_size)
