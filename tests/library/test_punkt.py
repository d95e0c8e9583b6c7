"""Learnt sentence boundaries against plain versions."""

import math
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from textmill import catalog
from textmill.operators import chunkers as C
from textmill.operators import punkt
from textmill.plans import strategies

SF = "/root/testdata/sf0.001"
WORD = regex.compile(r"[^\s\x1c-\x1f\x85\p{Z}]+")
END = regex.compile(r"[.?!…][\"')\]}”’»]*$")


def core(word):
    return regex.sub(r"^[\"'(\[{“‘«]+|[\"')\]}”’»,;:]+$", "", word)


def kind(c):
    plain = regex.sub(r"\.$", "", c).lower()
    return "##" if regex.match(r"^[+-]?[0-9]+([.,:/-][0-9]+)*$", plain) else plain


def dotted(c):
    return bool(regex.search(r"[^.]\.$", c))


def ratio(a, b, both, total):
    def of(hits, rest, p):
        return (hits * math.log(p) if hits else 0) + (rest * math.log(1 - p) if rest else 0)

    neither = total - a - b + both
    p2 = (b - both) / (total - a) if total > a else 0
    return -2 * (of(both, a - both, b / total) + of(b - both, neither, b / total) - of(both, a - both, both / a) - of(b - both, neither, p2))


def plain_fit(texts):
    n, dots, low, inner, follow, follow_capital = (Counter() for _ in range(6))
    for text in texts:
        words = WORD.findall(text)
        for i, w in enumerate(words):
            c = core(w)
            t = kind(c)
            if i + 1 < len(words) and dotted(c) and t and (then := kind(core(words[i + 1]))):
                follow[t, then] += 1
                follow_capital[t, then] += bool(regex.match(r"\p{Lu}", core(words[i + 1])))
            if t:
                n[t] += 1
                dots[t] += dotted(c)
                low[t] += bool(regex.match(r"\p{Ll}", c))
                inner[t] += bool(regex.match(r"\p{Lu}", c)) and i > 0 and not END.search(words[i - 1])
    total, total_dots = sum(n.values()), sum(dots.values())
    short = set()
    for t in n:
        if not dots[t] or t == "##" or not regex.match(r"\p{L}", t) or total_dots == total:
            continue
        p, rest, inner_dots = total_dots / total, n[t] - dots[t], t.count(".")
        letters = len(t) - inner_dots
        score = -2 * (dots[t] * math.log(p) + rest * math.log(1 - p) - dots[t] * math.log(0.99) - rest * math.log(0.01)) * math.exp(-letters) * (inner_dots + 1) * letters**-rest
        if score >= 0.3:
            short.add(t)
    open_ = lambda t: t == "##" or t in short or regex.fullmatch(r"\p{L}", t)
    tied, capitals, after = set(), set(), Counter()
    for (a, b), k in follow.items():
        if open_(a):
            if ratio(n[a], n[b], k, total) >= 7.88 and total / n[a] > n[b] / k:
                tied.add((a, b))
            if follow_capital[a, b] and low[b] and not inner[b]:
                capitals.add(b)
        else:
            after[b] += k
    breaks = sum(after.values())
    starters = {b for b, k in after.items() if ratio(breaks, n[b], k, total) >= 30 and k / n[b] > breaks / total}
    return punkt.Model(*(tuple(sorted(x)) for x in (short, tied, starters, capitals)))


def plain_sentences(model, text):
    spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out, begin = [], 0
    for k, (a, b) in enumerate(spans):
        word, after = text[a:b], text[spans[k + 1][0] : spans[k + 1][1]] if k + 1 < len(spans) else None
        end = after is None
        if not end and END.search(word):
            c, n = core(word), core(after)
            t, then, capital = kind(c), kind(n), bool(regex.match(r"\p{Lu}", n))
            inside = False
            if dotted(c):
                if (t, then) in model.collocations:
                    inside = True
                elif t == "##":
                    inside = bool(regex.match(r"\p{Ll}", n))
                elif regex.fullmatch(r"\p{L}", t):
                    inside = not (capital and then in model.starters)
                elif t in model.abbreviations:
                    inside = not (capital and (then in model.starters or then in model.capitals))
            end = not inside
        if end:
            out.append(text[begin:b].strip())
            begin = b
    return [s for s in out if s]


@pytest.fixture(scope="module")
def texts(spark):
    return {f"doc_{r.doc_id:03d}": r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_fit_and_sentences_of_the_fixture(spark, texts):
    model = punkt.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert model == plain_fit(texts.values())
    got = {}
    for r in sorted(catalog.queries()["punkt_sentences"](spark, SF).collect(), key=lambda r: r.chunk_ord):
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {d: s for d, t in texts.items() if (s := plain_sentences(model, t))}


CORPUS = [
    "Dr. Brown met Mrs. Lee in the U.S. on Jan. 5. The talk was long. Dr. Brown left at 5 p.m. and Mrs. Lee stayed. He said so.",
    "The price rose by 3. percent in Jan. and fell later. Dr. Gray, e.g. with J. Smith, wrote it down. The end came. The rest is known!",
    'He asked "Who is Dr. Brown?" Nobody knew... The reply (by Mrs. Lee.) was short. The U.S. Army came. The army left. He went home.',
    "it was a long way down the road and home was so far that he came late and left again so he came home down a long long way",
] * 12


def test_abbreviations_are_learnt(spark):
    docs = spark.createDataFrame([(t, 1) for t in CORPUS] + [(None, 2), ("", 3)], "text string, type int")
    model = punkt.fit(docs)
    assert model == plain_fit(CORPUS)
    assert {"dr", "mrs", "u.s", "jan", "p.m", "e.g"} <= set(model.abbreviations) and not {"long", "home", "left", "down"} & set(model.abbreviations)
    rows = spark.createDataFrame([(t,) for t in CORPUS[:3]] + [("",), (None,)], "t string").select("t", punkt.sentences(model)(F.col("t")).alias("s")).collect()
    for r in rows:
        assert (r.s or []) == plain_sentences(model, r.t or "")
    first = rows[0].s
    assert first[0].startswith("Dr. Brown met Mrs. Lee in the U.S. on Jan. 5.") and any(s.startswith("Dr. Brown left at 5 p.m. and Mrs. Lee stayed.") for s in first)
    assert punkt.fit(docs.limit(0)) == punkt.Model()


def test_each_sentence_chunker_takes_a_model(spark):
    model = punkt.Model(abbreviations=("dr",))
    text = "Dr. Brown came. Dr. Lee went."
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    want = ["Dr. Brown came.", "Dr. Lee went."]
    assert [r.text for r in strategies.chunk(docs, strategies.spec("sentence", sentences=model._asdict())).orderBy("chunk_ord").collect()] == want
    for made in (
        C.late_sentence(sentences=model), C.sentence_group(1, 0, sentences=model), C.length_aware(16, 0, sentences=model), C.similarity_threshold(0.99, sentences=model), C.content_density(1, sentences=model),
    ):
        assert [r.c.text for r in strategies.made(docs, made).orderBy("chunk_ord").collect()] == want
    for made in (C.semantic_variance(0.2, sentences=model), C.topic(0.0001, sentences=model)):
        assert " ".join(r.c.text for r in strategies.made(docs, made).orderBy("chunk_ord").collect()) == text
    assert [r.c.text for r in strategies.made(docs, C.sentence()).orderBy("chunk_ord").collect()] == ["Dr.", "Brown came.", "Dr.", "Lee went."]


def test_a_model_beyond_the_lists(spark, monkeypatch):
    monkeypatch.setattr(punkt, "MOST", 1)
    docs = spark.createDataFrame([(f"doc_{i:03d}", t) for i, t in enumerate([*CORPUS, "", None])], "doc_id string, text string")
    with pytest.raises(ValueError):
        punkt.fit(docs)
    monkeypatch.undo()
    model = punkt.fit(docs)
    assert min(map(len, (model.abbreviations, model.capitals))) > 0
    monkeypatch.setattr(punkt, "MOST", 1)
    rows = strategies.chunk(punkt.marked(docs, punkt.tables(docs)), strategies.spec("sentence", sentences=punkt.marked_sentences)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.chunk_ord):
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {f"doc_{i:03d}": plain_sentences(model, t) for i, t in enumerate(CORPUS)}
