"""The strategies that SQL cannot state, against plain versions over all documents of the smallest fixture."""

import json
import math
from collections import Counter

import pytest
import regex

from textmill import catalog
from textmill.functions.text import SENTENCE_END, TOKENS, WORDS
from textmill.plans.strategies import STRATEGIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {f"doc_{r.doc_id:03d}": r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def recursive(text, size, overlap, length=len):
    """By places in the text: a span is cut in front of each of the coarsest separator in it; neighbours are joined
    while their lengths fit, and the next chunk goes back over as many as the overlap allows."""
    out = []

    def join(spans):
        sizes = [length(text[a:b]) for a, b in spans]
        first = 0
        while first < len(spans):
            last = first
            while last + 1 < len(spans) and sum(sizes[first : last + 2]) <= size:
                last += 1
            out.append(text[spans[first][0] : spans[last][1]].strip())
            if last + 1 == len(spans):
                return
            back = last + 1
            while back - 1 > first and sum(sizes[back - 1 : last + 1]) <= overlap and sum(sizes[back - 1 : last + 2]) <= size:
                back -= 1
            first = back

    def walk(a, b, separators):
        kinds = [s for s in separators if s == "" or s in text[a:b]]
        separator = kinds[0]
        finer = separators[separators.index(separator) + 1 :]
        if separator:
            at = [m.start() + a for m in regex.finditer(regex.escape(separator), text[a:b])]
            cuts = sorted({a, b, *at})
        else:
            cuts = list(range(a, b + 1))
        fits = []
        for span in zip(cuts, cuts[1:]):
            if length(text[span[0] : span[1]]) < size:
                fits.append(span)
                continue
            join(fits)
            fits = []
            if finer:
                walk(*span, finer)
            else:
                out.append(text[span[0] : span[1]])
        join(fits)

    if text:
        walk(0, len(text), ["\n\n", "\n", " ", ""])
    return [x for x in out if x]


def n_tokens(text):
    return len(regex.findall(TOKENS, text))


def chunks_of(spark, name):
    found = {}
    for r in sorted(catalog.queries()[name](spark, SF).collect(), key=lambda r: r.chunk_ord):
        found.setdefault(r.doc_id[:7], []).append(r)
    return found


@pytest.mark.parametrize("name", ["recursive_chunking", "recursive_token_fallback_chunking"])
def test_recursive(spark, docs, name):
    params = STRATEGIES[name]["params"]
    got = chunks_of(spark, name)
    for d, text in docs.items():
        want = recursive(text, params["chunk_size"], params["chunk_overlap"], n_tokens if "token" in name else len)
        assert [r.text for r in got.get(d, [])] == want, d
        assert [r.chunk_id for r in got.get(d, [])] == [f"{d}_chunk_{i:04d}" for i in range(len(want))]


def test_parent_child(spark, docs):
    p = STRATEGIES["parent_child_chunking"]["params"]
    got = chunks_of(spark, "parent_child_chunking")
    for d, text in docs.items():
        want = []
        for i, parent in enumerate(recursive(text, p["parent_chunk_size"], p["chunk_overlap"])):
            want.append((f"{d}_parent_{i:04d}", parent, "parent", None))
            want += [(f"{d}_parent_{i:04d}_child_{j:04d}", child, "child", f"{d}_parent_{i:04d}") for j, child in enumerate(recursive(parent, p["child_chunk_size"], p["chunk_overlap"]))]
        assert [(r.chunk_id, r.text, json.loads(r.metadata)["chunk_type"], json.loads(r.metadata).get("parent_id")) for r in got.get(d, [])] == want, d


def test_hybrid_recursive(spark, docs):
    (name,) = [n for n, s in STRATEGIES.items() if s["type"] == "hybrid" and s["params"]["primary"]["type"].startswith("recursive")]
    spec = STRATEGIES[name]["params"]
    first, second = spec["primary"]["params"], spec["secondary"]["params"]
    step = second["chunk_size"] - second["overlap"]
    got = chunks_of(spark, name)
    for d, text in docs.items():
        want = []
        for i, chunk in enumerate(recursive(text, first["chunk_size"], first["chunk_overlap"])):
            tokens = regex.findall(TOKENS, chunk)
            whole = len(chunk) <= spec.get("max_primary_size", 1000)
            inner = [chunk] if whole else ["".join(tokens[s : s + second["chunk_size"]]) for s in range(0, len(tokens), step)]
            want += [(f"{d}_chunk_{i:04d}" + ("" if whole else f"_chunk_{j:04d}"), x) for j, x in enumerate(inner)]
        assert [(r.chunk_id, r.text) for r in got.get(d, [])] == want, d


def clusters(sentences, threshold):
    """The closest two clusters by mean distance are joined, as long as that is below the threshold."""
    bags = [Counter(regex.findall(WORDS, s)) for s in sentences]
    norm = [math.sqrt(sum(n * n for n in b.values())) or 1.0 for b in bags]
    apart = [[1 - sum(n * b[w] for w, n in a.items()) / (x * y) for b, y in zip(bags, norm)] for a, x in zip(bags, norm)]
    groups = [[i] for i in range(len(bags))]
    mean = {(i, j): apart[i][j] for i in range(len(bags)) for j in range(i)}
    while mean:
        (i, j), least = min(mean.items(), key=lambda x: x[1])
        if round(least, 12) >= threshold:
            break
        for k in range(len(groups)):
            if groups[k] and k not in (i, j):
                a, b = mean.pop((max(i, k), min(i, k))), mean[(max(j, k), min(j, k))]
                mean[(max(j, k), min(j, k))] = (len(groups[i]) * a + len(groups[j]) * b) / (len(groups[i]) + len(groups[j]))
        del mean[(i, j)]
        groups[j], groups[i] = groups[j] + groups[i], []
    label = {}
    for g in sorted((g for g in groups if g), key=min):
        for i in g:
            label[i] = min(g)
    names = {}
    return [names.setdefault(label[i], len(names)) for i in range(len(bags))]


def test_topic(spark, docs):
    got = chunks_of(spark, "topic_based_chunking")
    threshold = STRATEGIES["topic_based_chunking"]["params"]["distance_threshold"]
    some = 0
    for d, text in docs.items():
        sentences = [s for s in regex.split("\x1f", regex.sub(SENTENCE_END, "\\1\x1f", text)) if s]
        if len(sentences) > 60:
            continue
        labels = clusters(sentences, threshold)
        want, topics = [], []
        for s, label in zip(sentences, labels):
            if topics and topics[-1] == label:
                want[-1] += f" {s}"
            else:
                want.append(s)
                topics.append(label)
        if len(sentences) == 1:
            want, topics = [text], [None]
        assert [r.text for r in got.get(d, [])] == want, d
        assert [json.loads(r.metadata).get("topic_label") for r in got.get(d, [])] == topics, d
        some += max(labels, default=0) + 1 < len(sentences)
    assert some > 5
