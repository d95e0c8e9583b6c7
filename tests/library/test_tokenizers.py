"""Byte-pair tokens against a library and plain rules; hybrids of any two chunkers; encoders."""

import base64
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmill import catalog
from textmill.functions import bpe, splitting, tokenizing
from textmill.functions import text as T
from textmill.operators import chunkers as C
from textmill.plans import strategies

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = {"<|endoftext|>": 50256}
OWN = bpe.vocabulary(PATH, special=SPECIAL)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens=SPECIAL)
SYMBOLS = st.lists(st.sampled_from([*" \n\t\r\xa0 aabcdeinorst'sé漢😀1.,#́", "ing", " the", "'ll", "  ", "aaaa"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(SYMBOLS, max_size=4))
def test_ids_as_the_library_finds_them(texts):
    own = bpe.merger(OWN)
    lists = pa.array([own.pieces.findall(t) for t in texts], pa.list_(pa.string()))
    ids, n = own.encode(lists)
    want = [PLAIN.encode(t) for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert [own.decode(w) for w in want] == texts


@settings(max_examples=100, deadline=None)
@given(st.text("ab", min_size=1, max_size=300), st.integers(0, 99))
def test_merges_of_a_made_up_vocabulary(text, seed):
    """Ranks in any order, also of tokens that none of their parts precede."""
    tokens = sorted({text[i:j].encode() for i in range(min(9, len(text))) for j in range(i + 2, min(i + 6, len(text) + 1))})
    np.random.default_rng(seed).shuffle(tokens)
    lines = [bytes([b]) for b in range(256)] + tokens
    data = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(lines))
    own = bpe.Merger(bpe.Vocabulary(bpe.zlib.compress(data), r"(?s).+"))
    rank = {t: i for i, t in enumerate(lines)}
    parts = [text[i : i + 1].encode() for i in range(len(text))]
    while found := [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    want = [rank[p] for p in parts]
    assert own.encode(pa.array([[text]]))[0].tolist() == want and own._alone(text.encode()) == want


def test_ids_of_the_fixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = bpe.vocabulary(PATH, special=SPECIAL, as_text=True)
    rows = docs.select("text", tokenizing.ids(plain).one(tokenizing.pieces(F.col("text"), plain)).alias("ids"))
    rows = rows.select("text", "ids", tokenizing.decoded(plain).one(F.col("ids")).alias("back")).collect()
    assert len(rows) == 200
    for r in rows:
        assert r.ids == PLAIN.encode_ordinary(r.text) and r.back == r.text


def chunks(spark, chunker, *texts):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    rows = strategies.made(docs, chunker).orderBy("source_doc_id", "chunk_ord").collect()
    return [[r.c for r in rows if r.source_doc_id == f"d{i}"] for i in range(len(texts))]


def test_token_chunkers_over_byte_pairs(spark):
    docs = {f"doc_{r.doc_id:03d}": r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in sorted(catalog.queries()["bpe_fixed_token_chunking"](spark, SF).collect(), key=lambda r: (r.doc_id, r.chunk_ord)):
        got.setdefault(r.doc_id, []).append(r)
    for d, text in docs.items():
        ids = PLAIN.encode_ordinary(text)
        assert [r.text for r in got.get(d, [])] == [PLAIN.decode(ids[s : s + 50]) for s in range(0, len(ids), 40)], d
        assert [json.loads(r.metadata)["end_token"] for r in got.get(d, [])] == [min(s + 50, len(ids)) for s in range(0, len(ids), 40)]
    tokens = {n: 0 for n in catalog.MORE}
    for name in ("bpe_token_spans", "bpe_dynamic_token_size_chunking", "bpe_recursive_token_chunking"):
        rows = catalog.queries()[name](spark, SF).collect()
        assert rows
        for r in rows:
            n = len(PLAIN.encode_ordinary(r.text))
            tokens[name] = max(tokens[name], n)
            if "dynamic" in name:
                assert json.loads(r.metadata)["token_count"] <= 200
    assert tokens["bpe_token_spans"] >= 128


def test_a_cut_character_and_special_strings(spark):
    params = {"path": PATH, "special": SPECIAL}
    text = "漢字 😀😀 é" * 3
    for chunker, size, step in ((C.fixed_token(1, tokenizer=params), 1, 1), (C.sliding_token(3, 2, tokenizer=params), 3, 2), (C.overlapping_token(2, 1, tokenizer=params), 2, 1), (C.token_span(5, 4, tokenizer=params), 5, 4)):
        ids = PLAIN.encode(text)
        found, none = chunks(spark, chunker, text, "")
        assert [c.text for c in found] == [PLAIN.decode(ids[s : s + size]) for s in range(0, len(ids), step)] and not none
    assert "�" in chunks(spark, C.fixed_token(1, tokenizer=params), text)[0][0].text
    with pytest.raises(Exception, match="special token"):
        chunks(spark, C.fixed_token(5, tokenizer=params), "a <|endoftext|> b")
    (taken,) = chunks(spark, C.fixed_token(50, tokenizer=params | {"as_text": True}), "a <|endoftext|> b")
    assert taken[0].text == "a <|endoftext|> b"
    (dynamic,) = chunks(spark, C.dynamic_token(2, 4, tokenizer=params), "One two. Three four five six seven! 漢字 eight")
    assert "".join(c.text for c in dynamic).replace("�", "").startswith("One two.") and dynamic[0].text == "One two."
    with pytest.raises(Exception, match="unknown|unexpected"):
        strategies.chunker(strategies.spec("fixed_token", chunk_size=5, tokenizer={"file": "x"}))


PARAMS = {
    "fixed_character": {"chunk_size": 120, "overlap": 10}, "fixed_token": {"chunk_size": 30, "overlap": 5}, "overlapping_token": {"chunk_size": 30, "overlap_size": 5}, "sliding_token": {"window_size": 30, "step_size": 15},
    "token_span": {"span_size": 30, "step_size": 30}, "sentence_group": {"sentences_per_chunk": 3, "overlap": 1}, "paragraph_group": {"paragraphs_per_chunk": 2, "overlap": 1},
    "recursive": {"chunk_size": 120, "chunk_overlap": 10}, "recursive_token": {"chunk_size": 30, "chunk_overlap": 5}, "parent_child": {"parent_chunk_size": 120, "child_chunk_size": 60, "chunk_overlap": 10},
    "similarity_threshold": {"threshold": 0.3}, "semantic_variance": {"sensitivity": 0.2}, "topic": {"distance_threshold": 0.7}, "dynamic_token": {"min_chunk_size": 10, "max_chunk_size": 40}, "content_density": {"base_chunk_size": 100},
    "length_aware": {"target_length": 100, "tolerance": 20}, "llm_boundary": {"max_chars": 150, "overlap": 10}, "llm_segment": {"max_chars": 150, "overlap": 10},
}
TEXTS = ["The cat sat on the mat. The dog ran far away! Did the cat see it? No, the cat slept well.\n\nAnother day began. Rain fell on the roof of the old house. The dog came home. " * 2, "", "Short."]


def alone(spark, given, doc, text):
    rows = strategies.chunk(spark.createDataFrame([(doc, text)], "doc_id string, text string"), given).orderBy("chunk_ord").collect()
    return [(r.doc_id, r.chunk_id, r.text, r.metadata) for r in rows]


@pytest.mark.parametrize("shift", (7,))
@pytest.mark.parametrize("first", sorted(strategies.TYPES))
def test_hybrids_of_any_two(spark, first, shift):
    """The secondary's chunks of a long primary chunk are what it makes of that chunk as a document of its own."""
    kinds = sorted(strategies.TYPES)
    second = kinds[(kinds.index(first) + shift) % len(kinds)]
    primary, secondary = (strategies.spec(k, **PARAMS.get(k, {})) for k in (first, second))
    given = strategies.spec("hybrid", primary=primary, secondary=secondary, max_primary_size=90)
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(TEXTS)], "doc_id string, text string").coalesce(1)
    rows = strategies.chunk(docs, given).orderBy("source_doc_id", "chunk_ord").collect()
    got = [(r.doc_id, r.chunk_id, r.text, r.metadata) for r in rows if r.source_doc_id == "d0"]
    made = [(r.doc_id, r.chunk_id, r.text, r.metadata) for r in strategies.chunk(docs, primary).where("source_doc_id = 'd0'").orderBy("chunk_ord").collect()]
    long = spark.createDataFrame([(c, t) for _, c, t, _ in made if len(t) > 90], "doc_id string, text string")
    again = {}
    for r in strategies.chunk(long, secondary).orderBy("chunk_ord").collect():
        again.setdefault(r.source_doc_id, []).append((r.doc_id, r.chunk_id, r.text, r.metadata))
    want = [x for row in made for x in (again.get(row[1], []) if len(row[2]) > 90 else [row])]
    assert got == want and [r.chunk_ord for r in rows if r.source_doc_id == "d0"] == list(range(len(want)))


def test_nested_hybrids(spark):
    inner = strategies.spec("hybrid", primary=strategies.spec("similarity_threshold", threshold=0.3), secondary=strategies.spec("recursive", chunk_size=30, chunk_overlap=5), max_primary_size=40)
    both = strategies.spec("hybrid", primary=inner, secondary=inner, max_primary_size=20)
    outer = strategies.spec("hybrid", primary=strategies.spec("paragraph"), secondary=inner, max_primary_size=90)
    (doc,) = ([r for r in strategies.chunk(spark.createDataFrame([("d", TEXTS[0])], "doc_id string, text string"), outer).orderBy("chunk_ord").collect()],)
    want = []
    for _, c, t, m in alone(spark, strategies.spec("paragraph"), "d", TEXTS[0]):
        want += alone(spark, inner, c, t) if len(t) > 90 else [("d", c, t, m)]
    assert [(r.chunk_id, r.text) for r in doc] == [(c, t) for _, c, t, _ in want]
    assert strategies.chunk(spark.createDataFrame([("d", TEXTS[0])], "doc_id string, text string"), both).count() > 5


class Letters:
    """Vectors by first letters; counts its calls in a file."""

    def __call__(self, texts):
        return np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], dtype=float)


def test_encoders(spark):
    name = {"embedding_model": f"{__name__}:Letters"}
    sentences = ["aaa bbb.", "aab bba.", "zzz yyy.", "zzy yzz.", "aba bab."]
    text = " ".join(sentences)
    encode = Letters()
    unit = encode(sentences)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cuts = [i + 1 for i in range(4) if unit[i] @ unit[i + 1] < 0.6]
    want = [" ".join(sentences[a:b]) for a, b in zip([0, *cuts], [*cuts, 5])]
    found, one, none = chunks(spark, strategies.chunker(strategies.spec("similarity_threshold", threshold=0.6, **name)), text, "Only one.", "")
    assert [c.text for c in found] == want == ["aaa bbb. aab bba.", "zzz yyy. zzy yzz.", "aba bab."] and len(one) == 1 and not none
    (topic,) = chunks(spark, strategies.chunker(strategies.spec("topic", distance_threshold=0.4, **name)), text)
    assert [c.text for c in topic] == want and [json.loads(c.metadata)["topic_label"] for c in topic] == [0, 1, 0]
    around = [" ".join(sentences[max(0, i - 1) : i + 2]) for i in range(5)]
    near = encode(around)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    gaps = [round(1 - near[i] @ near[i + 1], 9) for i in range(4)]
    top = round(float(np.percentile(gaps, 95)), 9)
    cuts = [i + 1 for i in range(4) if gaps[i] > top]
    (broken,) = chunks(spark, C.semantic_breakpoints("x", encoder=Letters), text)
    assert [c.text for c in broken] == [" ".join(sentences[a:b]) for a, b in zip([0, *cuts], [*cuts, 5])]
    for kind, params in (("semantic_variance", {"sensitivity": 0.2}), ("semantic_boundary", {}), ("semantic_embedding", {})):
        assert chunks(spark, strategies.chunker(strategies.spec(kind, **params, **name)), text)[0]
    given = strategies.spec("hybrid", primary=strategies.spec("fixed_character", chunk_size=30, overlap=0), secondary=strategies.spec("topic", distance_threshold=0.4, **name), max_primary_size=10)
    assert len(chunks(spark, strategies.chunker(given), text)[0]) >= 3


def test_three_kinds_of_clusters_agree():
    rng = np.random.default_rng(2)
    for n in (2, 5, 40):
        words = pa.array([[str(x) for x in rng.integers(0, 8, size=rng.integers(1, 6))] for _ in range(n)])
        sentence, word, count, n_words = splitting._counts(words)
        unit = count / np.sqrt(np.bincount(sentence, weights=count * count, minlength=n))[sentence]
        dense = np.zeros((n, n_words))
        dense[sentence, word] = unit
        for threshold in (0.2, 0.5, 0.8):
            labels = splitting.topic_labels(words, threshold)
            assert labels == splitting.linked(splitting.Centroids(dense), threshold) == splitting.linked(splitting.Bags(sentence, word, unit, n, n_words), threshold)


def test_patterns_agree_with_the_library(spark):
    rows = spark.createDataFrame([("a  b  c\n\n d's 12 é漢 😀!",)], "t string").select(F.regexp_extract_all("t", F.lit("(?U)" + bpe.PATTERN), F.lit(0)).alias("p"), "t").first()
    assert rows.p == regex.findall(public_tokenizers.PATTERN, rows.t) and "".join(rows.p) == rows.t and T.TOKENS


TREEBANK = {
    'He said, "I can\'t go."': ["He", "said", ",", "``", "I", "ca", "n't", "go", ".", "''"],
    "They'll cost $5.50, won't they?": ["They", "'ll", "cost", "$", "5.50", ",", "wo", "n't", "they", "?"],
    "John's dogs' bowls (all 3) -- gone...": ["John", "'s", "dogs", "'", "bowls", "(", "all", "3", ")", "--", "gone", "..."],
    "I cannot; gimme that. 'Tis mine!": ["I", "can", "not", ";", "gim", "me", "that.", "'T", "is", "mine", "!"],
    "At 10:30 a.m. he left: a@b": ["At", "10:30", "a.m.", "he", "left", ":", "a", "@", "b"],
    "": [],
}


def test_treebank_words(spark):
    rows = spark.createDataFrame([(t,) for t in TREEBANK], "t string").select("t", T.treebank_words(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in rows} == TREEBANK


def test_treebank_rules_that_cannot_match_are_left_out(spark, monkeypatch):
    plain = spark.createDataFrame([("Some words, and more. Ein Mann kommt (bitte) immer.",), ("a",), (".",), ("",), (None,)], "t string")
    rows = spark.createDataFrame([(t + end,) for t in (*TREEBANK, "x", "I'll", "CANNOT", "a -- b", "gimme", "``q``", "wanna") for end in ("", ".", "..", ". ", ",", "'", '"', "\n", ".)")], "t string")
    # All rules, one after another, as they were applied to each sentence before.
    every = F.filter(F.split(T._ruled(F.col("t"), slice(0, None)), r"[ \t-\r]+"), lambda w: w != "")
    for r in rows.union(plain).select("t", T.treebank_words(F.col("t")).alias("got"), every.alias("want")).collect():
        assert r.got == r.want, r.t
    search, needless = F.regexp_replace, {p for p, _ in (*T.TREEBANK[:4], *T.TREEBANK[7:])}
    monkeypatch.setattr(F, "regexp_replace", lambda text, p, put: F.concat(text, F.lit(" searched")) if p in needless else search(text, p, put))
    got = plain.where("t is null or not contains(t, '. ')").select(T.treebank_words(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == [["a"], ["."], [], None]
    got = spark.createDataFrame([("Ein Mann, bitte; immer (so).",)], "t string").select(T.treebank_words(F.col("t")).alias("w")).first()
    assert got.w == ["Ein", "Mann", ",", "bitte", ";", "immer", "(", "so", ")", "."]


def test_far_sentences_are_not_compared_again(monkeypatch):
    asked = []
    plain = splitting.Matrix.to
    monkeypatch.setattr(splitting.Matrix, "to", lambda self, a: asked.append(a) or plain(self, a))
    words = pa.array([[f"a{i}", f"b{i}"] for i in range(100)] + [["a0", "b0", "c"], ["a1", "b1", "c"]])
    assert splitting.topic_labels(words, 0.4) == [*range(100), 0, 1]
    assert len(asked) < 20
    assert splitting.topic_labels(words[:0], 0.4) == [] and splitting.topic_labels(words[:1], 0.4) == [0]


def test_equally_near_sentences_keep_the_order_of_the_chain():
    rng = np.random.default_rng(5)
    none = 0
    for _ in range(200):
        n = int(rng.integers(2, 25))
        words = pa.array([[str(x) for x in rng.integers(0, 5, size=rng.integers(1, 4))] for _ in range(n)])
        sentence, word, count, n_words = splitting._counts(words)
        unit = count / np.sqrt(np.bincount(sentence, weights=count * count, minlength=n))[sentence]
        bags = [splitting.Bags(sentence, word, unit, n, n_words) for _ in range(2)]
        want, got = splitting.linked(bags[0], 0.4), splitting.linked_below(bags[1], 0.4)
        none += got is None
        assert got in (None, want) and splitting.topic_labels(words, 0.4) == want
    assert 0 < none < 200


def test_a_part_is_measured_once():
    asked = []
    found = splitting.recursive_split("ab cd ef", 20, 0, lambda t: asked.append(t) or len(t))
    assert found == ["ab cd ef"] and asked == ["ab", " cd", " ef"]
