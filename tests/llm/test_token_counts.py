import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textmill.llm import queries, token_counts
from textmill.llm.subwords import public_path

PATH = public_path(token_counts.VOCABULARY)
COUNTER, PLAIN = token_counts.PrefixCounter(PATH), Tokenizer.from_file(PATH)
SYMBOLS = st.lists(st.sampled_from([*" \n\t\r\x0b\x1f\x85\xa0aaabcdehilmnorstv''!.,12#éÉİßΣ漢字😀̈́가<|>", "<|endoftext|>", "<|startoftext|>", "<|endo", "'re", "'ll", "'ve", "the", "ing", "token"]), max_size=25).map("".join)
HARD = [(1, None), (2, ""), (3, " a  b\n\n c "), (4, "Word! " * 5000), (5, "dup dup"), (5, "dup dup"), (None, "no id"), (7, "<|endoftext|> é 漢字 😀 <|ENDOFTEXT|>"), (8, "w" * 30000), (9, "'re" * 300)]


def plain(text):
    return len(PLAIN.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(SYMBOLS)
def test_every_prefix_has_the_tokens_that_the_library_finds(text):
    assert COUNTER.text_counts(text).tolist() == [plain(text[:i]) for i in range(len(text) + 1)]


def test_every_token_of_the_vocabulary_is_one_token():
    tokens = [COUNTER._bytes(t.removesuffix("</w>")) for t in PLAIN.get_vocab() if t.endswith("</w>")]
    assert {int(c[-1]) for c in COUNTER.counts(tokens)} == {1}


def test_long_words_as_short_ones():
    rng = np.random.default_rng(5)
    words = [bytes(rng.choice(np.frombuffer(b"aabcdeeinorst", dtype=np.uint8), size=n)) for n in (3, 40, 63, 64, 65, 200, 900)]
    for word, got in zip(words, COUNTER.counts(words)):
        assert np.array_equal(got, COUNTER._alone(word))
        assert got[:: max(1, len(word) // 50)].tolist() == [plain(word[: i + 1].decode()) for i in range(0, len(word), max(1, len(word) // 50))]


def test_fixture_against_the_library(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_token_counts(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = plain(docs[r.doc_id])
        assert tuple(r) == (r.doc_id, len(docs[r.doc_id].encode()), n, n > 2048)


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in HARD], "doc_id long, text string, n_tokens int, counts string, batch string")


def test_hard_rows(hard):
    got = sorted(map(tuple, token_counts.count(hard).collect()), key=str)
    assert got == sorted([(d, len((t or "").encode()), plain(t or ""), plain(t or "") > 2048) for d, t in HARD], key=str)
    assert token_counts.count(hard.limit(0)).count() == 0 and token_counts.prefixes(hard.limit(0)).count() == 0


def test_stored_counts_answer_without_the_text(hard):
    stored = token_counts.prefixes(hard).cache()
    texts = dict(HARD)
    places = (-1, 0, 1, 3, 17, 99, 40000)
    rows = stored.select("doc_id", "n_chars", "n_tokens", *[token_counts.tokens_before("counts", F.lit(p).cast("long")).alias(f"p{p}") for p in places]).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.n_chars == len(text) and r.n_tokens == plain(text)
        assert [r[f"p{p}"] for p in places] == [plain(text[: max(p, 0)]) for p in places]
    short = hard.where("doc_id <> 5 and length(text) < 2000")
    for budget in (0, 1, 3, 50):
        got = {r.doc_id: r.text for r in token_counts.truncated(short, stored, budget).collect()}
        for d, text in got.items():
            want = max(i for i in range(len(texts[d]) + 1) if plain(texts[d][:i]) <= budget)
            assert text == texts[d][:want]
