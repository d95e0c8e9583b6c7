import random

import numpy as np
import pyarrow as pa

from textmill.llm import decontamination as d
from textmill.llm import queries
from textmill.llm.vectext import word_hashes, words_of

SF = "/root/testdata/sf0.001"


def brute(docs, items, share=d.SHARE):
    """(doc_id, item_id) of all windows within the distance, by the plain recurrence over all windows."""
    words = words_of(pa.array([t or "" for _, t in docs], pa.large_string()))
    codes = word_hashes(words)
    doc_of = np.repeat(np.arange(len(docs)), np.diff(words.docs))
    out = set()
    for item, text in items:
        w = words_of(pa.array([text], pa.large_string()))
        x = word_hashes(w)
        m = len(x)
        if not m or len(codes) < m:
            continue
        starts = np.arange(len(codes) - m + 1)
        starts = starts[doc_of[starts] == doc_of[starts + m - 1]]
        # a window within the distance shares most of its words with the item
        same = np.concatenate([[0], np.cumsum(np.isin(codes, x))])
        starts = starts[same[starts + m] - same[starts] >= m - int(share * m)]
        near = d.edit_distances(codes[starts[:, None] + np.arange(m)], np.repeat(x[None], len(starts), axis=0))
        out |= {(docs[doc_of[s]][0], item) for s in starts[near <= int(share * m + 1e-9)]}
    return out


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontamination(spark, SF).collect()}
    assert got == brute(docs, items) and got


def test_recall_at_the_full_distance():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(10, 60))) for _ in range(300)]
    items = d.Items(list(range(300)), texts, d.SHARE)
    docs = []
    for t in texts:
        w = t.split()
        for _ in range(int(d.SHARE * len(w))):
            k, kind = rng.randrange(len(w)), rng.random()
            w[k : k + (kind < 0.7)] = [rng.choice(vocabulary)] if kind < 0.7 or kind > 0.85 else []
        docs.append(" ".join(rng.choices(vocabulary, k=100) + w + rng.choices(vocabulary, k=100)))
    want = brute(list(enumerate(docs)), list(enumerate(texts)))
    got = {(doc, item) for doc, item, *_ in d.matches(pa.array(docs, pa.large_string()), items, d.SHARE)}
    assert got <= want and len(want) >= 240
    assert len(got) / len(want) >= 0.97, len(got) / len(want)


def test_recall_of_long_items_at_the_full_distance():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=n)) for n in (200, 300, 400, 500, 600) for _ in range(6)]
    items = d.Items(list(range(len(texts))), texts, d.SHARE)
    docs = []
    for t in texts:
        w = t.split()
        for _ in range(int(d.SHARE * len(w) * 0.95)):
            k, kind = rng.randrange(len(w)), rng.random()
            w[k : k + (kind < 0.7)] = [rng.choice(vocabulary)] if kind < 0.7 or kind > 0.85 else []
        docs.append(" ".join(rng.choices(vocabulary, k=100) + w + rng.choices(vocabulary, k=100)))
    want = brute(list(enumerate(docs)), list(enumerate(texts)))
    got = {(doc, item) for doc, item, *_ in d.matches(pa.array(docs, pa.large_string()), items, d.SHARE)}
    assert got <= want and len(want) >= 20
    assert len(got) / len(want) >= 0.9, len(got) / len(want)


def test_long_text_in_parts():
    item = " ".join(f"q{i}" for i in range(40))
    text = " ".join(f"w{i}" for i in range(300_000))
    docs = pa.array([f"{text} {item} {text} {item}"], pa.large_string())
    found = d.matches(docs, d.Items([7], [item], d.SHARE), d.SHARE)
    assert found == [(0, 0, 300_000, 40, 0)]


def test_edit_distance():
    a = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4]])
    b = np.array([[1, 2, 3, 4], [2, 3, 4, 5], [9, 9, 9, 9]])
    assert d.edit_distances(a, b).tolist() == [0, 2, 4]


def test_hard_rows_and_blocks(spark):
    text = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x " * 60000 + text.upper(), 1), (3, text, 1), (None, text, 1), (5, "one two", 1), (6, "two one", 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, text), (2, "one two"), (3, None), (4, "  "), (None, text)], "item_id long, text string")
    for block in (d.ITEM_BLOCK, 3):
        rows = sorted(((r.doc_id or -1, r.item_id or -1, r.distance) for r in d.find_items(docs, items, block=block).collect()))
        assert rows == [(-1, -1, 0), (-1, 1, 0), (3, -1, 0), (3, -1, 0), (3, 1, 0), (3, 1, 0), (5, 2, 0)]
    kept = d.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 6]
    assert d.find_items(docs, items.limit(0)).count() == 0 and d.find_items(docs.limit(0), items).count() == 0
