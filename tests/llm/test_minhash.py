import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from textmill.llm import minhash, queries, simhash, vectext
from textmill.llm.buckets import members_of
from textmill.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_brute_force(spark):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op6_minhash(spark, SF).collect()}
    assert len(got) == len(docs)
    errors = []
    for i, (d, t) in enumerate(docs):
        u = docs[(i + 1) % len(docs)][1]
        k = len(t) // 3
        e = t[: len(t) - k] + u[:k]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        errors += [r.near_edited - jaccard(shingles(t), shingles(e)), r.near_next - jaccard(shingles(t), shingles(u))]
        assert r.near_next == pytest.approx(1.0) or r.fingerprint != got[docs[(i + 1) % len(docs)][0]].fingerprint
    assert np.abs(errors).max() < 0.16 and np.sqrt(np.mean(np.square(errors))) < 0.035


def test_hard_rows(spark):
    docs = spark.createDataFrame([(3, None, "x"), (3, "", "x"), (None, "a b c d e f", "x"), (1, "a b c d e f", "x"), (0, "w%d " * 3 * 60000, "x")], "doc_id long, text string, fingerprint string")
    rows = minhash.fingerprints_and_edits(docs, partitions=3).collect()
    assert len(rows) == 5
    same = [r.fingerprint for r in rows if r.n_chars == 11]
    assert len(same) == 2 and len(set(same)) == 1
    assert sorted(round(r.near_next, 1) for r in rows if r.doc_id == 3) == [0.0, 1.0]
    assert minhash.fingerprints_and_edits(docs.limit(0)).count() == 0
    alone = minhash.fingerprints_and_edits(docs.where("doc_id = 1")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"a b c d a b").hexdigest()


def test_near_duplicates_against_brute_force(spark):
    base = [f"w{i}" for i in range(100)]
    texts = {1: " ".join(base), 2: " ".join(base[:98] + ["x", "y"]), 3: " ".join(base), 4: "a b", 5: "A  b", 6: "", 7: None, 8: " ".join(f"v{i}" for i in range(60))}
    texts |= {20 + i: " ".join(f"q{j}" if j != 7 * i + 3 else f"z{i}" for j in range(120)) for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    sets = {d: frozenset(shingles(t or "")) for d, t in texts.items()}
    want = {d: d for d in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if sets[a] == sets[b] or (sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8):
                    want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_hot_bucket_in_blocks(spark):
    """A chain of near copies and a crowd around one text, in one bucket: leaders alone do not link the chain."""
    base = [f"q{j}" for j in range(60)]
    texts = [" ".join(base[:j] + [f"z{j}"] + base[j + 1 :]) for j in range(0, 40, 2)]
    texts += [" ".join(f"c{(i + j) % 400}" for j in range(80)) for i in range(0, 60, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = minhash.shingle_sets(docs)
    one_bucket = sets.selectExpr("node", "0 as t", "7L as key")
    edges = minhash.near_links(members_of(one_bucket), sets, 0.7, block=6)
    got = {r.node: r.root for r in connected_components(edges).collect()}
    nodes = {tuple(sorted(r.shingles)): r.node for r in sets.collect()}
    assert len(nodes) == 40
    want = components({n: set(s) for s, n in nodes.items()}, 0.7)
    assert got == {n: r for n, r in want.items() if sum(v == r for v in want.values()) > 1} and len(set(got.values())) == 2


def components(sets, threshold):
    root = {n: n for n in sets}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in itertools.combinations(sets, 2):
        if find(a) != find(b) and 5 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])) and jaccard(sets[a], sets[b]) >= threshold:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {n: find(n) for n in sets}


def test_keep_one(spark):
    """Against brute force, with ids shared by unlike rows, equal rows, nulls and clashing names; with and without the
    covering tables of the SimHash."""
    rng = random.Random(4)
    rows = []
    for i in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))]
        for j in range(5):
            w = list(words)
            for _ in range(rng.randrange(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(5000)}"
            rows.append((10 * i + j if j < 4 else 10 * i, " ".join(w)))
    rows += [(500, None), (501, ""), (None, "only null id here with words"), (None, rows[0][1]), (7, "a b"), (7, "a b"), (8, "A  b"), (7, "something else altogether")]
    docs = spark.createDataFrame([(*r, "p", 1, "c") for r in rows], "doc_id long, text string, place string, class int, `row.x` string")
    sets = {i: shingles(t or "") for i, (_, t) in enumerate(rows)}
    root = components(sets, 0.8)
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    least = {r: min(order(i) for i in sets if root[i] == r) for r in set(root.values())}
    for keep in (minhash.keep_one, simhash.keep_one):
        got = keep(docs)
        assert got.columns == docs.columns
        found = [(r.doc_id, r.text) for r in got.collect()]
        assert len(found) == len(least)
        assert sorted((d is None, d or 0) for d, _ in found) == sorted(least.values())
        assert keep(docs.limit(0)).count() == 0


def test_query_returns_classes(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = components({d: shingles(t) for d, t in docs.items()}, 0.8)
    assert {r.doc_id: r.component_id for r in queries.op6_minhash(spark, SF).collect()} == want


def test_long_text_in_parts():
    text = pa.array([" ".join(f"w{i % 9973}" for i in range(400_000))], pa.large_string())
    assert len(list(vectext.parts(text, 4))) > 2
    x, _ = minhash.shingle_hashes(text)
    assert (minhash.distinct_shingles(text)[0] == np.unique(x)).all()
    assert (minhash.signatures(text)[0, 3] == (x * minhash.MULTIPLY[3] + minhash.ADD[3]).min()).all()
    ones, count = simhash.bit_counts(text, 4)
    assert (simhash.fingerprints_of(text) == np.packbits(2 * ones > count[:, None], axis=1).view(">u8").ravel()).all()


def test_signature_is_the_least_value():
    texts = pa.array(["a b c d e f g", "", "a b"], pa.large_string())
    x, begins = minhash.shingle_hashes(texts)
    s = minhash.signatures(texts)
    for lane in (0, 17, 255):
        v = x * minhash.MULTIPLY[lane] + minhash.ADD[lane]
        assert s[0, lane] == v[begins[0] : begins[1]].min() and s[2, lane] == v[begins[2]] and s[1, lane] == 0xFFFFFFFF
