import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from textmill.llm import queries, simhash
from textmill.llm.components import connected_components
from textmill.llm.vectext import word_hashes, words_of, xxh64


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = {}
    for doc_id, text in rows:
        fps[doc_id] = brute_fingerprint(text)
    parent = {d: d for d in fps}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 4:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {d: (f"{fps[d]:016x}", find(d)) for d in fps}


def test_xxh64_and_words():
    rng = random.Random(3)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(0, 100), 200, 1000]]
    data = np.frombuffer(b"".join(parts) + bytes(16), dtype=np.uint8)
    lengths = np.array([len(p) for p in parts])
    got = xxh64(data, np.cumsum(lengths) - lengths, lengths, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]
    texts = ["", "  A b\tC ", "x", "É a a", "\n", "last"]
    w = words_of(pa.array(texts, pa.large_string()))
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)] == ["a", "b", "c", "x", "É", "a", "a", "last"]
    assert np.diff(w.docs).tolist() == [0, 3, 1, 3, 0, 1]
    h = word_hashes(w).tolist()
    assert h[0] == h[5] == h[6] and len(set(h)) == 6


def test_masks_cover_every_choice_of_bits():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks()]
    assert len(masks) == 31
    rng = random.Random(1)
    for _ in range(20000):
        x = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(x & m == 0 for m in masks)


def test_fixture_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, sf).collect()}
    assert got == brute(docs)


def test_hard_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(1, None), (2, ""), (3, " \n"), (4, base), (5, base + " tail"), (6, base.upper()), (7, "a b"), (8, "A\tb"), (9, "x" * 100000), (10, base + " other end")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == brute(rows)
    twice = simhash.near_duplicates(df.unionByName(df)).collect()
    assert len(twice) == 20 and {(r.doc_id, (r.fingerprint, r.component_id)) for r in twice} == set(brute(rows).items())
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(nulls).collect()] == [3, 3, 3]


def test_large_buckets_are_compared_in_blocks(spark):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:
        x = centre
        for b in rng.sample(range(64), rng.randrange(1, 7)):
            x ^= 1 << b
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, 16)
    got = {r.node: r.root for r in connected_components(edges).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(signed, 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    sizes = {x: find(x) for x in signed}
    linked = {x: r for x, r in sizes.items() if sum(v == r for v in sizes.values()) > 1}
    assert got == linked


def test_components_of_a_path_and_a_star(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1000, 1200).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b"))
    got = {r.node: r.root for r in connected_components(path.union(star)).collect()}
    assert all(got[i] == 0 for i in range(301))
    assert all(got[i] == 1000 for i in range(1000, 1200)) and got[5000] == 1000
