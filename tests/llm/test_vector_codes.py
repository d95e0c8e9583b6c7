import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textmill.llm import queries, vector_codes


def brute(values, book):
    """Nearest entries and distances, plainly."""
    all_ = ((values[:, None, :].astype(object) - book[None, :, :].astype(object)) ** 2).sum(axis=2) if book.shape[1] else np.zeros((len(values), len(book)), dtype=object)
    index = [min(range(len(book)), key=lambda k, r=r: (r[k], k)) for r in all_]
    return index, [r[i] for r, i in zip(all_, index)]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 40), st.integers(1, 30), st.integers(0, 12), st.sampled_from([1, 3, 1000, 1 << 24]))
def test_nearest_against_all_distances(seed, n, k, width, size):
    rng = np.random.default_rng(seed)
    values, book = rng.integers(-size, size + 1, (n, width)), rng.integers(-size, size + 1, (k, width))
    index, distance = vector_codes.nearest(values, book)
    assert (index.tolist(), distance.tolist()) == brute(values, book)


def plain(rows, rounds=4):
    """vec_id, code, error, label_error, hash of each (vec_id, vector, label), plainly."""
    kept = [(i, [max(-(1 << 24), min(1 << 24, math.floor(1024 * float(np.float32(x))))) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    width = len(first[0][1])
    cut = [i * width // 4 for i in range(5)]
    of = lambda v, p: v[cut[p] : cut[p + 1]]
    books = [[of(v, p) for _, v, _ in first if len(v) == width] for p in range(4)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (square(of(v, p), books[p][e]), e))
    fits = [r for r in kept if len(r[1]) == width]
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(4):
            groups = {}
            for _, v, _ in fits:
                groups.setdefault(near(v, p), []).append(of(v, p))
            for e, some in groups.items():
                new[p][e] = [sum(c) // len(c) for c in zip(*some)]
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for i, v, k in kept:
        code = error = None
        if len(v) == width:
            picks = [near(v, p) for p in range(4)]
            code, error = "".join(f"{e:02x}" for e in picks), sum(square(of(v, p), books[p][e]) for p, e in enumerate(picks))
            sums[k] = sums.get(k, 0) + error
        out.append((i, code, error, k))
    return sorted(((i, c, e, sums.get(k), sha) for i, c, e, k in out), key=str)


def test_fixture_against_sql_and_plain(spark, sf):
    got = sorted(map(tuple, queries.op13_vector_codes(spark, sf).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(f"select vec_id, code, error, label_error, codebooks_sha256 from ({vector_codes.ORACLE})").fetchall()
    assert got == sorted(want, key=str)
    rows = con.execute("select vec_id, embedding, label from embeddings").fetchall()[:300]
    small = spark.createDataFrame(rows, "vec_id long, vector array<float>, label int").repartition(3)
    assert sorted(map(tuple, vector_codes.encode(small).collect()), key=str) == plain(rows)


NAN, INF = float("nan"), float("inf")
HARD = [
    (5, [1.0, -0.5, 0.25, 2.0, 3.0], 1), (5, [1.0, -0.5, 0.25, 2.0, 2.0], 1), (5, [1.0, -0.5, 0.25, 2.0, 2.0], None), (None, [0.1] * 5, None), (7, None, 1), (8, [NAN] * 5, 1), (9, [1.0, None, 1.0, 1.0, 1.0], 2),
    (10, [INF, 0.0, 0.0, 0.0, 0.0], 2), (11, [1e30, -1e30, 0.0, 0.0, 0.0], 3), (12, [1.0, 2.0], 3), (13, [], 4), (14, [-0.0001] * 5, 2),
]


def test_hard_rows(spark):
    schema = "vec_id long, vector array<float>, label int, code string, numbers int, of int"
    rows = spark.createDataFrame([(*r, "x", 1, 2) for r in HARD], schema)
    assert sorted(map(tuple, vector_codes.encode(rows).collect()), key=str) == plain(HARD)
    assert vector_codes.encode(rows.limit(0)).count() == 0
    assert vector_codes.encode(rows.where("vec_id in (7, 8, 9, 10)")).count() == 0
    assert [tuple(r)[1:4] for r in vector_codes.encode(rows.where("vec_id = 13")).collect()] == [("00000000", 0, 0)]


def test_many_equal_vectors(spark):
    rows = [(i, [0.5] * 8 if i % 3 else [i / 100] * 8, 0 if i % 3 else i) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<float>, label int").repartition(5)
    assert sorted(map(tuple, vector_codes.encode(df).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("parts", (1, 7))
def test_any_partitioning_gives_one_result(spark, sf, parts):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("embedding", "vector")
    one = vector_codes.encode(rows.repartition(parts)).first()["codebooks_sha256"]
    assert one == queries.op13_vector_codes(spark, sf).first()["codebooks_sha256"]
