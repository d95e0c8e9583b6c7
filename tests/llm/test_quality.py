import zlib

import numpy as np
import pyarrow as pa

from textmill.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.op10_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(r.quality, rows[r.doc_id]) for r in labels if rows[r.doc_id].held_out]
    assert len(rows) == 1000 and len(held) > 50
    right = np.mean([q == r.predicted for q, r in held])
    assert right >= 0.97, right
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def test_model_and_scores_against_plain_versions(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in docs}
    feature = lambda t: quality.features(pa.array([t], pa.large_string()))[0].astype(np.int64)
    counts, n = np.ones((2, quality.BUCKETS)), len(labels)
    rows = {d: feature(docs[d]) for d in labels}
    for d, q in labels.items():
        for f in rows[d]:
            counts[q, f] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    frames = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(*frames)
    assert np.allclose(model.ratios, ratios)
    unit = {d: (v := ratios[f]) / max(np.linalg.norm(v), 1e-12) for d, f in rows.items()}
    y = {d: 2 * q - 1 for d, q in labels.items()}
    cost = {s: n / (2 * sum(v == s for v in y.values())) for s in (-1, 1)}

    def objective(weights, bias):
        return 0.5 * (weights @ weights + bias * bias) + sum(cost[y[d]] * max(0.0, 1 - y[d] * (weights[rows[d]] @ unit[d] + bias)) for d in rows)

    # Plain subgradient descent, another method for the same loss, gets no lower.
    weights, bias = np.zeros(quality.BUCKETS), 0.0
    best = objective(weights, bias)
    for t in range(1, 200):
        g, gb = weights.copy(), bias
        for d, f in rows.items():
            if y[d] * (weights[f] @ unit[d] + bias) < 1:
                g[f] -= cost[y[d]] * y[d] * unit[d]
                gb -= cost[y[d]] * y[d]
        weights, bias = weights - g / (t + 20), bias - gb / (t + 20)
        best = min(best, objective(weights, bias))
    assert objective(model.weights, model.bias) <= 1.01 * best
    got = {r.doc_id: r.score for r in quality.score(frames[0], model).collect()}
    for d in list(docs)[:200]:
        v = ratios[f := feature(docs[d])]
        margin = model.bias + (model.weights[f] @ v) / max(np.linalg.norm(v), 1e-12)
        assert abs(got[d] - 1 / (1 + np.exp(-(model.slope * margin + model.shift)))) < 1e-9
    again = {r.doc_id: r.score for r in quality.classify(frames[0].repartition(5), frames[1].repartition(3)).collect()}
    assert again == {r.doc_id: r.score for r in quality.classify(*frames).collect()}


def test_features_are_per_text():
    texts = ["A b. c", "", "A b. c", "b. c", "x x x x"]
    f, begins = quality.features(pa.array(texts, pa.large_string()))
    each = [set(f[a:b].tolist()) for a, b in zip(begins, begins[1:])]
    assert each[0] == each[2] and not each[1] and each[3] != each[0]
    for t, want in zip(texts, each):
        g, b = quality.features(pa.array([t], pa.large_string()))
        assert set(g.tolist()) == want and len(g) == len(want)


def test_hinge_fit_separates_and_respects_bounds():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 12) + (0 if i % 2 else 30)) for i in range(200)]
    y = np.arange(200) % 2
    w, b = quality.fit_hinge(rows, y, np.ones(80))
    assert ((quality.margins(rows, np.ones(80), w, b) > 0) == (y == 1)).mean() > 0.95


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "a b", "x"), (None, "a b", "x"), (4, "w " * 200000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (2, None), (99, 1), (4, 0)], "doc_id long, quality int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert quality.classify(docs, labels.limit(0)).where("score = 0.5").count() == 5
    assert quality.classify(docs.limit(0), labels).count() == 0
