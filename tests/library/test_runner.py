"""Times of documents, metrics from documents with their chunks, and what jobs took."""

import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.functions import lifted
from textmill.functions.lifted import PerValue
from textmill.operators import metrics
from textmill.operators.chunker import CHUNKS, Chunker, Hybrid
from textmill.plans import resources, runner, strategies

CASES = ["sentence_group_chunking", "topic_based_chunking", "recursive_chunking", "parent_child_chunking", "hybrid_recursive_fixed_token_chunking", "hybrid_semantic_sliding_window_chunking", "llm_segment_then_chunk"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = strategies.documents(spark.read.parquet(f"{sf}/documents.parquet"))
    odd = spark.createDataFrame([("none", None), ("empty", ""), ("space", " \n "), ("long", "Ein Satz. " * 3000)], "doc_id string, text string")
    return rows.unionByName(odd)


@pytest.mark.parametrize("name", CASES)
def test_timed_makes_the_same_chunks(docs, name):
    given = strategies.STRATEGIES[name]
    rows = strategies.timed(docs, strategies.chunker(given)).cache()
    plain, mine = strategies.chunk(docs, given).cache(), strategies.chunks_of(rows)
    assert mine.exceptAll(plain).isEmpty() and plain.exceptAll(mine).isEmpty()
    a, b = metrics.per_timed_document(rows), metrics.per_document(docs, plain)
    assert a.drop("chunking_time_sec").exceptAll(b).isEmpty() and b.exceptAll(a.drop("chunking_time_sec")).isEmpty()
    total, known = metrics.aggregated_timed(rows, name).first().asDict(), metrics.aggregated(docs, plain, name).first().asDict()
    assert {k: total[k] for k in known} == known and len(total) == len(known) + 3
    spent = sorted(r.spent for r in rows.collect())
    n = len(spent)
    micros = [round(x / 1000) for x in spent]
    assert n == docs.count() and spent[0] > 0
    assert total["total_chunking_time_sec"] == pytest.approx(sum(spent) / 1e9, abs=2e-6)
    assert total["average_chunking_time_sec"] == pytest.approx(sum(spent) / n / 1e9, abs=2e-6)
    assert total["median_chunking_time_sec"] == pytest.approx((micros[(n - 1) // 2] + micros[n // 2]) / 2e6, abs=2e-6)


def _slow(seconds):
    def run(texts):
        time.sleep(seconds)
        return texts

    one = lambda text: F.array(F.struct(text.alias("text"), F.lit("{}").alias("metadata"), F.lit("").alias("doc_suffix"), F.lit("_0").alias("id_suffix"))).cast(CHUNKS)
    return Chunker(lambda x: one(x.found), python=PerValue(run, "string"), ask=lambda text, _: text)


def test_time_of_a_python_function_goes_to_the_texts_it_got(spark):
    docs = spark.createDataFrame([("a", "x" * 9000), ("b", "y" * 1000), ("c", None)], "doc_id string, text string").coalesce(1)
    spent = {r.doc_id: r.spent / 1e9 for r in strategies.timed(docs, _slow(0.5)).collect()}
    assert 0.5 <= sum(spent.values()) < 1 and spent["a"] > 0.44 and 0.04 < spent["b"] < 0.1 and spent["c"] < 0.05
    twice = strategies.timed(docs, Hybrid(_slow(0.3), _slow(0.2), 5000)).collect()
    assert 0.5 <= sum(r.spent for r in twice) / 1e9 < 1.1


def test_time_of_an_expression_is_that_of_its_row(spark):
    # The first rows of a task also pay for its start; the least of several tells what a text costs.
    docs = spark.createDataFrame([("short", "A b. " * 10), ("long", "A b. " * 20000)] * 4, "doc_id string, text string").coalesce(1)
    rows = strategies.timed(docs, strategies.chunker(strategies.STRATEGIES["sentence_group_chunking"])).groupBy("doc_id").agg(F.min("spent").alias("spent")).collect()
    spent = {r.doc_id: r.spent for r in rows}
    assert spent["long"] > 5 * spent["short"] > 0


def test_sizes_and_shares():
    texts = pa.array(["abc", None, "", "é"])
    lists = pa.array([["abc", "d"], None, [], [None, "é"]], pa.list_(pa.string()))
    assert lifted.sizes_of(texts).tolist() == [3, 0, 0, 2] and lifted.sizes_of(lists).tolist() == [4, 0, 0, 2]
    assert lifted.sizes_of(pa.array([{"t": "ab", "n": 1}])).tolist() == [3] and lifted.sizes_of(lists[1:]).tolist() == [0, 0, 2]
    assert lifted.sizes_of(pa.array([[["ab"], ["c", "d"]], []], pa.list_(pa.list_(pa.string())))).tolist() == [4, 0]
    for values in (texts, texts[:0]):
        found = lifted.clocked(values, lambda x: x)
        assert found.field("v").equals(values) and all(x >= 0 for x in found.field("ns").to_pylist())


def test_metrics_of_no_documents(docs):
    rows = strategies.timed(docs.limit(0), strategies.chunker(strategies.STRATEGIES["sentence_based_chunking"]))
    total = metrics.aggregated_timed(rows, "s").first()
    assert (total.total_documents, total.total_chunks, total.total_chunking_time_sec, total.median_chunking_time_sec) == (0, 0, 0.0, 0.0)
    assert metrics.per_timed_document(rows).isEmpty()


def test_run_notes_times_resources_and_failures(docs, tmp_path):
    path = str(tmp_path / "run")
    out = runner.run_strategies(docs, path, {"s": strategies.spec("sentence"), "bad": strategies.spec("none"), "r": strategies.STRATEGIES["recursive_chunking"]})
    spark = docs.sparkSession
    s, bad, r = out
    assert s["total_documents"] == r["total_documents"] == docs.count() and "none" in bad["error"] and bad["resources"]["stages"] == 0
    for row in (s, r):
        took = row["resources"]
        assert row["elapsed_sec"] > 0 and row["total_chunking_time_sec"] > 0 and row["median_chunking_time_sec"] > 0
        assert took["stages"] > 2 and took["stages_unknown"] == took["failed_tasks"] == 0 and took["executor_cpu_sec"] > 0 and took["ram_peak_mb"] is not None
    each = spark.read.json(f"{path}/per_document/s")
    assert each.count() == docs.count() and each.agg(F.sum("chunking_time_sec")).first()[0] == pytest.approx(s["total_chunking_time_sec"], abs=1e-3)
    assert spark.read.parquet(f"{path}/s").count() == s["total_chunks"] and not os.listdir(f"{path}/_documents")
    first = runner.compare(docs, path).collect()
    assert first[-1].strategy == "bad" and first[0].resources.stages > 0 and first[0].total_chunking_time_sec <= first[1].total_chunking_time_sec


def test_groups_count_their_own_jobs_and_put_the_group_back(spark):
    context = spark.sparkContext
    context.setJobGroup("mine", "mine")
    with resources.watched(spark, "shuffled") as shuffled:
        spark.range(100000).groupBy((F.col("id") % 7).alias("k")).count().collect()
    with resources.watched(spark, "plain") as plain:
        spark.range(10).collect()
    with pytest.raises(ValueError), resources.watched(spark, "failed") as failed:
        raise ValueError
    assert shuffled["shuffle_bytes"] > 0 and plain["shuffle_bytes"] == 0 and plain["stages"] == 1 and failed["stages"] == 0
    assert context.getLocalProperty("spark.jobGroup.id") == "mine" and context.statusTracker().getJobIdsForGroup("mine") == []
    context.setLocalProperty("spark.jobGroup.id", None)
