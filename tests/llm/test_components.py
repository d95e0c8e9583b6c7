"""Components against a plain union of sets, and the plan of a node with very many edges."""

import contextlib
import random

import pytest
from pyspark.sql import functions as F

from textmill.llm import components
from textmill.llm.components import connected_components

SCHEMA = "a long, b long"


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


@contextlib.contextmanager
def settings(spark, given):
    before = {k: spark.conf.get(k, None) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("kind", ["random", "path", "hub", "nothing", "loops"])
def test_components(spark, kind):
    dice = random.Random(kind)
    edges = {
        "random": [(dice.randrange(-300, 300), dice.randrange(-300, 300)) for _ in range(350)],
        "path": [(i, i + 1) for i in range(200)],
        "hub": [(1000, i) for i in range(500)] + [(2000, i) for i in range(499, 900)] + [(5, 5), (1000, 3), (3, 1000)],
        "nothing": [],
        "loops": [(1, 1), (2, 2)],
    }[kind]
    found = connected_components(spark.createDataFrame(edges, SCHEMA)).collect()
    assert len(found) == len({r.node for r in found}) and {r.node: r.root for r in found} == plain(edges)


def test_join_of_a_hub_is_split(spark):
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB"}
    never = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    with settings(spark, small | never | {"spark.sql.shuffle.partitions": "16"}):
        hub = spark.range(400_000).select(F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id")).cast("long").alias("u"), F.xxhash64("id").alias("v"))
        joined, _ = components.with_least(hub.repartition(8), hub.groupBy("u").agg(F.min("v").alias("m")))
        total = joined.agg(F.count("*").alias("n"), F.max("v").alias("v"), F.min("m").alias("m"))
        assert total.first().n == 400_000
        total.collect()
        assert "skew=true" in total._jdf.queryExecution().executedPlan().toString()
