"""Connected components of a graph given by its edges, by alternating large and small stars.

Each round is two joins with a minimum per node; nothing is collected but two counts. The
minimum is aggregated before the shuffle and written before it is joined: Spark splits the join of a
node with very many edges only where both sides come straight from a shuffle, not from an
aggregate over the same key. So a hub costs no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.storage import discard, materialize


def with_least(edges: DataFrame, least: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` (u, v) with the ``m`` of ``least`` (u, m), and the table to which that is written first."""
    least = materialize(least, "least")
    return edges.join(least, "u"), least


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (u, v) with u > v; a table."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    meant, first = with_least(both.where("v > u"), both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    large = materialize(meant.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
    joined, second = with_least(large, large.groupBy("u").agg(F.min("v").alias("m")))
    small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    out = materialize(small.where("u > v").distinct(), "edges")
    discard(first, large, second)
    return out


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a long, b long) -> (node, root): root is the least node of the component.
    Nodes without an edge to another node do not appear."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        before, now = now, _stars(now)
        discard(before)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
