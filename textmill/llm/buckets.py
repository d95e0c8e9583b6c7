"""Links among the members of hash buckets, without comparing all pairs of a large bucket.

``keyed`` (node long, t int, key long): node ``node`` is in bucket ``key`` of table ``t``. Two nodes that
share a bucket are to be compared, and are linked if they are close. The edges given back have
the components of all those links.

First every bucket names a leader, the member that meets most others over all its buckets (so the
original rather than one of its copies), and all members are compared with it: one row for each
member and leader, in a join that Spark may split. Mostly that makes one component of a bucket.
Where it does not, the members outside the leader's component are compared with all others:
in blocks of ``block``, each pair of blocks in a group of its own, so none meets in one task; members
known to be in one component are not compared with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.components import connected_components
from textmill.llm.runs import sorted_runs
from textmill.llm.storage import batches_of, materialize

Near = Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]]


def forest(roots: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links between components; ``roots`` names each member's component, and
    ``near`` tells which of some positions are close to one."""
    edges: list[tuple[int, int]] = []
    names, part = np.unique(roots, return_inverse=True)
    rest = np.argsort(np.bincount(part)[part], kind="stable")  # the small components first
    while len(rest) > 1:
        same = part[rest] == part[rest[0]]
        frontier, rest = rest[same].tolist(), rest[~same]
        while frontier and len(rest):
            x = frontier.pop()
            found = rest[near(x, rest)]
            if len(found):
                edges += [(x, int(y)) for y in found]
                joined = np.isin(part[rest], part[found])
                frontier += rest[joined].tolist()
                rest = rest[~joined]
    return edges


def members_of(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose bucket has another member, with their number as ``n``."""
    shared = materialize(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "shared-buckets")
    return materialize(keyed.join(shared, ["t", "key"]).select("t", "key", "node", "n"), "bucket-members")


def bucket_links(members: DataFrame, star: Callable[[DataFrame], DataFrame], near: Near, payload: DataFrame | None = None, block: int = 1000) -> DataFrame:
    """``members`` as given by ``members_of`` -> edges (a, b). ``star`` keeps those of (node, leader) that are close;
    ``near`` makes the test for the rows of a group; ``payload`` (node, ...) is what it needs beside the node."""
    fame = members.groupBy("node").agg(F.sum("n").alias("fame"))
    famous = members.join(fame, "node").groupBy("t", "key").agg(F.max(F.struct("fame", "node")).alias("most"))
    led = materialize(famous.select("t", "key", F.col("most.node").alias("leader")), "bucket-leaders")
    pairs = members.join(led, ["t", "key"]).where("node <> leader").select("node", "leader").distinct()
    edges = materialize(star(materialize(pairs, "leader-pairs")).select(F.col("node").alias("a"), F.col("leader").alias("b")), "leader-links")
    parts = materialize(connected_components(edges), "leader-parts")
    rooted = materialize(members.join(parts, "node", "left").select("t", "key", "node", F.coalesce("root", "node").alias("root")), "rooted-members")
    heads = materialize(led.join(parts, led["leader"] == parts["node"], "left").select("t", "key", F.coalesce("root", "leader").alias("head")), "bucket-heads")
    out = F.col("root") != F.col("head")
    sizes = rooted.join(heads, ["t", "key"]).groupBy("t", "key", "head").agg(F.count_if(out).alias("outs"), F.count_if(~out).alias("ins")).where("outs > 0")
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    heads = materialize(sizes.select("t", "key", "head", blocks("outs").alias("outs"), blocks("ins").alias("ins")), "open-buckets")
    # Blocks of members outside the leader's component come first; those inside only meet these.
    own = F.when(out, F.pmod(F.xxhash64("node"), "outs")).otherwise(F.col("outs") + F.pmod(F.xxhash64("node"), "ins")).cast("int")
    dealt = (
        rooted.join(heads, ["t", "key"])
        .select("t", "key", "node", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("outs") + F.when(out, F.col("ins")).otherwise(0) - 1)).alias("other"))
        .select("t", "key", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"), "node", "root")
    )
    if payload is not None:
        dealt = dealt.join(payload, "node")
    groups = ["t", "key", "c1", "c2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in sorted_runs(batches, 4):
            nodes, roots = rows.column("node").to_numpy(), rows.column("root").to_numpy()
            found = []
            for a, b in zip(begins.tolist(), begins[1:].tolist()):
                if (roots[a:b] != roots[a]).any():
                    found += [(nodes[a + i], nodes[a + j]) for i, j in forest(roots[a:b], near(rows.slice(a, b - a)))]
            links = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    rest = [c for c in dealt.columns if c not in groups]
    found = dealt.select(*groups, *rest).repartition(*groups).sortWithinPartitions(*groups).mapInArrow(run, "a long, b long")
    with batches_of(members.sparkSession, 10_000 if payload is None else 200):
        found = materialize(found, "block-links")
    return edges.unionByName(found)
