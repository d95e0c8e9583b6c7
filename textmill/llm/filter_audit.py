"""How filters of a corpus act on each other, in every order (operator 12).

Five filters, as conditions of failure, on a text and its words (runs of characters other than the six
ASCII white-space characters): A fewer than 50 words; B fewer than 65 distinct words in 100; C more than 5
of A-Z in 100 characters; D any of ``#$%&*|``; E the same text as a row with a smaller id, anywhere in the table.

A row's failures make a mask of five bits, so each part of the corpus comes down to 32 cells: rows, good
rows and toxic rows of each mask. All 120 orders are visited by a walk in which each order differs from the
one before by a single swap of neighbours (plain changes). Only the two swapped steps change, and they are
summed anew from the cells; a filter's Shapley sum takes a step's value, times the orders that it held,
when the step changes.

Scale: one scan of the texts leaves (id, part, digest, mask) of each row, written once. The first id of each text is an
aggregate over digests (SHA-256), and rows find out whether they are the first by a join on digest and id together, so no group
of copies meets in one task; labels are joined by id. Cells are summed before they are shuffled.

Edge cases: a null text is empty, and empty texts are the same text; a null source is the part ``''``; a null id is
no smaller than any, nor larger, and has no labels; of rows that share an id and a text none fails E by the other; a row is good or toxic if any label row of
its id says so; one very long text is one row; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.storage import discard, materialize

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in NUMBERS)


def plain_changes(n: int) -> Iterator[int]:
    """Places of the swaps that lead through all orders of ``n`` things, each a swap of the thing there and the next:
    the last thing moves through all others from end to end, and between two such runs the others make a swap of their own."""
    if n < 2:
        return
    down = True
    for inner in [*plain_changes(n - 1), None]:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        if inner is not None:
            yield inner + 1 if down else inner
        down = not down


def walk(cells: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """``cells``: (parts, 3, 2 ** n), the rows, good and toxic rows of each mask -> all orders of the n filters, each with
    its array of (parts, n, 3): rows, good and toxic rows that each step removes. The array is changed in place
    from one order to the next."""
    n = cells.shape[2].bit_length() - 1
    masks = np.arange(1 << n)
    order = list(range(n))
    steps = np.zeros((len(cells), n, 3), dtype=np.int64)

    def settle(i: int) -> None:
        before = sum(1 << f for f in order[:i])
        steps[:, i] = cells[:, :, (masks & before == 0) & (masks >> order[i] & 1 == 1)].sum(axis=2)

    for i in range(n):
        settle(i)
    names = lambda: "".join(FILTERS[f] for f in order)
    yield names(), steps
    for at in plain_changes(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        settle(at)
        settle(at + 1)
        yield names(), steps


def audit_cells(cells: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """``cells`` as for ``walk`` -> all orders, each with (parts, n, numbers), as in ``NUMBERS``."""
    n = cells.shape[2].bit_length() - 1
    masks = np.arange(1 << n)
    total = cells[:, 0].sum(axis=1)
    fails = np.stack([cells[:, 0, masks >> f & 1 == 1].sum(axis=1) for f in range(n)], axis=1)
    alone = np.stack([cells[:, 0, 1 << f] for f in range(n)], axis=1)
    shapley = np.zeros((len(cells), n), dtype=np.int64)
    held = np.zeros((len(cells), n), dtype=np.int64)  # what each filter removes at its step now
    since = [0] * n
    out, last = [], ""
    for k, (names, steps) in enumerate(walk(cells)):
        for i, name in enumerate(names):
            if not last or last[i] != name:
                f = FILTERS.index(name)
                shapley[:, f] += held[:, f] * (k - since[f])
                held[:, f], since[f] = steps[:, i, 0], k
        of = [FILTERS.index(x) for x in names]
        removed = steps[:, :, 0]
        kept = total[:, None] - np.cumsum(removed, axis=1)
        out.append((names, np.stack([kept, removed, fails[:, of] - removed, alone[:, of], steps[:, :, 1], steps[:, :, 2], np.zeros_like(removed)], axis=2)))
        last = names
    for f in range(n):
        shapley[:, f] += held[:, f] * (len(out) - since[f])
    for names, numbers in out:
        numbers[:, :, -1] = shapley[:, [FILTERS.index(x) for x in names]]
    return out


def failures(text: Column, words: Column) -> Column:
    """The bits of A to D of a text that isn't null, and its words."""
    n = F.size(words)
    conditions = (n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def masks(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, text) -> doc_id, part, digest of the text, mask of A to D."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    worded = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    return worded.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failures(F.col("text"), F.col("words")).alias("mask"))


def cells_of(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` as given by ``masks``, written -> part, mask with E, and how many rows, good and toxic rows it has."""
    # Written, since Spark splits the large partitions of a join only if nothing stands between it and its shuffles.
    firsts = materialize(rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "audit-firsts")
    said = labels.where("(quality = 1 or toxic = 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = materialize(said.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "audit-labels")
    known = rows.where("doc_id is not null").join(firsts.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left").join(said, "doc_id", "left")
    repeats = F.when(F.col("first").isNull(), 16).otherwise(0)
    each = known.select("part", (F.col("mask") + repeats).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    each = each.unionByName(rows.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))
    found = materialize(each.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")), "audit-cells")
    discard(firsts, said)
    return found


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, text), ``labels`` (doc_id, quality, toxic) -> ``RESULT``: a row for each part, order and step."""
    rows = materialize(masks(docs), "audit-masks")
    cells = cells_of(rows, labels)
    discard(rows)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 50) for i in range(0, batch.num_rows, 50)):
                table = np.zeros((some.num_rows, 3, 1 << len(FILTERS)), dtype=np.int64)
                for k, found in enumerate(some.column(1).to_pylist()):
                    for c in found:
                        table[k, :, c["mask"]] = c["n"], c["good"], c["toxic"]
                for order, numbers in audit_cells(table):
                    n = len(FILTERS)
                    flat = numbers.reshape(-1, len(NUMBERS))
                    parts = some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), n)))
                    columns = [parts, pa.array([order] * len(flat)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), some.num_rows)), *(pa.array(flat[:, i]) for i in range(len(NUMBERS)))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    # A part has 32 cells at most.
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).mapInArrow(run, RESULT)


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (SELECT part, doc_id, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM t
), x AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, false)::INT) AS good, sum(coalesce(toxic, false)::INT) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), b AS (SELECT unnest(range(0, 5)) AS i
), p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM b a, b, b c, b d, b e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', i::INT + 1, 1)), '') AS filter_order, k.i::INT + 1 AS step, (1 << o[k.i + 1]::INT) AS f,
  coalesce(list_sum(list_transform(o[1:k.i], lambda i: 1 << i::INT)), 0)::INT AS before FROM p, b k
), r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (mask & (before | f) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & f > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before > 0 AND mask & f > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & f > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & f > 0), 0)::BIGINT AS toxic_lost
  FROM x, s GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""
