from itertools import permutations

import duckdb
import numpy as np
import pytest
import regex

from textmill.llm import filter_audit, queries

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def plain_masks(rows):
    """(part, set of failed filters, doc_id) of each (doc_id, source, text)."""
    out = []
    for doc_id, source, text in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
        fails |= {"D"} if set(text) & set("#$%&*|") else set()
        fails |= {"E"} if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, _, t in rows) else set()
        out.append((source or "", fails, doc_id))
    return out


def plain_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    masks, out, total = plain_masks(rows), {}, {}
    for part in {m[0] for m in masks}:
        for order in permutations("ABCDE"):
            left = [m for m in masks if m[0] == part]
            every = left
            for k, f in enumerate(order):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                failing = sum(f in m[1] for m in every)
                out[part, "".join(order), k + 1] = [len(left), len(gone), failing - len(gone), sum(m[1] == {f} for m in every), sum(m[2] in good for m in gone), sum(m[2] in toxic for m in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def collected(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.NUMBERS) for r in df.collect()}


@pytest.mark.parametrize("n", range(6))
def test_plain_changes_visit_every_order_once(n):
    order = list(range(n))
    seen = {tuple(order)}
    for at in filter_audit.plain_changes(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(permutations(range(n))))


def test_walk_against_sums_of_each_order():
    cells = np.random.default_rng(3).integers(0, 9, size=(4, 3, 32))
    for names, steps in filter_audit.walk(cells):
        before = 0
        for i, name in enumerate(names):
            bit = 1 << "ABCDE".index(name)
            want = sum(cells[:, :, m] for m in range(32) if m & before == 0 and m & bit)
            assert np.array_equal(steps[:, i], want)
            before |= bit


HARD = [
    (1, None, None), (2, "a", ""), (2, "b", ""), (3, "a", "x " * 60), (4, "a", "x " * 60), (4, "a", "x " * 60), (None, "a", "x " * 60), (None, None, "#" * 9),
    (5, "b", " ".join(f"w{i}" for i in range(80))), (6, "b", " ".join(f"w{i}" for i in range(80))), (7, "b", "LOUD " * 3000 + "é 漢|"), (8, "c", " ".join(f"W{i}\x0bq" for i in range(400))), (9, "", "one\x1ftwo"),
]
LABELS = [(2, 1, 0), (2, 0, 1), (4, 1, None), (5, None, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1), (7, 0, 0)]


def test_hard_rows(spark):
    docs = spark.createDataFrame([(*r, "x", 1, "z") for r in HARD], "doc_id long, source string, text string, part string, mask int, digest string")
    labels = spark.createDataFrame([(*r, 5) for r in LABELS], "doc_id long, quality int, toxic int, good int")
    got = collected(filter_audit.audit(docs, labels))
    assert len(got) == 600 * 4 and got == plain_audit(HARD, LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert {v[4] for v in collected(filter_audit.audit(docs, labels.limit(0))).values()} == {0}


def test_fixture_against_sql_and_plain_counts(spark, sf):
    got = collected(queries.op12_filter_audit(spark, sf))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    columns = ", ".join(filter_audit.NUMBERS)
    rows = con.execute(f"select part, filter_order, step, {columns} from ({filter_audit.ORACLE})").fetchall()
    assert got == {tuple(r[:3]): tuple(r[3:]) for r in rows}
    docs = con.execute("select doc_id, source, text from documents").fetchall()
    assert got == plain_audit(docs, con.execute("select doc_id, quality, toxic from labels").fetchall())


def test_rows_that_know_the_first_of_their_text_are_not_gathered(spark):
    """A third of all rows has one text: no task of the join on digest and id gets them together."""
    rows = spark.range(3000).selectExpr("id AS doc_id", "'s' AS source", "CASE WHEN id % 3 = 0 THEN 'copy' ELSE concat('t', id) END AS text")
    known = filter_audit.masks(rows).repartition(16, "digest", "doc_id")
    assert max(known.groupBy(filter_audit.F.spark_partition_id()).count().collect(), key=lambda r: r[1])[1] < 400
