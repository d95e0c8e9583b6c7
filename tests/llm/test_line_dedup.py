import hashlib

import duckdb
import xxhash

from textmill.llm import line_dedup, queries


def text_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42) if text is not None else 42
    return h - (1 << 64) if h >> 63 else h


def brute(rows, size=3):
    """(doc_id, text) of each row, plainly; rows with one id are ordered by the hash of the text."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]))):
        lines, covered = [] if text is None else text.split("\n"), set()
        for p in range(len(lines) - size + 1):
            key = tuple(lines[p : p + size])
            if key in seen:
                covered |= set(range(p, p + size))
            seen.add(key)
        out.append((doc_id, None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in covered)))
    return sorted(out, key=str)


def test_fixture_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r.text_md5 for r in queries.op9_line_dedup(spark, sf).collect()}
    assert got == {d: hashlib.md5(t.encode()).hexdigest() for d, t in brute(docs)}


def test_fixture_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(line_dedup.ORACLE).fetchall())
    assert sorted(map(tuple, queries.op9_line_dedup(spark, sf).collect())) == want


def test_hard_rows(spark):
    rows = [(4, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (9, "a\nb\nc"), (1, None), (3, ""), (5, "b\nc\nd\ne\na\nb\nc\na\nb\nc"), (6, "\n\n\n\n"), (None, "q\nb\nc\nd"), (7, "a\nb"), (8, "line \nb\nc"), (10, "z\n" * 3000)]
    df = spark.createDataFrame([(*r, "keep", 1) for r in rows], "doc_id long, text string, pos string, starts int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == brute(rows)
    assert all(r.pos == "keep" and r.starts == 1 for r in out.collect())
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    assert out.count() == len(rows)


def test_rows_that_share_an_id(spark):
    rows = [(1, "A\nB\nC\nD"), (2, "A\nB\nC\nzz"), (2, "keep1\nkeep2\nkeep3\nkeep4"), (3, "p\nq\nr\ns"), (3, "p\nq\nr\ns"), (3, "p\nq\nr\ns"), (None, "u\nv\nw"), (None, "u\nv\nw"), (4, "x\ny"), (4, "x\ny")]
    df = spark.createDataFrame([(*r, "a", "b", 1, "c") for r in rows], "doc_id long, text string, row string, key string, place int, `re.moved` string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == brute(rows) == sorted([(1, "A\nB\nC\nD"), (2, "zz"), rows[2], rows[3], (3, ""), (3, ""), rows[6], (None, ""), *rows[8:]], key=str)
    assert {(r.row, r.key, r.place, r["re.moved"]) for r in out.collect()} == {("a", "b", 1, "c")}


def test_plan_has_no_python(spark, sf):
    plan = queries.op9_line_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_hot_window_is_split_over_tasks(spark):
    """A passage in every text: the join that finds its later occurrences is dealt out anew by the adaptive plan."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(4000).selectExpr("struct(id AS doc_id, xxhash64(id) AS hash, id AS place) AS key", "concat('a\nb\nc\n', id, '\n', id + 1, '\n', id % 7) AS text").repartition(12)
        found = line_dedup.repeated_windows(rows)
        assert found.where("pos = 0").count() == 3999
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
