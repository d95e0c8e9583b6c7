import pytest

import corpus_pipeline
from tests.llm.test_decontamination import brute
from tests.llm.test_minhash import components, shingles

SF = "/root/testdata/sf0.001"


def lines_kept(rows):
    """Plain removal of later occurrences of three-line windows, over (doc_id, text) by id."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now, was = docs, None
    for name, stage in corpus_pipeline.STAGES:
        was = [(r.doc_id, r.text) for r in now.collect()]
        made = stage(spark, now, SF)
        if name != "best-fit packing":
            assert made.columns == docs.columns and made.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        rows = made.collect()
        if name == "quality classifier":
            kept = {r.doc_id for r in rows}
            assert sum((d in kept) == (q == 1) for d, q in labels.items()) >= 0.95 * len(labels)
        elif name == "line dedup":
            assert {r.doc_id: r.text for r in rows} == lines_kept(was) and all(r.n_chars == len(r.text) for r in rows)
        elif name == "SimHash near-dedup":
            # One of each class of Jaccard similarity 0.8 or more on five-word shingles.
            assert sorted(r.doc_id for r in rows) == sorted(set(components({d: shingles(t) for d, t in was}, 0.8).values()))
        elif name == "benchmark decontamination":
            bad = {d for d, _ in brute(was, items)}
            assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in was if d not in bad)
        else:
            assert {r.doc_id for r in rows} == {d for d, _ in was}
        now = spark.createDataFrame(rows, made.schema)
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, SF).count() == len(rows)


HARD = [(1, None), (2, ""), (None, "no id but text of some words here and there"), (4, "x " * 100_000), (5, "a b c\nd e f\ng h i\nj"), (5, "a b c\nd e f\ng h i\nk"), (6, "same words in this row"), (6, "same words in this row")]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_hard_rows_in_each_stage(spark, name, stage):
    """Nulls, empty and long texts, shared ids, repeated rows, extra columns with names of the plans' own, and no n_chars."""
    docs = spark.createDataFrame([(*r, "row", 1, "key") for r in HARD], "doc_id long, text string, row string, place int, key string")
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name == "best-fit packing":
        assert sum(r.piece == 0 for r in rows) == len(HARD)
    else:
        assert out.columns == docs.columns and all((r.row, r.place, r.key) == ("row", 1, "key") for r in rows)
        wanted = {"line dedup": 8, "SimHash near-dedup": 6, "benchmark decontamination": 8}
        assert len(rows) == wanted.get(name, len(rows)) <= 8
    assert stage(spark, docs.limit(0), SF).count() == 0
