"""Models asked side by side, with time limits, and once for the whole job."""

import json
import os
import time
import uuid

from pyspark.sql import functions as F

from textmill.operators import chunkers as C
from textmill.operators import judging, providers
from textmill.plans import strategies


def test_calls_side_by_side_in_order_with_a_limit():
    def complete(prompt):
        time.sleep({"slow": 5, "late": 0.2}.get(prompt, 0.01))
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    began = time.monotonic()
    prompts = ["slow", "a", "bad", "late", *(f"p{i}" for i in range(40)), "slow"]
    found = providers.ask_all(complete, prompts, providers.Limits(4, 0.5))
    assert time.monotonic() - began < 3
    assert [a for a, _ in found] == [None, "A", None, "LATE", *(f"P{i}" for i in range(40)), None]
    assert found[0][1] == "no answer in 0.5 s" and found[2][1] == "ValueError: no" and found[1][1] is None
    assert providers.ask_all(complete, []) == []


class Model:
    """Answers with a cut after the first word; writes a file for each prompt it gets."""

    def __init__(self, log):
        self.log = log

    def complete(self, prompt):
        with open(f"{self.log}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        if "REFERENCE" in prompt:
            return '{"score": 2, "reason": "same"}' if prompt.split("REFERENCE:\n")[1].split("\n")[0] in prompt.split("PASSAGE:\n")[1] else "[0]"
        text = prompt.split("[TEXT]\n")[1].split("\n[/TEXT]")[0]
        if "fail" in text:
            raise TimeoutError
        at = text.index(" ")
        return json.dumps({"segments": [{"start": 0, "end": at, "type": "qa"}, {"start": at, "end": len(text)}]} if "segments" in prompt else {"boundaries": [at]})


def said(log):
    return sorted(open(f"{log}/{f}").read() for f in os.listdir(log))


def rows_of(spark, chunker, docs):
    return sorted((r.source_doc_id, r.chunk_ord, r.c.text, r.c.metadata) for r in strategies.made(docs, chunker).collect())


def test_each_distinct_text_is_asked_once(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "kept")
    os.mkdir(log)
    uneven = f"{'X' * 19}. B. {'Y' * 19}. C. "
    texts = [uneven, "A b. C d. ", uneven, uneven.replace("B", "fail"), "", uneven] * 5
    docs = spark.createDataFrame([(f"d{i:02d}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(6)
    factory = lambda: Model(log)
    here = rows_of(spark, C.llm_boundary(20, 3, boundaries=providers.boundaries(factory)), docs)
    assert len(said(log)) > 2
    for f in os.listdir(log):
        os.remove(f"{log}/{f}")
    once = C.llm_boundary(20, 3, boundaries=providers.boundaries(factory, path=path))
    assert rows_of(spark, once, docs) == here
    asked = said(log)
    assert len(asked) == len(set(asked)) == 2 and not any("A b" in p for p in asked)  # even texts are not asked
    errors = spark.read.parquet(f"{path}/answers").where("error is not null").collect()
    assert [r.error for r in errors] == ["TimeoutError: "]
    assert rows_of(spark, once, docs) == here and len(said(log)) == 3  # only what failed is asked again


def test_lists_keep_their_order(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "kept")
    os.mkdir(log)
    blocks = ["one two three", "abc", "four five six", "fail fail fail", "one two three"]
    docs = spark.createDataFrame([("a", "\n\n".join(blocks)), ("a", "\n\n".join(blocks)), ("b", "\n\n".join(blocks[::-1])), ("c", ""), ("d", None)], "doc_id string, text string").repartition(4)
    factory = lambda: Model(log)
    make = lambda **k: C.llm_segment(100, 0, segments=providers.segments(factory, **k), ask_above=5)
    here = rows_of(spark, make(), docs)
    once = rows_of(spark, make(path=path), docs)
    assert once == here and [r[2] for r in once if r[0] == "b"] == ["one", " two three", "fail fail fail", "four", " five six", "abc", "one", " two three"]
    for f in os.listdir(log):
        os.remove(f"{log}/{f}")
    assert rows_of(spark, make(path=str(tmp_path / "other")), docs) == here and len(said(log)) == 3


def test_grades_once(spark, tmp_path):
    log = str(tmp_path / "log")
    os.mkdir(log)
    hits = spark.createDataFrame([(q, r, ["alpha", "beta"], "has beta" if r % 2 else "none") for q in range(6) for r in (1, 2, 3, 9)] + [(9, 1, None, "x"), (9, 2, ["z"], None)], "query_id int, rank int, answers array<string>, chunk_text string").repartition(5)
    question = providers.grading(lambda: Model(log))
    got = judging.judge_once(hits, question, str(tmp_path / "kept"))
    plain = judging.judge(hits, providers.grades(lambda: Model(log)))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    best = {(r.query_id, r.rank): (r.relevance_score, r.llm_reason) for r in got.collect()}
    assert best[0, 1] == (2, "same") and best[0, 2] == (0, "") and best[9, 1] == (0, "") and (0, 9) not in best
    assert spark.read.parquet(str(tmp_path / "kept")).groupBy("input").count().where(F.col("count") > 1).count() == 0
