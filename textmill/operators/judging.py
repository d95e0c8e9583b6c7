"""Grading of retrieved passages against reference answers, 0 to 2, best over the answers.

The grade comes from a provider; the default is a deterministic stand-in (the share of the
answer's terms that the passage holds), not a language model's judgement.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.lifted import PerValue
from textmill.functions.text import TERMS
from textmill.operators import providers

Judge = Callable[[Column, Column], tuple[Column, Column]]


def overlap_judge(answer: Column, passage: Column) -> tuple[Column, Column]:
    """(score, reason): 2 for at least half of the answer's distinct terms, 1 for a fifth, else 0."""
    terms = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(TERMS), F.lit(0)))
    shared, n = F.size(F.array_intersect(terms(answer), terms(passage))), F.size(terms(answer))
    score = F.when((n > 0) & (2 * shared >= n), 2).when((n > 0) & (5 * shared >= n), 1).otherwise(0)
    return score, F.format_string("%d of %d terms", shared, n)


def _apart(hits: DataFrame, top: int) -> DataFrame:
    """A row for each hit and answer."""
    rows = hits.where(F.col("rank") <= top).withColumn("answers", F.coalesce("answers", F.array().cast("array<string>")))
    return rows.select("query_id", "rank", "answers", "chunk_text", F.posexplode_outer("answers").alias("pos", "answer"))


def _best(graded: DataFrame, score: Column, reason: Column) -> DataFrame:
    clamped = F.greatest(F.lit(0), F.least(F.lit(2), F.coalesce(score, F.lit(0))))
    best = graded.select("query_id", "rank", "answers", "chunk_text", "pos", clamped.alias("score"), reason.alias("r")).groupBy("query_id", "rank").agg(
        F.first("answers").alias("reference_answers"), F.first("chunk_text").alias("chunk_text"), F.max("score").alias("relevance_score"), F.max_by("r", F.struct("score", -F.col("pos"))).alias("r")
    )
    return best.select("query_id", "rank", "reference_answers", "chunk_text", "relevance_score", F.when(F.col("relevance_score") > 0, F.coalesce("r", F.lit(""))).otherwise("").alias("llm_reason"))


def judge(hits: DataFrame, grade: Judge = overlap_judge, top: int = 5) -> DataFrame:
    """``hits`` (query_id, rank, answers array, chunk_text) -> those plus relevance_score and reason. The first
    of the answers with the best score wins; the reason stays empty where all score 0 or none is given."""
    graded = _apart(hits, top)
    return _best(graded, *grade(F.col("answer"), F.col("chunk_text")))


def judge_once(hits: DataFrame, question: providers.Question, path: str, top: int = 5) -> DataFrame:
    """The same by a model (``providers.grading``), each distinct answer and passage of the whole job asked once; answers are kept at ``path``."""
    graded = _apart(hits, top).withColumn("input", providers.pair(F.col("answer"), F.col("chunk_text")))
    known = providers.kept_answers(graded.select("input"), question, path)
    found = PerValue(providers.grade_of, providers.GRADE).add(graded.join(known.select("input", F.col("answer").alias("said")), "input", "left"), F.col("said"), "grade")
    return _best(found, F.col("grade.score"), F.col("grade.reason"))
