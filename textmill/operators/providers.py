"""Answers of a language model as columns. A provider is made once in each task by a factory, so
that a client or a model is loaded once; it has one method, ``complete(prompt) -> text``. A failed, late or
unreadable answer is null, and the caller keeps what it had; failures are counted in the worker's log.

A task asks ``Limits.at_once`` prompts side by side and gives each ``Limits.seconds``. By default the distinct texts of a batch are asked
where they stand. With ``path=`` (a folder that all executors share) the distinct texts of the whole job are asked once, in a job of their own, whose answers are kept
there with their errors and joined back; another run over the same folder asks only what it has no answer for. That needs
a batch plan; streams, and chunkers that cut the chunks of others, ask where they stand.
"""

from __future__ import annotations

import json
import logging
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.lifted import PerValue, listed

KINDS = "heading_block|list|code|paragraph|qa|other"  # fixed value: the kinds of segments
ANSWERS = "input string, answer string, error string"


class Provider(Protocol):
    def complete(self, prompt: str) -> str: ...


class Limits(NamedTuple):
    """``at_once``: calls side by side in a task; ``seconds``: for each call."""

    at_once: int = 8
    seconds: float = 30.0


class Question(NamedTuple):
    """What is asked about a text, of whom, within which limits."""

    factory: Callable[[], Provider]
    prompt: Callable[[str], str]
    limits: Limits = Limits()


def ask_all(complete: Callable[[str], str], prompts: list[str], limits: Limits = Limits()) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each prompt, in order. A call that takes longer than its time is given up; its thread may still end later, but
    holds nobody up."""
    out: list[tuple[str | None, str | None]] = [(None, "not asked")] * len(prompts)
    ended: queue.SimpleQueue = queue.SimpleQueue()

    def call(i: int) -> None:
        try:
            ended.put((i, (complete(prompts[i]), None)))
        except Exception as e:  # whatever a client may raise
            ended.put((i, (None, f"{type(e).__name__}: {e}")))

    began: dict[int, float] = {}
    following = 0
    while following < len(prompts) or began:
        while following < len(prompts) and len(began) < limits.at_once:
            began[following] = time.monotonic()
            threading.Thread(target=call, args=(following,), daemon=True).start()
            following += 1
        first = min(began.values()) + limits.seconds
        try:
            i, found = ended.get(timeout=max(0.0, first - time.monotonic()))
            if i in began:  # else it was given up
                del began[i]
                out[i] = found
        except queue.Empty:
            now = time.monotonic()
            for i in [i for i, at in began.items() if now - at >= limits.seconds]:
                del began[i]
                out[i] = None, f"no answer in {limits.seconds:g} s"
    failed = sum(e is not None for _, e in out)
    if failed:
        logging.getLogger(__name__).warning("%d of %d prompts failed, the first with: %s", failed, len(out), next(e for _, e in out if e is not None))
    return out


def _provider(made: list, factory: Callable[[], Provider]) -> Provider:
    """Made in the task, not on the driver."""
    if not made:
        made.append(factory())
    return made[0]


def answers(inputs: DataFrame, question: Question) -> DataFrame:
    """``inputs`` (input) -> ``ANSWERS``: each distinct text asked once."""
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = ask_all(_provider(made, question.factory).complete, [question.prompt(t) for t in texts], question.limits) if texts else []
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([a for a, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["input", "answer", "error"])

    return inputs.where("input is not null").distinct().mapInArrow(run, ANSWERS)


def kept_answers(inputs: DataFrame, question: Question, path: str) -> DataFrame:
    """``answers``, kept at ``path``: texts that have one there are not asked again, those that failed are."""
    spark = inputs.sparkSession

    def known() -> DataFrame | None:
        try:
            return spark.read.schema(ANSWERS).parquet(path).where("error is null")
        except AnalysisException:  # nothing there yet
            return None

    before = known()
    new = inputs if before is None else inputs.join(before, "input", "left_anti")
    answers(new, question).write.mode("append").parquet(path)
    return known()


def read_json(answer: str | None) -> dict | list | None:
    """The JSON of an answer: all of it, or else the first object or array in it, whatever stands around (a code fence, a sentence)."""
    if answer is None:
        return None
    decoder = json.JSONDecoder()
    for at, c in enumerate(answer):
        if c in "{[":
            try:
                return decoder.raw_decode(answer, at)[0]
            except ValueError:
                continue
    return None


def _object(answer: str | None) -> dict:
    found = read_json(answer)
    return found if isinstance(found, dict) else {}


def whole(value) -> int | None:
    """A whole number, also one given as text."""
    try:
        return int(value)
    except (TypeError, ValueError, OverflowError):
        return None


class Asked(PerValue):
    """A question about texts, or about lists of texts if ``lists``, whose answers ``parse`` turns into an Arrow array of the type ``kind``."""

    def __init__(self, question: Question, parse: Callable[[str | None], object], kind: pa.DataType, result: str, lists: bool = False, path: str | None = None):
        made: list = []

        def parsed(found: list[str | None]) -> pa.Array:
            return pa.array([parse(x) for x in found], kind)

        def here(texts: pa.Array) -> pa.Array:
            plain = texts.to_pylist()
            distinct = list({t: None for t in plain if t is not None})
            found = ask_all(_provider(made, question.factory).complete, [question.prompt(t) for t in distinct], question.limits) if distinct else []
            by = dict(zip(distinct, (a for a, _ in found)))
            return parsed([None if t is None else by[t] for t in plain])

        super().__init__((lambda batch: listed(batch, here)) if lists else here, f"array<{result}>" if lists else result)
        self.question, self.lists, self.path = question, lists, path
        self.parse = PerValue(lambda found: parsed(found.to_pylist()), result)

    def add(self, df: DataFrame, value: Column, out: str) -> DataFrame:
        """With a path: the rows are written, their distinct texts asked, and the answers joined to the rows as read back."""
        if self.path is None or df.isStreaming:
            return super().add(df, value, out)
        spark, place = df.sparkSession, f"{self.path}/rows-{uuid.uuid4().hex}"
        df.withColumn("_asked", value).withColumn("_row", F.monotonically_increasing_id()).write.parquet(place)
        rows = spark.read.parquet(place)
        if not self.lists:
            known = kept_answers(rows.select(F.col("_asked").alias("input")), self.question, f"{self.path}/answers")
            joined = rows.join(known.select(F.col("input").alias("_asked"), "answer"), "_asked", "left")
            return joined.withColumn(out, self.parse.one(F.col("answer"))).drop("_asked", "_row", "answer")
        each = rows.select("_row", F.posexplode("_asked").alias("pos", "input"))
        known = kept_answers(each.select("input"), self.question, f"{self.path}/answers")
        found = each.join(known.select("input", "answer"), "input", "left").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("pos", "answer"))).alias("_found"))
        joined = rows.join(found, "_row", "left").withColumn("_answers", F.coalesce("_found.answer", F.array().cast("array<string>")))
        return joined.withColumn(out, self.parse.many(F.col("_answers"))).drop("_asked", "_row", "_found", "_answers")

    def add_timed(self, df: DataFrame, value: Column, out: str, spent: str) -> DataFrame:
        """Answers that the whole job shares take no document's own time."""
        return super().add_timed(df, value, out, spent) if self.path is None or df.isStreaming else self.add(df, value, out)


def _framed(task: str, text: str) -> str:
    return f"{task}\n\n[TEXT]\n{text}\n[/TEXT]"


def boundaries(factory: Callable[[], Provider], limits: Limits = Limits(), path: str | None = None) -> Asked:
    """The places to cut a text at, as a model gives them: array<int>, or null."""
    task = 'Where should the text below be cut into coherent parts? Answer with the character positions, as JSON: {"boundaries": [int]}'

    def cuts(answer: str | None) -> list[int] | None:
        values = _object(answer).get("boundaries")
        return [n for v in values if (n := whole(v)) is not None and abs(n) < 1 << 31] if isinstance(values, list) else None

    return Asked(Question(factory, lambda text: _framed(task, text), limits), cuts, pa.list_(pa.int32()), "array<int>", path=path)


def segments(factory: Callable[[], Provider], limits: Limits = Limits(), path: str | None = None) -> Asked:
    """The segments of each of a list of texts: array<array<struct<start, end, type>>>, null for null."""
    task = f'Which coherent units does the text below consist of? Answer as JSON: {{"segments": [{{"start": int, "end": int, "type": "{KINDS}"}}]}}'

    def parts(answer: str | None) -> list[dict] | None:
        values = _object(answer).get("segments")
        if not isinstance(values, list):
            return None
        rows = [(whole(v.get("start")), whole(v.get("end")), v.get("type")) for v in values if isinstance(v, dict)]
        return [{"start": a, "end": b, "type": k if isinstance(k, str) else None} for a, b, k in rows if a is not None and b is not None and max(abs(a), abs(b)) < 1 << 31]

    one = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))
    return Asked(Question(factory, lambda text: _framed(task, text), limits), parts, one, "array<struct<start int, end int, type string>>", lists=True, path=path)


def grading(factory: Callable[[], Provider], limits: Limits = Limits()) -> Question:
    """How relevant a passage is to an answer, given as a JSON array of the two."""
    task = 'How relevant is the passage to the reference, from 0 to 2? Answer as JSON: {"score": int, "reason": str}'

    def prompt(pair: str) -> str:
        answer, passage = json.loads(pair)
        return f"{task}\n\nREFERENCE:\n{answer}\n\nPASSAGE:\n{passage}"

    return Question(factory, prompt, limits)


GRADE = "struct<score int, reason string>"


def grade_of(found: pa.Array) -> pa.Array:
    """Answers -> score and reason, null where there is no usable score."""
    rows = [_object(x) for x in found.to_pylist()]
    return pa.array([{"score": whole(x.get("score")), "reason": None if x.get("reason") is None else str(x["reason"])} for x in rows], pa.struct([("score", pa.int32()), ("reason", pa.string())]))


def grades(factory: Callable[[], Provider], limits: Limits = Limits()) -> Callable[[Column, Column], tuple[Column, Column]]:
    """(score, reason) of a passage against an answer, for ``judging.judge``, asked where they stand; a failed call scores null, which counts as 0."""
    question = grading(factory, limits)
    made: list = []

    def here(pairs: pa.Array) -> pa.Array:
        plain = pairs.to_pylist()
        distinct = list({p: None for p in plain if p is not None})
        found = ask_all(_provider(made, factory).complete, [question.prompt(p) for p in distinct], limits) if distinct else []
        by = dict(zip(distinct, (a for a, _ in found)))
        return grade_of(pa.array([by.get(p) for p in plain], pa.string()))

    run = PerValue(here, GRADE)

    def grade(answer: Column, passage: Column) -> tuple[Column, Column]:
        found = run.one(pair(answer, passage))
        return found["score"], found["reason"]

    return grade


def pair(answer: Column, passage: Column) -> Column:
    """The two as one text."""
    return F.when(answer.isNotNull(), F.to_json(F.array(answer, F.coalesce(passage, F.lit("")))))
