"""What a group of Spark jobs took of its executors, from Spark's own status store.

Sums are over the last attempts of the group's stages. Peaks are the highest of any one executor in any of the stages, as Spark sampled them:
when executors report (``spark.executor.heartbeatInterval``), or more often by ``spark.executor.metrics.pollingInterval``; a stage
shorter than that may have none. Memory of whole processes, Python workers included, is there where
``spark.executor.processTreeMetrics.enabled`` is set; else it is null, and ``ram_peak_mb`` is that of the JVM. What was in use
before the jobs, and devices, Spark doesn't sample: there are no such figures.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

MB = 1 << 20
SETTLE = 10.0


@contextmanager
def watched(spark: SparkSession, name: str) -> Iterator[dict]:
    """While it is open, the jobs of this thread form a group; afterwards the mapping holds what they took, also after an error."""
    context = spark.sparkContext
    out: dict = {}
    kept = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    group = f"{name}-{uuid.uuid4().hex}"
    context.setJobGroup(group, name)
    try:
        yield out
    finally:
        for k, v in kept.items():
            context.setLocalProperty(k, v)
        out.update(taken(spark, group))


def _settled(spark: SparkSession, group: str) -> set[int]:
    """The stages of a group's jobs, once the store knows that these have ended (it hears of it a little later), or after ``SETTLE`` seconds."""
    tracker, until = spark.sparkContext.statusTracker(), time.monotonic() + SETTLE
    while True:
        jobs = [info for job in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(job))]
        if time.monotonic() > until or all(j.status != "RUNNING" for j in jobs):
            return {s for j in jobs for s in j.stageIds}
        time.sleep(0.05)


def _last_attempt(spark: SparkSession, stage: int):
    """What the status store holds of a stage; None if it has let it go (``spark.ui.retainedStages``)."""
    try:
        return spark.sparkContext._jsc.sc().statusStore().lastStageAttempt(stage)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "NoSuchElementException":
            return None
        raise


def taken(spark: SparkSession, group: str) -> dict:
    """Sums and peaks of a job group; ``stages_unknown`` counts the stages that the store no longer holds."""
    stages = [_last_attempt(spark, s) for s in _settled(spark, group)]
    known = [s for s in stages if s is not None]
    sampled = [s.peakExecutorMetrics().get() for s in known if s.peakExecutorMetrics().isDefined()]

    def peak(*metrics: str) -> float | None:
        most = max((sum(s.getMetricValue(m) for m in metrics) for s in sampled), default=0)
        return round(most / MB, 3) if most > 0 else None

    jvm = peak("JVMHeapMemory", "JVMOffHeapMemory")
    return {
        "executor_cpu_sec": round(sum(s.executorCpuTime() for s in known) / 1e9, 6),
        "executor_run_sec": round(sum(s.executorRunTime() for s in known) / 1e3, 3),
        "gc_sec": round(sum(s.jvmGcTime() for s in known) / 1e3, 3),
        "input_bytes": sum(s.inputBytes() for s in known),
        "shuffle_bytes": sum(s.shuffleWriteBytes() for s in known),
        "spilled_bytes": sum(s.diskBytesSpilled() for s in known),
        "failed_tasks": sum(s.numFailedTasks() for s in known),
        "stages": len(known),
        "stages_unknown": len(stages) - len(known),
        "task_memory_peak_mb": round(max((s.peakExecutionMemory() for s in known), default=0) / MB, 3),
        "jvm_peak_mb": jvm,
        "python_peak_mb": peak("ProcessTreePythonRSSMemory"),
        "ram_peak_mb": peak("ProcessTreeJVMRSSMemory", "ProcessTreePythonRSSMemory") or jvm,
    }
