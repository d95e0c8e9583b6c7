"""Runs strategies one after another: chunks, metrics, the text report, and what each took."""

from __future__ import annotations

import json
import logging
import time
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import metrics
from textmill.plans.resources import watched
from textmill.plans.strategies import STRATEGIES, chunker, chunks_of, timed
from textmill.sources.corpus import write_chunks, write_lines


class Staged:
    """A table under a path that goes when it is closed."""

    def __init__(self, df: DataFrame, path: str):
        self.spark, self.path = df.sparkSession, path
        df.write.mode("overwrite").parquet(path)
        self.rows = self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def _run(spark: SparkSession, docs: DataFrame, path: str, name: str, given: dict) -> dict:
    """One strategy. Its chunks are made once, with the time of each document, into a table of documents; chunks and all metrics are
    read from there, so that a task that runs again, or a second reader, makes no chunk twice."""
    with closing(Staged(timed(docs, chunker(given)), f"{path}/_documents/{name}")) as staged:
        write_chunks(chunks_of(staged.rows, name), f"{path}/{name}", "parquet")
        metrics.per_timed_document(staged.rows).write.mode("overwrite").json(f"{path}/per_document/{name}")
        total = metrics.aggregated_timed(staged.rows, name).first().asDict()
    each = spark.read.json(f"{path}/per_document/{name}", "doc_id string, chunk_count long")
    write_lines(metrics.report_of(each).repartitionByRange("line").sortWithinPartitions("line"), "value", f"{path}/reports/{name}")
    return total


def run_strategies(docs: DataFrame, path: str, specs: dict[str, dict] | None = None) -> list[dict]:
    """Write under ``path`` for each strategy its chunks (``<strategy>``), metrics and time for each document (``per_document/<strategy>``)
    and text report (``reports/<strategy>``), then one JSON line for each strategy (``consolidated``): its metrics or its error, the
    seconds of the whole run (``elapsed_sec``), and what its jobs took (``resources``). These are also returned. A failure
    is logged and noted, and the others go on. Chunking times are those of documents, summed over all tasks."""
    out = []
    spark = docs.sparkSession
    for name, given in (specs or STRATEGIES).items():
        began = time.perf_counter()
        try:
            with watched(spark, name) as resources:
                found = _run(spark, docs, path, name, given)
        except Exception as e:
            logging.getLogger(__name__).exception("strategy %s failed", name)
            found = {"chunker": name, "error": str(e)}
        out.append(found | {"strategy": name, "elapsed_sec": round(time.perf_counter() - began, 6), "resources": resources})
    lines = spark.createDataFrame([(json.dumps(x, default=float),) for x in out], "value string")  # one short row for each strategy
    write_lines(lines, "value", f"{path}/consolidated")
    return out


def compare(docs: DataFrame, path: str) -> DataFrame:
    """What ``run_strategies`` wrote: a row for each strategy, that with the least time of documents first."""
    return docs.sparkSession.read.json(f"{path}/consolidated").orderBy(F.col("total_chunking_time_sec").asc_nulls_last(), "strategy")
