"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode; a
    cluster has no folder that driver and executors share unless it names one, so there it is an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(context, "_textmill_shared", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="textmill-")
            context._textmill_shared = base
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete tables made by ``materialize`` that nothing reads any more, or of them the rows of one value (``part``: "column=value") of the
    column that they were written ``by``. A failure to delete is no error."""
    for table in tables:
        spark = table.sparkSession
        for uri in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if uri.endswith(f"/{part}" if part else ""):
                path = spark._jvm.org.apache.hadoop.fs.Path(uri)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing refers to any more. It finds them when the driver's heap is
    collected, which may be long after a large step has ended."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """While it is open, the session's setting has that value."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batches_of(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """While it is open, Python gets ``rows`` rows at a time: for rows that may be large each."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialize(df: DataFrame, name: str, by: str = "") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there,
    so a lost executor costs no recomputation of what came before. ``by``: a column of few values, each with files of its own."""
    path = new_path(df.sparkSession, name)
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", "8"):  # else rows are sorted by the column first
        df.write.partitionBy(*([by] if by else [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
