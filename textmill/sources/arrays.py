"""JSON arrays without one task that sees all of it.

``write_array`` writes the elements in files by range of their position, one element a line. The first line of all begins with the opening
bracket, each other one with a comma, and the last ends with the closing bracket, so the files in order of their names are one valid array. ``join`` makes them one
file: by the file system's own concatenation where it has one, else by a copy in buffers, once the job has committed.

Positions must be distinct and not null. An empty table is ``[]``.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_array(rows: DataFrame, value: str, position: str, path: str, files: int | None = None) -> None:
    """The column ``value`` (a text, or whatever ``to_json`` takes) as an array in order of ``position``, in so many ``files`` if given."""
    kind = rows.schema[value].dataType.typeName()
    if kind in ("struct", "array", "map", "variant"):
        element = F.to_json(F.col(value))
    else:
        # JSON of a single value, by way of an array of one.
        element = F.regexp_replace(F.to_json(F.array(F.col(value))), r"(?s)^\[(.*)\]$", "$1")
    each = rows.select(F.col(position).alias("at"), element.alias("element"))
    ends = each.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("at").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    if ends["n"] < ends["rows"]:
        raise ValueError("positions must not be null")
    if not ends["n"]:
        rows.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    before = F.when(F.col("at") == F.lit(ends["first"]), "[").otherwise(",")
    after = F.when(F.col("at") == F.lit(ends["last"]), "]").otherwise("")
    dealt = each.repartitionByRange(files, "at") if files else each.repartitionByRange("at")
    dealt.sortWithinPartitions("at").select(F.concat(before, "element", after).alias("value")).write.mode("overwrite").text(path)


def read_array(spark: SparkSession, path: str, element: str = "string") -> DataFrame:
    """(file, line, value) of what ``write_array`` wrote, or of one file that ``join`` made; ``element`` is the type of its elements. ``line`` orders the lines of a file as far as
    its blocks tell; the whole order is that of the positions written."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").where("value <> '[]'")
    # The bracket or comma in front of an element goes; a bracket behind it is left only on the last one.
    inner = F.regexp_replace("value", r"^[\[,]", "")
    wrapped = F.from_json(F.concat(F.lit("["), inner, F.lit("]")), f"array<{element}>")
    closed = F.from_json(F.concat(F.lit("["), inner), f"array<{element}>")
    both = F.when(F.size(F.coalesce(wrapped, F.array())) == 1, wrapped[0]).otherwise(closed[0])
    return lines.select("file", F.monotonically_increasing_id().alias("line"), both.alias("value"))


def join(spark: SparkSession, path: str, target: str) -> None:
    """The files of an array as one file. The data doesn't become rows again; where the file system can't concatenate, the bytes go through a buffer."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    folder, file = hadoop.fs.Path(path), hadoop.fs.Path(target)
    fs = folder.getFileSystem(conf)
    parts = sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    out = fs.create(file, True)
    out.close()
    array = spark.sparkContext._gateway.new_array(hadoop.fs.Path, len(parts))
    for i, p in enumerate(parts):
        array[i] = p
    try:
        fs.concat(file, array)
        return
    except (Py4JJavaError, UnsupportedOperationException):  # not every file system has it
        out = fs.create(file, True)
    for p in parts:
        source = fs.open(p)
        hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
        source.close()
    out.close()
