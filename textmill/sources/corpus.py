"""Reading raw records, the projections of them, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "context string, context_id string, _id string, label string, meta string, input string, answers array<string>, _corrupt_record string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a folder and all below it; blank and malformed lines are left out. ``domain`` is the
    name of the folder for files called ``ingestion_data.jsonl``, else that of the file."""
    rows = spark.read.schema(RECORD).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path)
    file = F.col("_metadata.file_path")
    name = F.regexp_extract(file, r"([^/]+)\.jsonl$", 1)
    domain = F.when(name == "ingestion_data", F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)).otherwise(name)
    return rows.where("_corrupt_record is null").select("*", domain.alias("domain")).drop("_corrupt_record")


def corpus_records(records: DataFrame) -> DataFrame:
    """Five fields with defaults for missing ones."""
    empty = lambda c, v="": F.coalesce(c, F.lit(v)).alias(c)
    return records.select(*(empty(c) for c in ("context", "context_id", "_id", "label")), empty("meta", "{}"))


def qa_records(records: DataFrame) -> DataFrame:
    """Queries with their answers."""
    return records.select(F.coalesce("input", F.lit("")).alias("input"), F.coalesce("answers", F.array().cast("array<string>")).alias("answers"))


def sample_head(rows: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows by an explicit position."""
    return rows.orderBy(order).limit(n)


def unique_contexts(rows: DataFrame) -> DataFrame:
    """``rows`` (pos, context) -> the distinct non-empty contexts with the position of the first of each. Their
    order is that of ``first_pos``; numbering them would bring all rows to one task."""
    return rows.where("context <> ''").groupBy("context").agg(F.min("pos").alias("first_pos"))


def qa_from_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) -> a user turn as query, the assistant turn after it as answer."""
    after = lambda c: F.lead(c).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.select("conv_id", "turn", "role", F.col("text").alias("input"), after("role").alias("r"), after("text").alias("a"))
    return rows.where("role = 'user' and r = 'assistant'").select("conv_id", "turn", "input", F.array("a").alias("answers"))


def write_chunks(chunks: DataFrame, path: str, form: str = "json", mode: str = "overwrite") -> None:
    """Chunks under a folder for each strategy; as JSON the records are ``{text, metadata, chunk_id, doc_id}``."""
    if form == "json":
        # The metadata is JSON already; the other fields are made JSON, without the closing brace.
        rest = F.to_json(F.struct("text", "chunk_id", "doc_id"))
        line = F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(',"metadata":'), "metadata", F.lit("}"))
        chunks.select("strategy", line.alias("value")).write.mode(mode).partitionBy("strategy").text(path)
    else:
        chunks.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("strategy").format(form).save(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_chunks`` wrote as JSON."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", "text string, chunk_id string, doc_id string")
    return lines.select("strategy", parsed.alias("c"), F.get_json_object("value", "$.metadata").alias("metadata")).select("strategy", "c.*", "metadata")


def read_documents(spark: SparkSession, path: str, form: str = "array") -> DataFrame:
    """Documents (doc_id, text). ``array``: files that each hold a JSON array of texts, in order; ``text``: each file is one document.
    Ids are made of the file's name, and of the place in the array."""
    name = F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    if form == "text":
        return spark.read.text(path, wholetext=True).select(name.alias("doc_id"), F.col("value").alias("text"))
    rows = spark.read.text(path, wholetext=True).select(name.alias("name"), F.posexplode(F.from_json("value", "array<string>")).alias("at", "text"))
    return rows.select(F.format_string("%s_%03d", "name", "at").alias("doc_id"), "text")


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    """One text column as lines: a report, or JSON made with ``to_json``."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_contexts(contexts: DataFrame, path: str) -> None:
    """``contexts`` (first_pos, context) as JSON lines of (position, text), in files by range of the position; a single JSON array
    would bring all texts to one task."""
    contexts.repartitionByRange("first_pos").sortWithinPartitions("first_pos").select(F.to_json(F.struct(F.col("first_pos").alias("position"), F.col("context").alias("text"))).alias("value")).write.mode("overwrite").text(path)


def read_queries(spark: SparkSession, *paths: str) -> DataFrame:
    """Queries (query, answers) from the first of the paths that exists: JSON lines of ``input`` and ``answers``. Others stand in where it
    is missing, as a small test set does for a full one."""
    for path in paths:
        uri = spark._jvm.org.apache.hadoop.fs.Path(path)
        if uri.getFileSystem(spark._jsc.hadoopConfiguration()).exists(uri):
            rows = spark.read.schema("input string, answers array<string>, _corrupt_record string").json(path).where("_corrupt_record is null")
            return qa_records(rows).withColumnRenamed("input", "query")
    raise FileNotFoundError(f"no queries at {', '.join(paths)}")


def write_results(results: DataFrame, path: str) -> None:
    """``results`` (domain, strategy, query, answers, retrieved_chunks) as JSON lines under a folder for each domain and strategy; those
    written again are replaced, others stay."""
    rows = results.select("domain", "strategy", F.to_json(F.struct("query", "answers", "retrieved_chunks")).alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain", "strategy").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_results`` wrote; the domain and the strategy come from the folders."""
    chunk = "array<struct<chunk_id: string, text: string, score: double>>"
    return spark.read.text(path).select("domain", "strategy", F.from_json("value", f"query string, answers array<string>, retrieved_chunks {chunk}").alias("r")).select("domain", "strategy", "r.*")


def write_judgements(rows: DataFrame, path: str) -> None:
    """CSV with a header; a rerun replaces what was there."""
    rows.withColumn("reference_answers", F.to_json("reference_answers")).write.mode("overwrite").option("header", True).csv(path)


def collections(spark: SparkSession, prefix: str = "chunks_") -> list[str]:
    """Names of the index tables of the session's catalogue."""
    return sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix) and not t.isTemporary)


def drop_collections(spark: SparkSession, prefix: str = "chunks_", dry_run: bool = True) -> list[str]:
    """Drop the index tables; with ``dry_run`` only name them."""
    names = collections(spark, prefix)
    for name in [] if dry_run else names:
        spark.sql(f"DROP TABLE `{name}`")
    return names
