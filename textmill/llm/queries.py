"""The registered queries of this subpackage and their SQL, collected from its modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import decontamination, filter_audit, licenses, line_dedup, lm_scoring, minhash, packing, pii, quality, simhash, token_counts, token_files, vector_codes
from textmill.session import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), alone=True)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files and read back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or that of its directory."""
    return licenses.scan(licenses.document_files(table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by word counts and by the attention model."""
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and edited fingerprint of every document, with their likeness, and its near-duplicate class."""
    return minhash.fingerprints_and_classes(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and its nearest window."""
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data, rewritten with surrogates. The key is that of the session; without one the query takes a fixed key that
    protects nothing, so that its result is the same each time. ``pii`` itself has no default."""
    key = spark.conf.get("spark.textmill.pii.key", None) or "no secret: key of the registered query"
    return pii.pseudonymize(table(spark, sf_dir, "documents"), key, only_changed=True)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated three-line passages: line counts and a digest of the text."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), details=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that are not held out."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source, in every order."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, with its error and that of its label."""
    return vector_codes.encode(table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_licenses": op2_licenses,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_simhash": op4_simhash,
        "op5_token_files": op5_token_files,
        "op6_minhash": op6_minhash,
        "op7_decontamination": op7_decontamination,
        "op8_pii": op8_pii,
        "op9_line_dedup": op9_line_dedup,
        "op10_quality": op10_quality,
        "op11_token_counts": op11_token_counts,
        "op12_filter_audit": op12_filter_audit,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_licenses": licenses.ORACLE,
        "op9_line_dedup": line_dedup.ORACLE,
        "op12_filter_audit": filter_audit.ORACLE,
        "op13_vector_codes": vector_codes.ORACLE,
    }
