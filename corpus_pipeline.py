"""From raw documents to packed training sequences: ``run`` applies ``STAGES`` to the table
``documents``, each stage written as Parquet in the shared folder and read again by the next.

All stages but the last return the columns of their input, with ``n_chars``, if there is one, that of the text.

Edge cases, in every stage: a null text is empty, and a null id an id like any other; a null or empty text gets
the classifier's score of no features, has no lines, is a near copy of other texts without words, holds no
benchmark item and is packed as its end alone. Very long texts are taken whole. Rows that share an id are
documents of their own, but for the decontamination, where they go together if one of them holds an item;
equal rows are exact copies, of which the near-dedup keeps one. An empty table gives an empty result. Columns
may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import decontamination, line_dedup, packing, quality, simhash
from textmill.llm.storage import materialize
from textmill.session import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of three lines or more that came before."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles with a Jaccard similarity of 0.8 or
    more, counted exactly on candidates from the SimHash covering tables and, for pairs beyond their
    radius, from MinHash bands."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]
#: The stages hold a trained model, hashes and a tokenizer that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
