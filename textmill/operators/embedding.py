"""Dense vectors of texts and the index tables made of them.

An encoder is made once in each task by a factory, so that a model is loaded once; called with a list
of texts it gives a matrix with a row for each. The default hashes words to ``WIDTH`` signed features:
a stand-in without a model, whose vectors say nothing about meaning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from textmill.functions.text import TERMS
from textmill.operators import lexical

WIDTH = 64
BATCH = 1000
KNOWN = 400_000
Encoder = Callable[[list[str]], np.ndarray]


class HashingEncoder:
    """Counts of lower-case terms at a place and with a sign by their MD5, brought to length one. Where all that a text has cancel, they can't be: the
    places of its terms get ``cancelled`` (0, or what SQL gives for 0 / 0)."""

    def __init__(self, cancelled: float = 0.0) -> None:
        self.known: dict[str, int] = {}
        self.cancelled = cancelled

    def _feature(self, term: str) -> int:
        """Twice the place of a term, and one more if its sign is minus. The first ``KNOWN`` terms are kept, among them those that come often."""
        found = self.known.get(term)
        if found is None:
            digest = hashlib.md5(term.encode()).digest()
            found = 2 * (digest[0] % WIDTH) + (digest[1] >= 128)
            if len(self.known) < KNOWN:
                self.known[term] = found
        return found

    def of_terms(self, n: int, row: np.ndarray, code: np.ndarray, words: pa.Array) -> np.ndarray:
        """The vectors of ``n`` texts with terms as given by ``lexical.found_terms``: each word is looked up once."""
        feature = np.fromiter(map(self._feature, words.to_numpy(zero_copy_only=False).tolist()), dtype=np.int64, count=len(words))[code]
        place = row * WIDTH + feature // 2
        out = np.bincount(place, 1.0 - 2 * (feature % 2), minlength=n * WIDTH).astype(np.float64).reshape(-1, WIDTH)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        if self.cancelled != 0:
            out.ravel()[place[norm[row, 0] == 0]] = self.cancelled
        return out / np.where(norm == 0, 1, norm)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.of_terms(len(texts), *lexical.found_terms(pa.array(texts, pa.large_string())))


def places(text: Column) -> Column:
    """Where the default encoder counts each term of a text."""
    terms = F.regexp_extract_all(lexical.lower(text), F.lit(TERMS), F.lit(0))
    return F.transform(terms, lambda t: F.conv(F.substring(F.md5(t), 1, 2), 16, 10).cast("int") % WIDTH)


def _with_vector(batch: pa.RecordBatch, found: np.ndarray) -> pa.RecordBatch:
    found = np.asarray(found, dtype=np.float64)
    offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
    return batch.append_column("vector", pa.ListArray.from_arrays(offsets, pa.array(found.ravel())))


def _embedded(batch: pa.RecordBatch, text: str, encoder: Encoder) -> Iterator[pa.RecordBatch]:
    for some in (batch.slice(i, BATCH) for i in range(0, batch.num_rows, BATCH)):
        yield _with_vector(some, encoder([t or "" for t in some.column(some.schema.get_field_index(text)).to_pylist()]))


VECTOR = StructField("vector", ArrayType(DoubleType()))


def embed(rows: DataFrame, text: str = "text", factory: Callable[[], Encoder] = HashingEncoder) -> DataFrame:
    """``rows`` with a column ``vector`` array<double>; a null text is empty. Texts go to the encoder in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or factory()
            yield from _embedded(batch, text, encoder)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, VECTOR]))


def dimension(factory: Callable[[], Encoder] = HashingEncoder) -> int:
    """The number of components of an encoder's vectors."""
    return int(np.asarray(factory()(["test"])).shape[1])


def point_id(chunk_id: Column) -> Column:
    """A number for a chunk, the same in every run: 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(chunk_id), 1, 15), 16, 10).cast("long")


def points(chunks: DataFrame, terms: DataFrame, factory: Callable[[], Encoder] = HashingEncoder, within: str | None = None) -> DataFrame:
    """``chunks`` (strategy, chunk_id, doc_id, text, metadata), ``terms`` as given by ``lexical.vocabulary`` -> the rows of an index:
    strategy, point_id, vector, indices and values of the sparse vector, and payload. ``within``: as for ``lexical.together``, a further column of ``chunks``."""
    key = F.concat_ws("/", "strategy", "chunk_id")
    rows = lexical.together(chunks.select("strategy", "chunk_id", "doc_id", "text", "metadata", key.alias("key"), *([within] if within else [])), "key", within)
    weigh = lexical.weigher(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch, found in weigh(batches):
            encoder = encoder or factory()
            # An encoder of terms takes those that the sparse vectors are made of.
            yield from [_with_vector(batch, encoder.of_terms(batch.num_rows, *found))] if hasattr(encoder, "of_terms") else _embedded(batch, "text", encoder)

    # Texts are shuffled once at most; both vectors of a text are made beside each other, and nothing is joined.
    more = [StructField("indices", ArrayType(IntegerType())), StructField("values", ArrayType(DoubleType())), VECTOR]
    made = rows.mapInArrow(run, StructType([*rows.schema.fields, *more]))
    payload = F.struct(F.col("chunk_id").alias("original_chunk_id"), "doc_id", "text", "metadata")
    return made.select("strategy", point_id(F.col("key")).alias("point_id"), "vector", "indices", "values", payload.alias("payload"))


def write_collections(made: DataFrame, path: str) -> None:
    """An index for each strategy, a partition of the table at ``path``; those written again are replaced, others stay."""
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(path)


def read_collection(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    """The index of one strategy."""
    return spark.read.parquet(path).where(F.col("strategy") == strategy)


def save_collection(made: DataFrame, strategy: str, prefix: str = "chunks_") -> str:
    """The index of one strategy as a table of the session's catalogue, made anew; ``corpus.drop_collections`` drops it."""
    name = f"{prefix}{strategy}"
    made.where(F.col("strategy") == strategy).write.mode("overwrite").saveAsTable(name)
    return name
