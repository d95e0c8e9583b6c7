"""MinHash fingerprints, edited-text likeness and near-duplicate classes (operator 6).

Shingles are five words (A-Z in lower case; a shorter text: all its words), as distinct
32-bit hashes. ``LANES`` universal hash permutations ``a * x + b`` modulo 2**32 with odd
``a`` are applied to all shingles of a slice at once; the least value of each makes the
signature. A fingerprint keeps eight mixed bits of each lane, in hex; the likeness of two
fingerprints is their share of equal lanes, corrected for chance agreement, and estimates
the Jaccard similarity of the shingle sets with a standard error of at most 0.032.

``near_duplicates``: texts with equal shingle sets are one class from the start. Signature
bands of ``ROWS`` lanes are joined in Spark; links are those whose Jaccard similarity, counted on
the shingle sets, reaches the threshold. How the members of a bucket are compared is said in
``buckets``: never all pairs of a large one in one task.

Edge cases: a null text is empty; texts without words have all lanes at their highest value,
are alike to each other (1) and to nothing else, and make one class; repeated ids are ordered
by text, descending; a null id comes last; a single document is its own next one; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.buckets import bucket_links, members_of
from textmill.llm.components import connected_components
from textmill.llm.storage import batches_of, discard, materialize, release
from textmill.llm.subwords import in_slices
from textmill.llm.vectext import U64, mix, parts, windows, word_hashes, words_of

SHINGLE = 5
LANES = 256
BANDS, ROWS = 25, 5
THRESHOLD = 0.8
BLOCK = 200
SLICE = 1 << 19

_RNG = np.random.default_rng(20240229)
MULTIPLY = _RNG.integers(0, 1 << 32, LANES, dtype=np.uint32) | np.uint32(1)
ADD = _RNG.integers(0, 1 << 32, LANES, dtype=np.uint32)


def shingle_hashes(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of all texts, and where each text's begin (one more)."""
    words = words_of(texts)
    codes = word_hashes(words)
    first, last, begins = windows(words.docs, shingle)
    h = np.zeros(len(first), dtype=U64)
    with np.errstate(over="ignore"):
        for k in range(shingle):
            at = np.minimum(first + k, last)
            h = np.where(first + k <= last, h * U64(0x9E3779B97F4A7C15) + codes[at], h)
        return (mix(h) >> U64(32)).astype(np.uint32), begins


def signatures(texts: pa.Array, shingle: int = SHINGLE, lanes: int = LANES) -> np.ndarray:
    """The least value of each permutation over each text's shingles: (texts, lanes) uint32. A very long
    text is taken in parts."""
    out = np.full((lanes, len(texts)), 0xFFFFFFFF, dtype=np.uint32)
    for _, part in parts(texts, shingle - 1):
        x, begins = shingle_hashes(part, shingle)
        some = np.flatnonzero(np.diff(begins))
        if len(some):
            at = begins[some]
            for lane in range(lanes):
                out[lane, some] = np.minimum(out[lane, some], np.minimum.reduceat(x * MULTIPLY[lane] + ADD[lane], at))
    return out.T


def distinct_shingles(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    out: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    for _, part in parts(texts, shingle - 1):
        x, begins = shingle_hashes(part, shingle)
        for found, a, b in zip(out, begins, begins[1:]):
            found.append(np.unique(x[a:b]))
    return [f[0] if len(f) == 1 else np.unique(np.concatenate(f)) for f in out]


def fingerprint_bytes(signature: np.ndarray) -> np.ndarray:
    """Eight mixed bits of each lane; texts without words keep the highest value."""
    mixed = ((signature ^ (signature >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
    mixed[(signature == 0xFFFFFFFF).all(axis=1)] = 0xFF
    return mixed


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of fingerprint bytes."""
    chance = 1 / 256
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def dealt_descending(docs: DataFrame, n: int | None = None) -> DataFrame:
    """Rows (doc_id, text) in ``n`` partitions of descending ``doc_id``, each sorted, with guests
    in front: copies (guest = true) of the rows that come first after the partition's last one.

    Only quantiles of ids and the greatest id of each partition reach the driver."""
    spark = docs.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    cuts = rows.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (10 * n)) if n > 1 else []
    splits = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform(rows).withColumn("bucket", (F.lit(len(splits) - 2) - F.col("bucket")).cast("int"))
    top = rows.groupBy("bucket").agg(F.max("doc_id").alias("greatest")).orderBy("bucket").collect()  # at most n rows
    if not top:
        return rows.select("doc_id", "text", F.lit(False).alias("guest"))
    goes = spark.createDataFrame([(r["bucket"], r["greatest"], top[i - 1]["bucket"]) for i, r in enumerate(top)], "bucket int, greatest long, host int")
    joined = rows.join(F.broadcast(goes), (rows["bucket"] == goes["bucket"]) & rows["doc_id"].eqNullSafe(goes["greatest"]), "left").select("doc_id", "text", rows["bucket"], "host")
    own, guest = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("at"), F.lit(True).alias("guest"))
    spread = joined.select("doc_id", "text", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("p")).select("doc_id", "text", "p.at", "p.guest")
    return spread.repartitionById(len(splits) - 1, "at").sortWithinPartitions(F.desc("guest"), F.desc_nulls_last("doc_id"), F.desc("text")).select("doc_id", "text", "guest")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
CLASSED = "class long, bands array<long>"
Tables = Callable[[pa.Array], np.ndarray]


def class_of(shingles: np.ndarray) -> int:
    """A hash of a set of shingles."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def classed(texts: pa.Array, shingle: int, signature: np.ndarray, tables: Tables | None = None) -> list[pa.Array]:
    """For each text a hash of its set of shingles, and its keys in the tables: the bands of its signature,
    then those that ``tables`` gives for a slice of texts."""
    classes = [class_of(s) for s in distinct_shingles(texts, shingle)]
    lanes = signature[:, : BANDS * ROWS].astype(U64)
    keys = np.zeros((len(classes), BANDS), dtype=U64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys = mix(keys * U64(0x9E3779B97F4A7C15) + lanes[:, r::ROWS] + U64(r + 1))
    keys = keys.view(np.int64)
    if tables is not None:
        keys = np.concatenate([keys, tables(texts)], axis=1)
    return [pa.array(classes, pa.int64()), pa.array(list(keys), pa.list_(pa.int64()))]


def fingerprints_and_edits(docs: DataFrame, shingle: int = SHINGLE, partitions: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text), in ``RESULT``: its fingerprint, that of the text whose last third is replaced
    by the beginning of the next document, and their likeness; then the row's class."""

    def signed(texts: list[str], own: bool = False) -> tuple[np.ndarray, list[int]]:
        found, classes = [], []
        for _, some in in_slices(iter([pa.record_batch([pa.array(texts, pa.large_string())], ["text"])]), "text", SLICE):
            found.append(signatures(some, shingle))
            if own:
                classes += [class_of(s) for s in distinct_shingles(some, shingle)]
        return np.concatenate(found), classes

    def rows_of(ids: list, texts: list[str]) -> pa.RecordBatch:
        """``texts`` has one more: the text after the last row."""
        n = np.array([len(t) for t in texts[:-1]], dtype=np.int64)
        edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, texts[1:])]
        signature, classes = signed(texts, own=True)
        own, changed = fingerprint_bytes(signature), fingerprint_bytes(signed(edited)[0])
        columns = [
            pa.array(ids, pa.int64()),
            pa.array(n),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([x.tobytes().hex() for x in own[:-1]]),
            pa.array([x.tobytes().hex() for x in changed]),
            pa.array(likeness(own[:-1], changed)),
            pa.array(likeness(own[:-1], own[1:])),
            pa.array(classes[:-1], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in f"{RESULT}, class long".split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, ids, texts = None, [], []
        for batch, values in in_slices(batches, "text", SLICE):
            for doc_id, text, guest in zip(batch.column("doc_id").to_pylist(), values.to_pylist(), batch.column("guest").to_pylist()):
                if not guest:
                    ids.append(doc_id)
                    texts.append(text)
                elif after is None:
                    after = text
            if len(ids) > 1:
                yield rows_of(ids[:-1], texts)
                ids, texts = ids[-1:], texts[-1:]
        if ids:
            yield rows_of(ids, [*texts, after])

    return dealt_descending(docs, partitions).mapInArrow(run, f"{RESULT}, class long")


def bands_of(docs: DataFrame, shingle: int = SHINGLE, tables: Tables | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, class and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in in_slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), *classed(texts, shingle, signatures(texts, shingle, BANDS * ROWS), tables)], ["doc_id", "class", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {CLASSED}")


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (text) -> class and its distinct shingles, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in in_slices(batches, "text", SLICE):
            sets = distinct_shingles(texts, shingle)
            classes = [class_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array([np.sort(s.view(np.int32)) for s in sets], pa.list_(pa.int32()))], ["node", "shingles"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, shingles array<int>")


def jaccard(rows: pa.Table, threshold: float, most: int = 1 << 20) -> Callable[[int, np.ndarray], np.ndarray]:
    """For rows with ascending ``shingles``: which of some positions reach the threshold with one. Sets are compared
    ``most`` shingles at a time."""
    lists = rows.column("shingles").combine_chunks()
    begins = lists.offsets.to_numpy()
    values, sizes = lists.values.to_numpy(), np.diff(begins)

    def near(x: int, some: np.ndarray) -> np.ndarray:
        low, high = np.minimum(sizes[some], sizes[x]), np.maximum(sizes[some], sizes[x])
        can = np.flatnonzero((low > 0) & (low >= threshold * high))
        out = np.zeros(len(some), dtype=bool)
        own = values[begins[x] : begins[x + 1]]
        ends = np.cumsum(sizes[some[can]])
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, most)), len(can)))
        for a, b in zip(cuts, cuts[1:]):
            which = can[a:b]
            n = sizes[some[which]]
            theirs = np.concatenate([values[begins[i] : begins[i + 1]] for i in some[which]])
            found = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            shared = np.add.reduceat(found, np.cumsum(n) - n, dtype=np.int64)
            out[which] = shared >= threshold * (n + sizes[x] - shared)
        return out

    return near


def near_links(members: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``members`` as given by ``buckets.members_of``, ``sets`` (node, shingles) -> verified edges (a, b) with the
    components of all links among members of a bucket."""
    shared = F.size(F.array_intersect("shingles", "others"))
    close = (shared > 0) & (shared >= threshold * (F.size("shingles") + F.size("others") - shared))

    def star(pairs: DataFrame) -> DataFrame:
        return pairs.join(sets, "node").join(sets.select(F.col("node").alias("leader"), F.col("shingles").alias("others")), "leader").where(close).select("node", "leader")

    return bucket_links(members, star, lambda rows: jaccard(rows, threshold), sets, block)


def sized(small: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table to join with: broadcast if it has ``most`` rows at most, counted here; else joined by shuffle."""
    return F.broadcast(small) if small.count() <= most else small


def classes_of(banded: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """``banded`` (doc_id, class, bands) of ``docs`` (doc_id, text) -> class, component_id (the least doc_id reachable over
    links of the threshold or more) and copies, the number of rows with the same set of shingles: of classes
    with several rows or a link. Shingles are made again, and kept, only for one document of each class
    that shares a bucket with another."""
    classes = materialize(banded.groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")), "shingle-classes")
    members = members_of(classes.select(F.col("class").alias("node"), F.posexplode("bands").alias("t", "key")))
    wanted = materialize(members.select("node").distinct().join(classes, F.col("node") == F.col("class")).select("node", "first"), "wanted-classes")
    ids = sized(materialize(wanted.select(F.col("first").alias("wanted_id")).distinct(), "wanted-ids"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = materialize(shingle_sets(rows, shingle).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "class-sets")
    parts = connected_components(near_links(members, sets, threshold, block))
    linked = materialize(parts.join(classes, parts["node"] == classes["class"]).select("class", "root", "first"), "linked-classes")
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("component")), "root").select("class", "component")
    found = classes.drop("bands").join(named, "class", "left").where("copies > 1 or component is not null")
    found = materialize(found.select("class", F.coalesce("component", "first").alias("component_id"), "copies"), "class-components")
    discard(classes, members, wanted, sets)
    return found


def with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` (doc_id, class, ...) with the component_id and copies of their class instead of it."""
    names = [c for c in rows.columns if c != "class"]
    joined = rows.join(sized(classes.withColumnRenamed("class", "of")), F.col("class") == F.col("of"), "left")
    alone = F.col("of").isNull()
    return joined.select(*names, F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, 1).otherwise(F.col("copies")).alias("copies"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, component_id (the least doc_id reachable over links
    of the threshold or more) and the number of rows with the same set of shingles."""
    banded = materialize(bands_of(docs, shingle), "bands")
    return with_classes(banded.select("doc_id", "class"), classes_of(banded, docs, threshold, shingle))


def fingerprints_and_classes(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``fingerprints_and_edits`` in ``RESULT``, with the component_id and the copies of ``near_duplicates``. The classes
    come first, and what they took is given back before all texts are shuffled."""
    banded = materialize(bands_of(docs, shingle), "bands")
    classes = classes_of(banded, docs, threshold, shingle)
    discard(banded)
    release(docs.sparkSession)
    return with_classes(fingerprints_and_edits(docs, shingle), classes)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, tables: Tables | None = None) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, that of the least ``doc_id`` (nulls last); all
    columns are kept, whatever their names. Rows that share an id are told apart by a number of their own."""
    rows = materialize(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("place")), "rows")
    texts = rows.select(F.col("place").alias("doc_id"), F.col("row.text").alias("text"))
    with batches_of(docs.sparkSession, 2000):  # whole texts: fewer at a time, for memory
        banded = materialize(bands_of(texts, shingle, tables), "bands")
    classes = classes_of(banded, texts, threshold, shingle)
    groups = materialize(banded.select(F.col("doc_id").alias("place"), "class").join(sized(classes), "class").select("place", F.col("component_id").alias("component")), "row-components")
    named = materialize(groups.join(rows.select("place", F.col("row.doc_id").alias("id")), "place").select("place", "component", F.struct(F.col("id").isNull().alias("none"), "id", "place").alias("order")), "ordered-groups")
    first = named.groupBy("component").agg(F.min("order").alias("first")).select("first.place")
    gone = materialize(named.select("place").join(first, "place", "left_anti"), "near-copies")
    discard(banded, groups, named)
    return rows.join(sized(gone), "place", "left_anti").select("row.*")
