"""Token ids in seekable binary files (operator 5).

A file is a row of independent zstandard frames, each with its own content checksum, then
two skippable frames: the document index (zstandard inside) and a seek table in the public
"seekable" layout: per frame its compressed size, its size and a 32-bit checksum, then the
number of frames, a flag byte and a magic number. A reader takes the last bytes, then the
index, then only the frames that hold the documents it wants. Any zstandard tool can
decompress the whole file.

Documents lie in ascending ``doc_id`` order (nulls first, equal ids by text), over files
by range; ids that repeat very often are spread by the beginning of their texts, and equal rows by
their place in the input, so no id makes one large file. Every file is written under a name of its own attempt and named by the task's
result, so a lost or repeated task leaves at most an unused file.

Edge cases: a null text is empty; an empty document has the end id alone; a document longer
than a frame gets a frame of its own; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.storage import materialize, new_path
from textmill.llm.subwords import encoder, in_slices, public_path

# Fixed values of the public seekable format.
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A5D
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUM = 0x80

FRAME_IDS = 1 << 17
INDEX = np.dtype([("doc_id", "<i8"), ("known", "<u1"), ("frame", "<u4"), ("offset", "<u8"), ("n_ids", "<u8")])
FILES = "part int, path string, first_doc long, has_doc boolean, n_docs long, n_ids long, n_frames long, n_bytes long"


class TokenFileWriter:
    """Writes one file; ``add`` takes documents in order."""

    def __init__(self, sink, width: int = 4, level: int = 1):
        self.sink, self.type = sink, np.dtype(f"<u{width}")
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames, self.index = [], []
        self.waiting, self.n_waiting, self.n_ids, self.n_bytes = [], 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.n_waiting and self.n_waiting + len(ids) > FRAME_IDS:
            self._flush()
        self.index.append((doc_id or 0, doc_id is not None, len(self.frames), self.n_waiting, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)

    def _flush(self) -> None:
        raw = np.concatenate(self.waiting).astype(self.type).tobytes()
        packed = self.compressor.compress(raw)
        self._write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.n_waiting = [], 0

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.n_bytes += len(data)

    def close(self) -> None:
        if self.waiting:
            self._flush()
        index = self.compressor.compress(self.type.itemsize.to_bytes(1, "little") + np.array(self.index, dtype=INDEX).tobytes())
        self._write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), HAS_CHECKSUM, SEEKABLE_MAGIC)
        self._write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class TokenFileReader:
    """Reads one file from a seekable source; decompresses only the frames asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n_frames, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUM:
            raise ValueError("not a token file: its seek table is missing")
        table = 8 + 12 * n_frames + 9
        entries = np.frombuffer(self._read(size - table + 8, 12 * n_frames), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.raw_sizes, self.checksums = entries.T if n_frames else np.zeros((3, 0), dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        at = int(self.sizes.sum())
        magic, length = struct.unpack("<II", self._read(at, 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("not a token file: its document index is missing")
        raw = zstandard.ZstdDecompressor().decompress(self._read(at + 8, length))
        self.type = np.dtype(f"<u{raw[0]}")
        self.index = np.frombuffer(raw, dtype=INDEX, offset=1)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        """Ids of frame ``k``; raises if its checksum does not hold."""
        raw = zstandard.ZstdDecompressor().decompress(self._read(int(self.starts[k]), int(self.sizes[k])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checksums[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, dtype=self.type).astype("<u4")

    def documents(self, rows: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the given rows of the index, or of all; each frame is read once."""
        at, ids = -1, np.empty(0, dtype="<u4")
        for row in self.index if rows is None else self.index[rows]:
            if row["frame"] != at:
                at = int(row["frame"])
                ids = self.frame(at)
            offset = int(row["offset"])
            yield (int(row["doc_id"]) if row["known"] else None), ids[offset : offset + int(row["n_ids"])]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them under ``path``, a URI that every executor opens.
    Returns one row per file in ``FILES``; the rows are materialised, so the files exist."""
    tokenizer_path = tokenizer_path or public_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        width = 2 if len(coder.n_bytes) <= 1 << 16 else 4
        writer = sink = None
        for batch, texts in in_slices(batches, "text"):
            if writer is None:
                fs, folder = pafs.FileSystem.from_uri(path)
                fs.create_dir(folder, recursive=True)
                name = f"ids-{uuid.uuid4().hex}.zst"
                sink = fs.open_output_stream(f"{folder}/{name}", compression=None)
                writer = TokenFileWriter(sink, width)
            ids, n = coder.encode(texts)
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
            for doc_id, a, b in zip(batch.column(0).to_pylist(), (ends - n - 1).tolist(), ends.tolist()):
                writer.add(doc_id, ids[a:b])
        # The pieces stay known for the worker's next task, which holds most of them again; their number is bounded.
        pa.default_memory_pool().release_unused()
        if writer is not None:
            writer.close()
            sink.close()
            first = writer.index[0]
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "path": f"{path}/{name}", "first_doc": first[0], "has_doc": first[1], "n_docs": len(writer.index), "n_ids": writer.n_ids, "n_frames": len(writer.frames), "n_bytes": writer.n_bytes}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("first_doc", pa.int64()), ("has_doc", pa.bool_()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_frames", pa.int64()), ("n_bytes", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.substring("text", 1, 32).alias("begin"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange("doc_id", "begin", "place").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    return materialize(ordered.mapInArrow(run, FILES), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    Only the list of files, one short row each, is put in order on the driver."""
    spark = files.sparkSession
    rows = sorted(files.select("part", "path", "n_ids").collect())
    starts, reached = [], 0
    for row in rows:
        starts.append((row["path"], reached))
        reached += row["n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = pafs.FileSystem.from_uri(uri)
                out: list[list] = [[], [], [], []]
                with fs.open_input_file(path) as source:
                    for doc_id, ids in TokenFileReader(source).documents():
                        for column, value in zip(out, (doc_id, start, len(ids), zlib.crc32(ids))):
                            column.append(value)
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not starts:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(starts, "path string, start long").repartition(len(starts))
    return listed.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read them back."""
    return read_token_files(write_token_files(docs, new_path(docs.sparkSession, "token-ids"), tokenizer_path, end_id))
