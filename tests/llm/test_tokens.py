import io
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textmill.llm import packing, queries, token_files
from textmill.llm.subwords import PieceEncoder, public_path

HARD = [(1, None), (2, ""), (3, " a  b\n\n c "), (4, "x " * 5000), (5, "dup dup"), (5, "dup dup"), (None, "no id"), (7, "<|endoftext|> é 漢字 😀"), (8, "w" * 30000)]
SCHEMA = "doc_id long, text string, piece string, path string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_path())


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in HARD], SCHEMA)


CODER, AS_TEXT = PieceEncoder(public_path()), PieceEncoder(public_path(), as_text=True)
PLAIN, PLAIN_TEXT = Tokenizer.from_file(public_path()), Tokenizer.from_file(public_path())
PLAIN_TEXT.encode_special_tokens = True
SYMBOLS = st.lists(st.sampled_from([*" \n\t\r\x1f\x85 ab'sé漢😀1.<|>", "<|endoftext|>", "<|endo", " the"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(SYMBOLS, max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    for coder, plain in ((CODER, PLAIN), (AS_TEXT, PLAIN_TEXT)):
        ids, n = coder.encode(pa.array(texts, pa.large_string()))
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_added_tokens():
    ids, n = CODER.encode(pa.array(["<|endoftext|>", "hello <|endoftext|> x"], pa.large_string()))
    assert n.tolist() == [1, 4] and ids.tolist() == [50256, 31373, 220, 50256, 2124][: len(ids)]


def test_packing_keeps_few_pieces_in_a_worker():
    coder = PieceEncoder(public_path(), packing.KEPT)
    for k in range(0, 360_000, 60_000):
        text = "the " + " ".join(f"w{i}" for i in range(k, k + 60_000))
        ids, n = coder.encode(pa.array([text], pa.large_string()))
        assert len(coder.known) <= 300_000 and n.tolist() == [len(ids)]
        assert k not in (0, 300_000) or ids.tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_packing_alone_keeps_pieces_from_task_to_task(spark, sf):
    def known(batches):
        from textmill.llm.subwords import encoder

        yield from (pa.RecordBatch.from_pydict({"n": [len(encoder(public_path(), packing.ALONE).known)]}) for _ in batches)

    packing.pieces(spark.read.parquet(f"{sf}/documents.parquet").repartition(16), public_path(), alone=True).count()
    assert max(r.n for r in spark.range(64).repartition(16).mapInArrow(known, "n long").collect()) > 0


def check_packing(rows, want):
    sequences, got = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        got[r["doc_id"]].append(r)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in want)
    by = defaultdict(list)
    for d, ids in want:
        by[d].append(ids)
    for d, lists in by.items():
        if len(lists) == 1:
            at = 0
            for k, r in enumerate(sorted(got[d], key=lambda r: r["piece"])):
                assert (r["piece"], r["start"]) == (k, at)
                assert k == 0 or r["length"] == 1024
                assert zlib.crc32(np.array(lists[0][at : at + r["length"]], dtype="<u4")) == r["ids_crc32"]
                at += r["length"]
            assert at == len(lists[0])
    return len(sequences)


def test_packing_fixture(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = [(r.doc_id, tokenizer.encode(r.text, add_special_tokens=False).ids + [2]) for r in docs]
    n = check_packing(queries.op1_packing(spark, sf).collect(), want)
    assert n <= 1.02 * sum(len(i) for _, i in want) / 1024 + 2


def test_packing_hard_rows(hard, tokenizer):
    want = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in HARD]
    check_packing(packing.pack(hard).collect(), want)


def test_packing_empty_table(hard):
    assert packing.pack(hard.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan_places_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, dtype=np.int64), minlength=41)
    bins = packing.plan_bins(counts, 40)
    used = np.zeros(41, dtype=np.int64)
    for many, kinds in bins:
        assert many > 0 and sum(kinds) <= 40 and sum(3 * k > 40 for k in kinds) <= 2
        np.add.at(used, kinds, many)
    assert np.array_equal(used, counts)
    naive = []
    for x in sorted(lengths, reverse=True):  # plain best fit decreasing
        fits = [i for i, g in enumerate(naive) if g >= x]
        if fits:
            naive[min(fits, key=naive.__getitem__)] -= x
        else:
            naive.append(40 - x)
    assert sum(m for m, _ in bins) <= len(naive) * 1.1 + 1


def test_token_files_fixture(spark, sf, tokenizer):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    rows = sorted(queries.op5_token_files(spark, sf).collect())
    at = 0
    for d, r in zip(docs, rows, strict=True):
        ids = np.array(tokenizer.encode(d.text, add_special_tokens=False).ids + [0], dtype="<u4")
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(ids))
        at += len(ids)


def test_token_files_hard_rows(hard):
    rows = token_files.round_trip(hard).collect()
    assert len(rows) == len(HARD)
    assert sorted(r.start for r in rows) == list(np.cumsum([0] + [r.n_tokens for r in sorted(rows, key=lambda r: r.start)])[:-1])
    assert token_files.round_trip(hard.limit(0)).count() == 0


def test_reader_takes_single_frames_and_finds_damage():
    sink = io.BytesIO()
    writer = token_files.TokenFileWriter(sink, 2)
    docs = [np.arange(n, dtype=np.uint32) % 50000 for n in (5, 200_000, 1, 70_000, 70_000)]
    for k, ids in enumerate(docs):
        writer.add(k, ids)
    writer.close()
    reader = token_files.TokenFileReader(pa.PythonFile(io.BytesIO(sink.getvalue()), mode="r"))
    assert len(reader.sizes) == 4
    (got,) = reader.documents(np.array([3]))
    assert got[0] == 3 and np.array_equal(got[1], docs[3])
    bad = bytearray(sink.getvalue())
    bad[int(reader.starts[1]) + 40] ^= 1
    with pytest.raises(Exception):
        token_files.TokenFileReader(pa.PythonFile(io.BytesIO(bytes(bad)), mode="r")).frame(1)
