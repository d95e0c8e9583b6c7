import collections
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import zstandard

from textmill.llm import lm_scoring, queries, storage
from textmill.llm.subwords import public_path
from textmill.llm.vectext import words_of

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op3_lm_scoring(spark, SF).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    count = collections.Counter(w for d, t in docs if not held[d] for w in [*tokens(t), None])
    n, v = sum(count.values()), len(count)
    for d, t in docs:
        words = [*tokens(t), None]
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(words), sum(count[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert len(got) == len(docs)


def test_held_out_texts_are_likelier_than_by_word_counts(spark):
    got = queries.op3_lm_scoring(spark, "/root/testdata/sf0.1").where("held_out").collect()
    n = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / n > sum(r.base_score for r in got) / n


def test_pieces_cut_greedily_and_give_the_word_back():
    p = lm_scoring.Pieces(public_path())
    texts = ["the Haus über x", "x", "", "und äöü 漢字 the", "the", "y" * 50]
    words = words_of(pa.array(texts, pa.large_string()))
    block = lm_scoring.Block(p)
    block.add(list(range(6)), [False] * 6, pa.array(texts, pa.large_string()))
    _, counts, coded, n, numbers, each = block.close()
    piece = {int(i): int(k).to_bytes(size, "little") for size, (keys, ids) in p.tables.items() for k, i in zip(keys, ids)}
    ids, ends = lm_scoring.text_ids(numbers, each, coded, n)
    at = 0
    for text, end in zip(texts, ends):
        assert ids[end - 1] == lm_scoring.END
        raw = b"".join(piece[int(i)] for i in ids[at : end - 1])
        assert raw.decode() == "".join(" " + w for w in tokens(text))
        rest = raw  # greedy: no longer piece fits anywhere
        for i in ids[at : end - 1]:
            size = len(piece[int(i)])
            word_end = rest.find(b" ", 1)
            room = len(rest) if word_end < 0 else word_end
            assert not any(rest[:k] in piece.values() for k in range(size + 1, min(8, room) + 1))
            rest = rest[size:]
        at = end
    assert counts.sum() == len(words.starts)


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "a b", 1), (None, "a b", 1), (4, "w x " * 100000, 1)], "doc_id long, text string, block int")
    rows = lm_scoring.score_texts(docs).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 3, 3, 200001]
    assert all(np.isfinite(r.score) for r in rows) and len({r.score for r in rows if r.n_tokens == 3}) == 1
    assert lm_scoring.score_texts(docs.limit(0)).count() == 0



def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, seven = ({r.doc_id: r.score for r in lm_scoring.score_texts(d).collect()} for d in (docs.repartition(1), docs.repartition(7)))
    assert one.keys() == seven.keys() and all(math.isclose(one[d], seven[d], rel_tol=1e-4) for d in one)


def test_windows_grow_with_the_text():
    ids = np.arange(5000, dtype=np.uint16) % 900
    begins, ends = np.array([0, 40, 41]), np.array([40, 41, 5000])
    got = lm_scoring.fit_windows(ids, begins, ends)
    assert got.shape[1] == lm_scoring.WINDOW + 1 and len(got) >= 2 + (5000 - 41) // lm_scoring.FIT_STRIDE
    assert (got[1][:2] == [lm_scoring.END, ids[40]]).all() and (got[1][2:] == -1).all()
    inside = got[2:]
    at = np.flatnonzero((inside >= 0).all(axis=1))
    assert len(at) > 10 and all((np.diff(inside[i].astype(int)) % 900 == 1).all() for i in at if inside[i][0] != lm_scoring.END)


def test_every_id_is_fitted_once():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 32, 33, 40, 7000])
    ends = np.cumsum(sizes)
    ids = rng.integers(0, 1023, ends[-1]).astype(np.uint16)
    whole = lm_scoring.fit_windows(ids, ends - sizes, ends)
    runs = lm_scoring.fit_runs(ids, ends - sizes, ends)
    mixed = lm_scoring.mixed_windows([zstandard.compress(r.tobytes()) for r in runs])
    want = collections.Counter((lm_scoring.END if k in (ends - sizes) else int(ids[k - 1]), int(ids[k])) for k in range(len(ids)))
    for got in (whole, mixed):
        assert collections.Counter((int(a), int(b)) for w in got for a, b in zip(w, w[1:]) if b >= 0) == want


def test_words_of_a_block_are_few_rows_with_right_totals(spark):
    some = [f"w{k} w{k} x{k % 7}" for k in range(20_000)]
    docs = spark.createDataFrame([(k // 5, t) for k, t in enumerate(some)], "doc_id long, text string").repartition(3)
    coded = lm_scoring.code(docs, public_path()).cache()
    rows = coded.where("kind = 1").collect()
    held = lambda k: zlib.crc32(str(k // 5).encode()) % 7 == 2
    want = collections.Counter(w for k, t in enumerate(some) if not held(k) for w in t.split())
    assert len(rows) <= 3 * lm_scoring.BUCKETS < sum(r.n for r in rows)  # a row for each word before
    totals = lm_scoring.word_totals(coded).collect()
    assert (sum(t.known for t in totals), sum(t.seen for t in totals)) == (len(want), sum(want.values()))
    given, found = {(r.block, r.place): r for r in rows}, collections.defaultdict(set)
    for t in totals:
        r = given.pop((t.block, t.place))
        hashes = np.frombuffer(zstandard.decompress(r.data), dtype=np.int64, count=r.n)
        for h, n in zip(hashes.tolist(), np.frombuffer(zstandard.decompress(t.data), dtype=np.int64).tolist(), strict=True):
            found[h].add(n)
    assert not given and all(len(n) == 1 for n in found.values())
    every = collections.Counter(want[w] for w in {w for t in some for w in t.split()})
    assert collections.Counter(n for (n,) in found.values()) == every


def test_rows_that_are_done_with_take_no_disk(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(storage, "new_path", lambda session, name, f=storage.new_path: paths.append(f(session, name)) or paths[-1])
    scored = lm_scoring.score_texts(spark.read.parquet(f"{SF}/documents.parquet"))
    (coded,) = [p.removeprefix("file://") for p in paths if "lm-coded" in p]
    assert {d for d in os.listdir(coded) if d.startswith("kind=")} == {"kind=0", "kind=4"}  # all kinds stayed before
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
