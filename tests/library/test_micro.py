"""Hand-checked small cases."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from textmill.functions import lifted
from textmill.functions import splitting as S
from textmill.functions.text import TOKENS, json_size, paragraphs, sentences, tokens
from textmill.operators import chunkers as C
from textmill.operators import embedding, judging, lexical, metrics, providers, retrieval
from textmill.plans import runner, strategies
from textmill.sources import corpus
from textmill.streaming import chunks as streaming


def run(spark, chunker, *texts):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").coalesce(1)
    made = strategies.made(docs, chunker).select("source_doc_id", F.col("chunk_ord").alias("ord"), "c.*")
    rows = made.withColumnRenamed("source_doc_id", "doc_id").orderBy("doc_id", "ord").collect()
    return [[r for r in rows if r.doc_id == f"d{i}"] for i in range(len(texts))]


def texts(rows):
    return [r.text for r in rows]


def meta(rows, key):
    return [json.loads(r.metadata).get(key) for r in rows]


def test_windows(spark):
    a, b, none, null = run(spark, C.fixed_character(100, 10), "a" * 100, "a" * 90, "", None)
    assert list(zip(meta(a, "start_char"), meta(a, "end_char"))) == [(0, 100), (90, 100)] and len(b) == 1 and not none and not null
    (over,) = run(spark, C.fixed_character(3, 5), "abcd")
    assert texts(over) == ["abc", "bcd", "cd", "d"]
    (slide,) = run(spark, C.sliding_token(50, 25), " ".join(["a"] * 60))
    assert list(zip(meta(slide, "start_token"), meta(slide, "end_token"))) == [(0, 50), (25, 60), (50, 60)]
    (group,) = run(spark, C.sentence_group(3, 1), "A. B. C. D.")
    assert texts(group) == ["A. B. C.", "C. D."] and group[0].id_suffix == "_chunk_0000"
    para, astral = run(spark, C.paragraph(), "a\n\n\nb\n\n", "\U0001f600 \n\n  x")
    assert texts(para) == ["a", "b"] and texts(astral) == ["\U0001f600", "x"]
    (pg,) = run(spark, C.paragraph_group(2, 1), "a\n\nb\n\nc")
    assert texts(pg) == ["a\n\nb", "b\n\nc", "c"]
    with pytest.raises(ValueError):
        C.sliding_token(5, 0)


def test_folds(spark):
    (length,) = run(spark, C.length_aware(10, 2), "aaaa. bbbbb. ccccccc.")
    assert texts(length) == ["aaaa. bbbbb.", "ccccccc."] and meta(length, "length") == [12, 8]
    (dense,) = run(spark, C.content_density(10), "a b c. d e f. g")
    assert meta(dense, "density_factor") == [0.5, 0.5, None] and len(dense) == 3
    (dynamic,) = run(spark, C.dynamic_token(2, 4), "a b .c d e f")
    assert "".join(texts(dynamic)) == "a b .c d e f" and max(meta(dynamic, "token_count")) <= 4


def test_islands(spark):
    def given(*values):
        return lambda s: F.array(*(F.lit(float(v)) for v in values))

    (cut,) = run(spark, C.similarity_threshold(0.6, given(0.6, 0.59)), "A. B. C.")
    assert texts(cut) == ["A. B.", "C."] and meta(cut, "sentence_count") == [2, 1]
    (var,) = run(spark, C.semantic_variance(0.2, given(0.9, 0.9, 0.9, 0.5)), "A. B. C. D. E.")
    assert texts(var) == ["A. B. C. D.", "E."] and meta(var, "split_score") == [0.5, None]
    (no,) = run(spark, C.semantic_variance(0.2, given(0.1)), "A. B.")
    assert texts(no) == ["A. B."]
    (topic,) = run(spark, C.topic(0.4), "One sentence only")
    assert texts(topic) == ["One sentence only"] and meta(topic, "topic_label") == [None]


def test_topic_labels_and_recursion():
    assert S.topic_labels(pa.array([x.split() for x in ("a b", "x y", "a b", "x y z", "q")]), 0.4) == [0, 1, 0, 1, 2]
    assert S.recursive_split("aaa bbb ccc", 7, 0) == ["aaa bbb", "ccc"]
    long = " ".join(f"w{i}" for i in range(400))
    out = S.recursive_split(long, 100, 20)
    assert all(len(x) <= 100 for x in out) and set(" ".join(out).split()) == set(long.split())
    assert S.recursive_split("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    with pytest.raises(ValueError):
        C.recursive(10, 20)


def test_boundaries_and_segments(spark):
    lossless = C.llm_boundary(lossless=True)
    assert [texts(r) for r in run(spark, C.llm_boundary(), "A b. C d. E f.", "One sentence only.", "", "  ")] == [["A b. C d."], [], [], []]
    assert [texts(r) for r in run(spark, lossless, "A b. C d. E f.", "One sentence only.")] == [["A b. C d. E f."], ["One sentence only."]]
    # Full runs of a long paragraph come before the paragraph that waits, unless lossless.
    odd = "Aaa. \n\nBbbb. Cccc. Dddd. x"
    assert [texts(r) for r in run(spark, C.llm_boundary(8, 0), odd)] == [["Bbbb.", "Cccc.", "Aaa.", "Dddd."]]
    assert [texts(r) for r in run(spark, C.llm_boundary(8, 0, lossless=True), odd)] == [["Aaa.", "Bbbb.", "Cccc.", "Dddd. x"]]
    assert [texts(r) for r in run(spark, C.llm_boundary(7, 2), "Abc. \n\nDef. \n\nGhi. x")] == [["Abc.", "c.\n\nDef.", "f.\n\nGhi."]]
    (seg,) = run(spark, C.llm_segment(), "# T\r\n\r\n\r\ntext\n\n```x```\n\n- x\n\n2. y")
    assert meta(seg, "unit_type") == ["heading_block", "paragraph", "code", "list", "list"]
    assert [texts(r) for r in run(spark, C.llm_segment(1500, 4), "abc\n\nd\n\ne", "")] == [["abc", "abc\n\nd", "c\n\nd\n\ne"], []]
    long = "word. " * 600 + "tail"
    (cut,) = run(spark, C.llm_segment(1500, 0), long)
    assert all(len(x) <= 1500 for x in texts(cut)) and "".join(texts(cut)) == long and texts(cut)[-1] == " tail"
    assert [texts(r) for r in run(spark, C.llm_segment(4, 0), "abcdefghij.kl.mnopqrs")] == [["abcd", "efgh", "ij.", "kl.", "mnop", "qrs"]]


def test_providers(spark):
    """Answers of a model: cut where it says, kept where it fails."""

    class Model:
        def complete(self, prompt: str) -> str:
            text = prompt.split("[TEXT]\n")[1].split("\n[/TEXT]")[0]
            if "fail" in text:
                raise TimeoutError
            if "segments" in prompt:
                return '```json\n{"segments": [{"start": 0, "end": 4, "type": "qa"}, {"start": 2, "end": 9}, {"start": 9, "end": 99}, {"start": "x"}]}\n```'
            return 'Sure: {"boundaries": [3, 3, 0, -1, 99, "6", null]} done'

    uneven = f"{'X' * 19}. B. {'Y' * 19}. C. "
    cut, kept, even = run(spark, C.llm_boundary(20, 0, boundaries=providers.boundaries(Model)), uneven, uneven.replace("B", "fail"), "A b. C d. ")
    assert texts(cut) == ["XXX", "XXX", uneven[6:].strip()] and meta(cut, "used_llm_refinement")[0]
    # Without an answer the text is cut at the sums of the chunks' lengths. Even chunks are kept; the last sentence, which nothing follows, is lost.
    assert texts(kept) == ["X" * 19 + ".", "fail", ". " + "Y" * 19 + ". C."] and texts(even) == ["A b."] and not meta(even, "used_llm_refinement")[0]
    (seg,) = run(spark, C.llm_segment(100, 0, segments=providers.segments(Model), ask_above=5), "0123456789\n\nabc\n\nfail fail fail")
    assert list(zip(texts(seg), meta(seg, "unit_type"))) == [("0123", "qa"), ("45678", "paragraph"), ("abc", "paragraph"), ("fail fail fail", "paragraph")]
    assert providers.read_json("no json") is None and providers.read_json("x [1, 2] y") == [1, 2] and providers.read_json("[x] [3]") == [3] and providers.read_json('x {"a": {"b": 1}} y') == {"a": {"b": 1}}


def test_hybrid_and_ids(spark):
    docs = spark.createDataFrame([("doc_000", "a" * 1000 + "\n\n" + "b " * 501 + "c")], "doc_id string, text string")
    rows = strategies.chunk(docs, strategies.STRATEGIES["hybrid_paragraph_fixed_token_chunking"], "h").orderBy("chunk_ord").collect()
    assert rows[0].doc_id == "doc_000" and rows[0].chunk_id == "doc_000_chunk_0000"
    assert rows[1].doc_id == "doc_000_chunk_0001" and rows[1].chunk_id == "doc_000_chunk_0001_chunk_0000" and rows[1].source_doc_id == "doc_000"
    assert strategies.read_specs('[{"name": "x", "enabled": false, "spec": {}}, {"name": "y", "spec": {"type": "sentence"}}]') == {"y": {"type": "sentence"}}
    many = spark.createDataFrame([("d", "x" * 10_001)], "doc_id string, text string")
    assert strategies.chunk(many, strategies.spec("fixed_character", chunk_size=1, overlap=0)).where("chunk_id = 'd_chunk_10000'").count() == 1


def test_primitives(spark):
    samples = ['é"\n', "", "a\tb\\c\x01", "\U0001f600 plain", "x\x7f"]
    rows = spark.createDataFrame([(s,) for s in samples], "t string").coalesce(1).select(json_size(F.col("t")).alias("n"), F.array_join(tokens(F.col("t")), "").alias("j"), "t").collect()
    for r in rows:
        assert r.j == r.t and r.n == len(json.dumps(r.t)), r
    one = spark.createDataFrame([("A b! C? d",)], "t string").select(sentences(F.col("t")).alias("s"), paragraphs(F.col("t")).alias("p")).first()
    assert one.s == ["A b!", "C?", "d"] and one.p == ["A b! C? d"]


def test_judging_and_nesting(spark):
    hits = spark.createDataFrame([(1, 1, ["x y", "alpha beta", "alpha beta"], "alpha beta"), (1, 2, ["zz ww"], "alpha"), (2, 1, None, "alpha"), (2, 6, ["alpha"], "alpha")], "query_id int, rank int, answers array<string>, chunk_text string")
    got = {(r.query_id, r.rank): (r.relevance_score, r.llm_reason) for r in judging.judge(hits).collect()}
    assert got == {(1, 1): (2, "2 of 2 terms"), (1, 2): (0, ""), (2, 1): (0, "")}
    rows = spark.createDataFrame([(1, 2, "b", "t", 0.5), (1, 1, "a", "t", 0.9)], "query_id int, rank int, chunk_id string, text string, score double")
    assert [c.chunk_id for c in retrieval.nest(rows).first().retrieved_chunks] == ["a", "b"]


def test_top_k_in_blocks(spark):
    index = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(20)] + [(20, [0.0, 0.0]), (21, None)], "id long, vector array<double>")
    queries = index.where("id < 5").withColumnRenamed("id", "query_id")
    a, b, c = (sorted(map(tuple, retrieval.top_k(index, queries, 4, block, parts).collect())) for block, parts in ((100, None), (2, 1), (1, 7)))
    assert a == b == c and len(a) == 20 and [r[2] for r in a if r[0] == 0] == [0, 3, 6, 9]
    assert retrieval.top_k(index.limit(0), queries).count() == 0 == retrieval.top_k(index, queries.limit(0)).count()


def test_top_k_of_many_queries_without_the_driver(spark, monkeypatch):
    """No row reaches the driver, and the plan reads the index once."""
    index = spark.range(3000).select("id", F.array(*[F.sin(F.col("id") * (j + 1)) for j in range(8)]).alias("vector"))
    queries = spark.range(20_000).select(F.col("id").alias("query_id"), F.array(*[F.cos(F.col("id") * (j + 1) / 7) for j in range(8)]).alias("vector"))
    for name in ("collect", "toLocalIterator", "toPandas", "first", "take"):
        monkeypatch.setattr(type(index), name, lambda *a, **k: pytest.fail("rows on the driver"))
    found = retrieval.top_k(index, queries, 3, parts=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 3000") == 1 and "WindowGroupLimit" in plan
    monkeypatch.undo()
    rows = {}
    for r in found.collect():
        rows.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert len(rows) == 20_000 and all(len(v) == 3 for v in rows.values())
    vectors = np.array([r.vector for r in index.orderBy("id").collect()])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    some = {r.query_id: np.array(r.vector) for r in queries.where("query_id % 500 = 0").collect()}
    for i, q in some.items():
        score = np.round(vectors @ (q / np.linalg.norm(q)), 6)
        best = np.lexsort((np.arange(3000), -score))[:3]
        assert [x[1] for x in sorted(rows[i])] == best.tolist()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in/agri").mkdir(parents=True)
    (tmp_path / "in/agri/ingestion_data.jsonl").write_text('{"context": "c1", "input": "q", "answers": ["a"]}\n\n{broken\n{"context": "c2", "answers": null}\n')
    rows = corpus.read_records(spark, str(tmp_path / "in"))
    assert sorted((r.context, r.domain) for r in rows.select("context", "domain").collect()) == [("c1", "agri"), ("c2", "agri")]
    assert corpus.corpus_records(rows).where("meta = '{}' and label = ''").count() == 2
    assert sorted(r.answers for r in corpus.qa_records(rows).collect()) == [[], ["a"]]
    docs = spark.createDataFrame([("doc_000", 'He said "x". Then é\nleft.')], "doc_id string, text string")
    made = strategies.chunk_all(docs, ["sentence_based_chunking", "fixed_token_chunking"])
    corpus.write_chunks(made, str(tmp_path / "out"))
    back = corpus.read_chunks(spark, str(tmp_path / "out"))
    assert sorted((r.strategy, r.chunk_id, r.text) for r in back.collect()) == sorted((r.strategy, r.chunk_id, r.text) for r in made.collect())
    assert corpus.drop_collections(spark, "chunks_none_") == []


def test_index_and_results(spark, tmp_path):
    """Documents in, chunks, an index for each strategy, queries with a stand-in file, nested results out and back."""
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/corpus.json").write_text(json.dumps(["The cat sat. The dog ran.", 'Quote " and \\\\ é.']))
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/a.txt").write_text("one\ntwo")
    docs = corpus.read_documents(spark, str(tmp_path / "docs"))
    assert {r.doc_id: r.text for r in docs.collect()} == {"corpus_000": "The cat sat. The dog ran.", "corpus_001": 'Quote " and \\\\ é.'}
    assert [tuple(r) for r in corpus.read_documents(spark, str(tmp_path / "plain"), "text").collect()] == [("a", "one\ntwo")]
    made = strategies.chunk_all(docs, ["sentence_based_chunking", "fixed_token_chunking"])
    terms = lexical.vocabulary(made.select(F.concat_ws("/", "strategy", "chunk_id").alias("chunk_id"), "text"))
    points = embedding.points(made, terms)
    path = str(tmp_path / "index")
    embedding.write_collections(points, path)
    embedding.write_collections(points.where("strategy = 'fixed_token_chunking'"), path)
    index = embedding.read_collection(spark, path, "sentence_based_chunking")
    assert index.count() == 3 == index.select("point_id").distinct().count() and embedding.dimension() == embedding.WIDTH
    assert spark.read.parquet(path).count() == made.count()
    (tmp_path / "small.jsonl").write_text('{"input": "cat sat", "answers": ["The cat"]}\n\n{"input": "", "answers": []}\n')
    queries = corpus.read_queries(spark, str(tmp_path / "missing.jsonl"), str(tmp_path / "small.jsonl")).withColumn("query_id", F.length("query").cast("long"))
    with pytest.raises(FileNotFoundError):
        corpus.read_queries(spark, str(tmp_path / "missing.jsonl"))
    found = retrieval.retrieve(embedding.embed(queries, "query"), index, 2)
    best = {r["query"]: r for r in found.collect()}
    assert best["cat sat"].answers == ["The cat"] and best["cat sat"].retrieved_chunks[0].text == "The cat sat." and len(best[""].retrieved_chunks) == 2
    corpus.write_results(found.withColumns({"domain": F.lit("d"), "strategy": F.lit("sentence_based_chunking")}), str(tmp_path / "results"))
    back = corpus.read_results(spark, str(tmp_path / "results")).collect()
    assert {(r.domain, r.strategy, r["query"], len(r.retrieved_chunks)) for r in back} == {("d", "sentence_based_chunking", "cat sat", 2), ("d", "sentence_based_chunking", "", 2)}
    corpus.write_lines(metrics.report(docs, strategies.chunk(docs, strategies.spec("sentence"))), "value", str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).where("value = 'Total chunks: 3'").count() == 1
    corpus.write_contexts(corpus.unique_contexts(docs.select(F.length("text").alias("pos"), F.col("text").alias("context"))), str(tmp_path / "contexts"))
    assert spark.read.json(str(tmp_path / "contexts")).count() == 2
    view = strategies.register_views(docs, ["sentence_based_chunking"])
    assert spark.sql(f"select count(*) from {view[0]}").first()[0] == 3


class Letters:
    def __call__(self, texts):
        return [[float(t.count(c)) for c in "abc"] for t in texts]


def test_another_encoder(spark):
    rows = spark.createDataFrame([(1, "aab"), (2, None)], "id int, text string")
    assert sorted((r.id, r.vector) for r in embedding.embed(rows, factory=Letters).collect()) == [(1, [2.0, 1.0, 0.0]), (2, [0.0, 0.0, 0.0])]


def test_dynamic_tokens_against_the_rule(spark):
    import random

    rng = random.Random(1)
    samples = ["".join(rng.choice(["a ", "b", ". ", "12", "\n", "cd "]) for _ in range(rng.randrange(0, 120))) for _ in range(40)] + ["a b . c d e"]
    for low, high in ((2, 4), (3, 10), (0, 1), (5, 6)):
        for text, rows in zip(samples, run(spark, C.dynamic_token(low, high), *samples)):
            units, at, want = regex.findall(TOKENS, text), 0, []
            while at < len(units):
                least, most = min(at + low, len(units)), min(at + high, len(units))
                ends = [k + 1 for k in range(least, most) if regex.search("[.\n?!]", units[k])]
                want.append("".join(units[at : (ends or [most])[-1]]))
                at = (ends or [most])[-1]
            assert texts(rows) == want, (low, high, text)


def test_runner_and_stream(spark, tmp_path):
    docs = strategies.documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    out = runner.run_strategies(docs, str(tmp_path / "run"), {"sentence_based_chunking": strategies.spec("sentence"), "bad": strategies.spec("none")})
    assert out[0]["total_documents"] == 200 and out[0]["total_chunking_time_sec"] > 0 and "error" in out[1]
    compared = runner.compare(docs, str(tmp_path / "run")).collect()
    assert [r.strategy for r in compared] == ["sentence_based_chunking", "bad"] and compared[0].total_chunks == out[0]["total_chunks"] and compared[1].error
    assert spark.read.json(str(tmp_path / "run/per_document/sentence_based_chunking")).count() == 200
    assert spark.read.text(str(tmp_path / "run/reports/sentence_based_chunking")).count() == 205
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(str(tmp_path / "src"))
    stream = streaming.read_documents(spark, str(tmp_path / "src"))
    streaming.chunk_stream(stream, strategies.spec("sentence"), "s", str(tmp_path / "sink"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == out[0]["total_chunks"]


def test_metrics_keep_empty_documents(spark):
    docs = spark.createDataFrame([("a", "x. y."), ("b", ""), ("c", None)], "doc_id string, text string")
    made = strategies.chunk(docs, strategies.spec("sentence"))
    rows = {r.doc_id: r.chunk_count for r in metrics.per_document(docs, made).collect()}
    assert rows == {"a": 2, "b": 0, "c": 0}
    assert metrics.aggregated(docs.limit(0), made.limit(0), "s").first().total_chunks == 0
    record = made.orderBy("chunk_id").first()
    line = json.dumps({"text": record.text, "metadata": 0, "chunk_id": record.chunk_id, "doc_id": record.doc_id}) + "\n"
    assert made.orderBy("chunk_id").select(metrics.record_size(made)).first()[0] == len(line) - 1 + len(record.metadata)


def test_halves_are_rounded_as_in_sql(spark):
    # 0.2600975 lies just below the half of the seventh digit, although its shortest decimal ends in 5.
    similar = lambda s: F.array(F.lit(0.9), F.lit(0.2600975))
    (rows,) = run(spark, C.semantic_variance(0.2, similar=similar), "One is. Two is. Three is.")
    assert meta(rows, "split_score") == [0.260097, None]
    assert S.rounded(np.array([0.0009765625, -0.0009765625, 0.25]), 9).tolist() == [0.000976563, -0.000976563, 0.25]


def test_small_scores_have_no_exponent(spark):
    for score, written in ((0.000735, "0.000735"), (0.00005, "0.00005"), (0.000001, "0.000001"), (0.25, "0.25"), (0.0, "0.0")):
        (rows,) = run(spark, C.semantic_variance(0.2, similar=lambda s, x=score: F.array(F.lit(0.9), F.lit(x))), "One is. Two is. Three is.")
        assert rows[0].metadata == f'{{"chunker":"semantic_variance_adaptive_chunking","split_score":{written}}}' and "split_score" not in rows[1].metadata


def test_a_large_batch_is_given_in_slices():
    words = lambda k: [["a", "b", f"w{k % 7}"], ["b", "c"] * (k % 5), ["c"]][: k % 4]
    batch = pa.array([words(k) for k in range(60_000)] + [None, []], pa.list_(pa.list_(pa.string())))
    most = []

    def seen(values):
        most.append(int(lifted.sizes_of(values).sum()))
        return S.adjacent_similarities(values)

    assert lifted.sliced(batch, seen).equals(S.adjacent_similarities(batch))
    assert len(most) > 1 and max(most) <= 1 << 21


def test_tfidf_shuffles_texts_not_their_counts(spark):
    import re

    from textmill.operators import lexical

    rows = spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc"), (2, "aa dd"), (3, None)], "chunk_id long, text string")
    made = lexical.vectors(rows, lexical.vocabulary(rows))
    found = set(re.findall(r"hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+L?", "", made._jdf.queryExecution().executedPlan().toString())))
    assert found == {"chunk_id", "term"}
    got = {(r.chunk_id, r.term_id): r.weight for r in made.collect()}
    assert got.keys() == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 3)} and got[1, 0] > got[1, 2] > 0


def test_points_against_joined_vectors(spark):
    """Both vectors of points, also of chunks that share an id, have no terms or hold letters whose lower case depends on their neighbours."""
    from textmill.operators import lexical

    texts = ["aa bb aa", "bb cc", "ΟΔΟΣ οδος İX ix", "", None, "a . b", "zz " * 30 + "aa"]
    rows = spark.createDataFrame([("s", "c1" if i < 2 else f"c{i}", "d", t, "{}") for i, t in enumerate(texts)], "strategy string, chunk_id string, doc_id string, text string, metadata string")
    keyed = rows.select(F.concat_ws("/", "strategy", "chunk_id").alias("chunk_id"), "text")
    terms = lexical.vocabulary(keyed)
    assert [tuple(r)[:4] for r in terms.orderBy("term_id").collect()] == [(0, "aa", 2, 3), (1, "bb", 1, 2), (2, "cc", 1, 1), (3, "ix", 1, 2), (4, "zz", 1, 30), (5, "οδος", 1, 1), (6, "οδοσ", 1, 1)]
    assert {r.idf for r in terms.where("df = 2").collect()} == {round(math.log(8 / 3) + 1, 9)}
    want = {r.chunk_id: (r.indices, r["values"]) for r in lexical.sparse(lexical.vectors(keyed, terms)).collect()}
    made = embedding.points(rows, terms).collect()
    assert len(made) == len(texts) and len(want) == 3
    dense = {r.text: r.vector for r in embedding.embed(rows).collect()}
    for r in made:
        assert (r.indices, r["values"]) == want.get(f"s/{r.payload.original_chunk_id}", ([], [])) and r.vector == dense[r.payload.text]


def test_cells_where_terms_cancel(spark, tmp_path):
    """What the SQL gives where it divides 0 by 0, in cells and in results; also for an item whose terms cancel, and texts without terms."""
    import duckdb

    from textmill import catalog

    of = {}
    for n in range(4000):
        place, sign = divmod(embedding.HashingEncoder()._feature(f"w{n}"), 2)
        of.setdefault(place, {}).setdefault(sign, []).append(f"w{n}")
    a, b, c = (of[place] for place in (3, 5, 7))
    pair = lambda x: f"{x[0][0]} {x[1][0]}"
    more = [f"{a[0][i]} {b[0][i]} {b[0][-i - 1]} {c[0][i]} {'x' * i}." for i in range(1, 9)]
    texts = [pair(a), pair(b), f"{pair(a)} {pair(b)}", ". !", None, *more]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [f"{a[0][1]} {c[0][1]}", f"{c[0][2]} {c[0][3]}", pair(b), "?", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("collection", "retrieval_results"):
        got = catalog.queries()[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want)) and "nan" in repr(want)


def test_collection_shuffles_documents_not_chunks(spark, sf):
    import re

    from textmill import catalog

    plan = re.sub(r"#\d+L?", "", catalog.collection(spark, sf)._jdf.queryExecution().executedPlan().toString())
    assert re.findall(r"Exchange (.*?), \d+\)", plan) == ["hashpartitioning(doc_id"] and "Join" not in plan
