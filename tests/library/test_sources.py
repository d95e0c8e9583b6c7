"""JSON arrays, HTTP lines and the vector store."""

import glob
import http.server as servers
import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from textmill.sources import arrays, corpus, http, store


def joined(path):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


@pytest.mark.parametrize("n", (0, 1, 2, 1000))
def test_arrays(spark, tmp_path, n):
    texts = [f'Text {i} with "quotes", é, \n lines\t] and [brackets],' for i in range(n)]
    texts[1:2] = ["]"] if n > 1 else []
    places = list(range(n))
    random.Random(1).shuffle(places)
    rows = spark.createDataFrame([(texts[i], 3 * i, i) for i in places], "text string, at long, other int").repartition(5)
    path, one = str(tmp_path / "array"), str(tmp_path / "one.json")
    arrays.write_array(rows, "text", "at", path, files=3)
    assert json.loads(joined(path)) == texts and (n < 1000 or len(glob.glob(f"{path}/part-*")) > 1)
    arrays.join(spark, path, one)
    assert json.loads(open(one).read()) == texts
    for source in (path, one):
        assert [r.value for r in arrays.read_array(spark, source).orderBy("file", "line").collect()] == texts
    nested = rows.select(F.struct("at", F.array("text").alias("texts")).alias("v"), "at")
    arrays.write_array(nested, "v", "at", path)
    assert json.loads(joined(path)) == [{"at": 3 * i, "texts": [t]} for i, t in enumerate(texts)]
    assert [r.value.at for r in arrays.read_array(spark, path, "struct<at: long, texts: array<string>>").orderBy("file", "line").collect()] == [3 * i for i in range(n)]
    if n:
        with pytest.raises(ValueError):
            arrays.write_array(rows.withColumn("at", F.when(F.col("other") > 0, F.col("at"))), "text", "at", path)


class Handler(servers.BaseHTTPRequestHandler):
    def do_GET(self):
        files = {"/agri.jsonl": b'{"context": "c1", "input": "q", "answers": ["a"], "meta": {"x": 1}}\n\n{broken\n[1]\n{"context": "\xc3\xa9"}\n', "/bio.jsonl": b'{"context": "c3"}'}
        body = files.get(self.path)
        self.send_response(200 if body else 404)
        self.end_headers()
        self.wfile.write(body or b"")

    def log_message(self, *args):
        pass


def test_http_lines(spark):
    server = servers.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    lines = http.read_lines(spark, {"agri": f"{base}/agri.jsonl", "bio": f"{base}/bio.jsonl"})
    assert lines.rdd.getNumPartitions() == 2
    rows = http.records(lines)
    assert sorted((r.domain, r.line, r.context) for r in rows.collect()) == [("agri", 0, "c1"), ("agri", 4, "é"), ("bio", 0, "c3")]
    assert corpus.corpus_records(rows).where("meta = '{\"x\":1}'").count() == 1 and sorted(r.answers for r in corpus.qa_records(rows).collect()) == [[], [], ["a"]]
    assert {tuple(r) for r in http.malformed(lines).collect()} == {("agri", 4, 2), ("bio", 1, 0)}
    with pytest.raises(Exception, match="404"):
        http.read_lines(spark, {"none": f"{base}/none.jsonl"}).count()
    server.shutdown()


class Folder:
    """A store of files: a folder for each collection, a file for each point."""

    def __init__(self, path):
        self.path = path

    def recreate(self, collection, width):
        self.drop(collection)
        os.makedirs(f"{self.path}/{collection}")
        with open(f"{self.path}/{collection}/width", "w") as f:
            f.write(str(width))

    def upsert(self, collection, points):
        os.makedirs(f"{self.path}/{collection}", exist_ok=True)
        assert len(points) <= 7
        for p in points:
            with open(f"{self.path}/{collection}/{p.id}.json", "w") as f:
                json.dump([p.vector, p.sparse, p.payload], f)

    def names(self):
        return os.listdir(self.path)

    def drop(self, collection):
        if collection == "stuck":
            raise OSError("locked")
        for f in glob.glob(f"{self.path}/{collection}/*"):
            os.remove(f)
        if os.path.isdir(f"{self.path}/{collection}"):
            os.rmdir(f"{self.path}/{collection}")


def test_store(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(60).select(F.concat(F.lit("s"), F.col("id") % 2).alias("strategy"), F.col("id").alias("point_id"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("vector"), F.array(F.lit(1)).alias("indices"), F.array(F.lit(0.5)).alias("values"), F.struct(F.lit("é").alias("text"), F.col("id").alias("original_chunk_id")).alias("payload")).repartition(4)
    factory = lambda: Folder(path)
    store.replace(rows, factory, 7)
    store.upsert(rows.where("point_id < 10").withColumn("vector", F.array(F.lit(9.0), F.lit(9.0))), factory, 7)
    for s in (0, 1):
        files = glob.glob(f"{path}/s{s}/*.json")
        assert len(files) == 30 and open(f"{path}/s{s}/width").read() == "2"
    assert json.load(open(f"{path}/s0/4.json")) == [[9.0, 9.0], [[1], [0.5]], {"text": "é", "original_chunk_id": 4}] and json.load(open(f"{path}/s1/11.json"))[0] == [11.0, 2.0]
    store.upsert(rows, factory, 7)  # the job again
    assert len(glob.glob(f"{path}/s0/*.json")) == 30
    os.makedirs(f"{path}/stuck")
    assert store.drop_all(factory) == (["s0", "s1", "stuck"], {}) and len(os.listdir(path)) == 3
    assert store.drop_all(factory, dry_run=False) == (["s0", "s1", "stuck"], {"stuck": "OSError: locked"}) and os.listdir(path) == ["stuck"]
