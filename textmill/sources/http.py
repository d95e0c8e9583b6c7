"""JSON lines over HTTP as a Spark source: a partition for each domain, streamed line by line.

Blank lines are skipped; a line that is no JSON object is a row whose ``record`` is null and whose ``malformed`` holds it, so the lost ones can be
counted. A failed request fails the task, which Spark tries again from the beginning of its file.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textmill.sources.corpus import RECORD

LINES = "domain string, line long, record string, malformed string"


class Domain(InputPartition):
    def __init__(self, name: str, url: str):
        self.name, self.url = name, url


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options["urls"])
        self.seconds = float(options.get("seconds", "60"))

    def partitions(self) -> list[InputPartition]:
        return [Domain(name, url) for name, url in sorted(self.urls.items())]

    def read(self, partition: Domain) -> Iterator[tuple]:
        with urllib.request.urlopen(partition.url, timeout=self.seconds) as answer:
            for n, raw in enumerate(answer):
                line = raw.decode("utf-8", errors="replace").strip()
                if not line:
                    continue
                try:
                    good = isinstance(json.loads(line), dict)
                except ValueError:
                    good = False
                yield partition.name, n, line if good else None, None if good else line


class HttpLines(DataSource):
    """``spark.read.format("textmill_http")`` with the option ``urls``: a JSON object of domains and addresses."""

    @classmethod
    def name(cls) -> str:
        return "textmill_http"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(self.options)


def read_lines(spark: SparkSession, urls: dict[str, str], seconds: float = 60) -> DataFrame:
    """``LINES`` of the addresses of all domains."""
    spark.dataSource.register(HttpLines)
    return spark.read.format("textmill_http").option("urls", json.dumps(urls)).option("seconds", str(seconds)).load()


def records(lines: DataFrame) -> DataFrame:
    """``LINES`` -> the fields of raw records with their domain and line, as ``corpus.read_records`` gives those of files."""
    fields = RECORD.removesuffix(", _corrupt_record string")
    return lines.where("record is not null").select("domain", "line", F.from_json("record", fields).alias("r")).select("r.*", "domain", "line")


def malformed(lines: DataFrame) -> DataFrame:
    """Lines lost for each domain."""
    return lines.groupBy("domain").agg(F.count("*").alias("lines"), F.count("malformed").alias("malformed"))
