"""A vector store as a Spark sink: points go to it in batches from the tasks, by their ids.

A client is made once in each task by a factory and has four methods: ``recreate(collection, width)``, ``upsert(collection, points)`` with points of
(id, vector, sparse, payload), ``names()`` and ``drop(collection)``. An upsert replaces a point of the same id, so a task that is tried again, or a whole
job that is run again, leaves each point once. When every task has ended the sink's ``commit`` checks the number of points that they sent; a failed
job says so in ``abort`` and can simply be run again.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

BATCH = 1000


class Point(NamedTuple):
    id: int
    vector: list[float]
    sparse: tuple[list[int], list[float]]
    payload: dict


class Client(Protocol):
    def recreate(self, collection: str, width: int) -> None: ...
    def upsert(self, collection: str, points: list[Point]) -> None: ...
    def names(self) -> list[str]: ...
    def drop(self, collection: str) -> None: ...


class Sent(WriterCommitMessage):
    def __init__(self, points: int, batches: int):
        self.points, self.batches = points, batches


class PointsWriter(DataSourceWriter):
    def __init__(self, factory: Callable[[], Client], batch: int):
        self.factory, self.batch = factory, batch

    def write(self, rows: Iterator) -> Sent:
        client, held, points, batches = self.factory(), {}, 0, 0

        def send(collection: str) -> None:
            nonlocal points, batches
            some = held.pop(collection)
            client.upsert(collection, some)
            points, batches = points + len(some), batches + 1

        for row in rows:
            point = Point(row["point_id"], row["vector"], (row["indices"], row["values"]), json.loads(row["payload"]))
            own = held.setdefault(row["strategy"], [])
            own.append(point)
            if len(own) == self.batch:
                send(row["strategy"])
        for collection in list(held):
            send(collection)
        return Sent(points, batches)

    def commit(self, messages: list[Sent | None]) -> None:
        done = [m for m in messages if m is not None]
        logging.getLogger(__name__).info("%d points in %d batches", sum(m.points for m in done), sum(m.batches for m in done))

    def abort(self, messages: list[Sent | None]) -> None:
        logging.getLogger(__name__).error("points of %d of %d tasks were sent; run the job again", sum(m is not None for m in messages), len(messages))


def upsert(points: DataFrame, factory: Callable[[], Client], batch: int = BATCH) -> None:
    """Rows as given by ``embedding.points`` into the collections named by their strategies; what else is there stays."""

    class Points(DataSource):
        @classmethod
        def name(cls) -> str:
            return "textmill_points"

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return PointsWriter(factory, batch)

    points.sparkSession.dataSource.register(Points)
    points.select("strategy", "point_id", "vector", "indices", "values", F.to_json("payload").alias("payload")).write.format("textmill_points").mode("append").save()


def replace(points: DataFrame, factory: Callable[[], Client], batch: int = BATCH) -> None:
    """The same into collections made anew, of the width of their vectors."""
    client = factory()
    for r in points.groupBy("strategy").agg(F.max(F.size("vector")).alias("width")).collect():  # a row for each collection
        client.recreate(r["strategy"], r["width"])
    upsert(points, factory, batch)


def drop_all(factory: Callable[[], Client], prefix: str = "", dry_run: bool = True) -> tuple[list[str], dict[str, str]]:
    """Drop the collections whose names begin with ``prefix``, or only name them: the names, and of those that could not be dropped the errors."""
    client, failed = factory(), {}
    names = sorted(n for n in client.names() if n.startswith(prefix))
    for name in [] if dry_run else names:
        try:
            client.drop(name)
        except Exception as e:  # the others still go
            failed[name] = f"{type(e).__name__}: {e}"
    return names, failed
