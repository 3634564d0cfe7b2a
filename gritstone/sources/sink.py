"""Points into a store outside of Spark, by a Python data source with commit and abort.

A store is what ``connect()`` returns in a task or in the driver; it needs three methods:

    stage(attempt, batch, points)   takes a batch of points (dicts), which nobody sees yet
    publish(attempts)               shows the points of these attempts, all at once, in place of those with the same key
    discard(attempts)               forgets what these attempts staged

Every attempt of a task stages under a name of its own, so one that dies half-way leaves points that are never published,
and a second one repeats none of them. Spark says at the end which attempts counted; only these are published.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from gritstone.config import Config


class Store(Protocol):
    def stage(self, attempt: str, batch: int, points: list[dict[str, Any]]) -> None: ...

    def publish(self, attempts: list[str]) -> None: ...

    def discard(self, attempts: list[str]) -> None: ...


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    points: int


def send(rows: Iterator[Row], store: Store, attempt: str, size: int) -> int:
    """Stages ``rows`` in batches of ``size``, of which one at a time is held, and says how many there were."""
    held, batch, points = [], 0, 0
    for r in rows:
        held.append(r.asDict(recursive=True))
        if len(held) == size:
            store.stage(attempt, batch, held)
            held, batch, points = [], batch + 1, points + size
    if held:
        store.stage(attempt, batch, held)
    return points + len(held)


class PointWriter(DataSourceWriter):
    """A write of one table: tasks stage, the driver publishes."""

    def __init__(self, connect: Callable[[], Store], run: str, size: int):
        self.connect, self.run, self.size = connect, run, size

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, attempt = self.connect(), f"{self.run}-{uuid.uuid4().hex}"
        try:
            return Staged(attempt, send(iterator, store, attempt, self.size))
        except Exception:
            store.discard([attempt])
            raise

    def commit(self, messages: list[Staged | None]) -> None:
        self.connect().publish([m.attempt for m in messages if m is not None and m.points])

    def abort(self, messages: list[Staged | None]) -> None:
        self.connect().discard([m.attempt for m in messages if m is not None])


def point_source(name: str, connect: Callable[[], Store], size: int) -> type[DataSource]:
    """A data source called ``name`` that writes to the store of ``connect``, which is sent to the tasks."""

    class Points(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            if overwrite:
                raise ValueError("points replace those with the same key; write them in mode append")
            return PointWriter(connect, self.options["run"], size)

    return Points


def write_points(rows: DataFrame, connect: Callable[[], Store], cfg: Config) -> str:
    """All ``rows`` into the store of ``connect`` in batches of cfg.batch_size; returns the name of the write.

    Either all rows are published or none. An empty table publishes nothing. Nulls, vectors and nested values go as they
    are; of rows with one key the store decides.
    """
    run = uuid.uuid4().hex
    spark, name = rows.sparkSession, "gritstone_points"
    spark.dataSource.register(point_source(name, connect, cfg.batch_size))
    rows.write.format(name).option("run", run).mode("append").save()
    return run
