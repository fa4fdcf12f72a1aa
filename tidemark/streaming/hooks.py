"""Barriers and hooks of a running merge."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidemark.operators import frontier


class ApplyHooks(StreamingQueryListener):
    """Calls ``on_start`` (name) when a stream begins, ``on_applied`` (name, batch, rows) after each micro-batch and ``on_end`` (name, error or None).

    Add it with ``spark.streams.addListener``.
    """

    def __init__(self, on_start: Callable | None = None, on_applied: Callable | None = None, on_end: Callable | None = None):
        self.on_start, self.on_applied, self.on_end = on_start, on_applied, on_end
        self.names: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name
        if self.on_start is not None:
            self.on_start(event.name)

    def onQueryProgress(self, event) -> None:
        if self.on_applied is not None and event.progress.numInputRows:
            self.on_applied(event.progress.name, event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.on_end is not None:
            self.on_end(self.names.pop(str(event.id), None), event.exception)


def wait_applied(query: StreamingQuery) -> None:
    """Return when the stream has applied all that its source holds."""
    query.processAllAvailable()


def replicated(applied: DataFrame, written: DataFrame) -> bool:
    """Whether every dot (origin, seq) of ``written`` is among the ``applied`` ones."""
    heads = frontier.heads(frontier.ranges_of(applied)).select("origin", "head")
    wanted = written.groupBy("origin").agg(F.max("seq").alias("seq"))
    return not wanted.join(heads, "origin", "left").filter(F.coalesce("head", F.lit(0)) < F.col("seq")).limit(1).count()


def wait_replicated(applied: Callable[[], DataFrame], written: DataFrame, timeout: float = 60.0, pause: float = 0.5) -> bool:
    """Ask ``applied`` until it has all of ``written``; false if that takes longer than ``timeout`` seconds."""
    until = time.monotonic() + timeout
    while not replicated(applied(), written):
        if time.monotonic() + pause > until:
            return False
        time.sleep(pause)
    return True
