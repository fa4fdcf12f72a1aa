"""Scratch tables of the corpus operators, and batches of bounded size."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.sources import workspace
from tidemark.sources.workspace import new_dir, remove, shared_dir

__all__ = ["materialize", "new_dir", "release", "remove", "shared_dir", "slices", "trimmed"]

#: Spark's setting that deletes the shuffle files of a query when it ends; else they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the rows in an Arrow batch, and how many there are at most while a scratch table is made.
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2048


def materialize(df: DataFrame, name: str) -> DataFrame:
    """A scratch table of ``df``; the shuffle files it was made from are gone when it is written."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in (_CLEANUP, _BATCH)}
    rows = int(before[_BATCH] or 0)
    conf.set(_CLEANUP, "true")
    conf.set(_BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    try:
        return workspace.materialize(df, name)
    finally:
        for key, value in before.items():
            conf.set(key, value) if value is not None else conf.unset(key)


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for table in tables:
        for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
            remove(table.sparkSession, path)


def trimmed(make):
    """``make``, a function of Arrow batches, that hands freed memory back to the system when a task ends: workers wait for others with what they hold."""

    def run(batches):
        try:
            yield from make(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def slices(batches, rows: int = 256):
    """Arrow batches of ``rows`` rows at most, so that what a worker makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
