"""The change feed as a data source: ``spark.read.format("tidemark_changes").load(folder)``, batch and stream.

The folder holds Parquet files of records (origin, seq, table_name, op, pk). A filter
``table_name = ...`` is pushed into the file scan; the stream delivers files once each, in the order
they were written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

SCHEMA = "origin long, seq long, table_name string, op string, pk string"
COLUMNS = [field.split()[0] for field in SCHEMA.split(", ")]


class FilePartition(InputPartition):
    def __init__(self, path: str, table: str | None = None):
        self.path, self.table = path, table


def _listed(folder: str) -> list:
    from pyarrow import fs

    place, root = fs.FileSystem.from_uri(folder)
    return [f for f in place.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".parquet")]


def _read(folder: str, partition: FilePartition) -> Iterator[pa.RecordBatch]:
    import pyarrow.dataset as ds
    from pyarrow import fs

    place, _ = fs.FileSystem.from_uri(folder)
    wanted = None if partition.table is None else ds.field("table_name") == partition.table
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    for batch in ds.dataset(partition.path, filesystem=place, format="parquet").to_batches(columns=COLUMNS, filter=wanted):
        yield pa.RecordBatch.from_arrays([column.cast(kind) for column, kind in zip(batch.columns, kinds)], names=COLUMNS)


class ChangesReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.table = folder, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("table_name",) and self.table is None:
                self.table = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(path, self.table) for path in sorted(f.path for f in _listed(self.folder))]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition)


class ChangesStream(DataSourceStreamReader):
    """Offsets are the time and name of the last file delivered, so a new file may have any name.

    Files must not change once they are there, and must appear whole, as Spark's own writers make them.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _files(self) -> list[tuple[int, str]]:
        return sorted((f.mtime_ns or 0, f.path) for f in _listed(self.folder))

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        time, path = max(self._files(), default=(0, ""))
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((offset["time"], offset["path"]) for offset in (start, end))
        return [FilePartition(path) for time, path in self._files() if low < (time, path) <= high]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class ChangesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChangesReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangesStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known to the session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChangesSource)
