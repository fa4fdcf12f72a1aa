"""The change feed, and continuous merging with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import frontier, merge

#: Bytes of a key and of a table name in a feed slot.
PK_BYTES, TABLE_BYTES = 72, 32

RECORD = "origin long, seq long, hlc long, pk long, cl long, op string, a double, b string, n long"


def notifications(log: DataFrame, tables: Sequence[str] = ()) -> DataFrame:
    """One notification for each applied changeset and table; ``tables`` filters."""
    rows = log.filter(F.col("table_name").isin(*tables)) if tables else log
    return rows.groupBy("origin", "seq", "table_name").agg(F.count("*").alias("records"))


def changes(log: DataFrame) -> DataFrame:
    """The feed as a table; filters on its columns reach the scan below."""
    return log.select("origin", "seq", "table_name", "op", F.col("pk").cast("string").alias("pk"))


def ring_slots(rows: DataFrame) -> DataFrame:
    """Feed rows in slots of fixed size, with flags for what was cut."""
    cut = lambda c, n: F.left(F.col(c), F.lit(n)).alias(c)
    more = [c for c in rows.columns if c not in ("pk", "table_name")]
    return rows.select(*more, cut("pk", PK_BYTES), (F.octet_length("pk") > PK_BYTES).alias("pk_truncated"), cut("table_name", TABLE_BYTES), (F.octet_length("table_name") > TABLE_BYTES).alias("table_truncated"))


def delivered(log: DataFrame, buffer: int) -> DataFrame:
    """The first ``buffer`` records of each origin, then one marker row: the reader must take all tables as changed."""
    rows = log.withColumn("_n", F.row_number().over(Window.partitionBy("origin").orderBy("seq")))
    return rows.filter(F.col("_n") <= buffer + 1).withColumn("lossy", F.col("_n") > buffer).drop("_n")


class Merger(StatefulProcessor):
    """State of one key: its newest generation, the winning stamp and value of each cell, and the counter of that generation.

    The dots already added to the counter are kept, so redelivered records add nothing. There is
    no watermark: records may come late without bound.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", "cl long, a double, ah long, ao long, b string, bh long, bo long, n long")
        self.seen = handle.getMapState("seen", "origin long, seq long", "cl long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        cl, a, ah, ao, b, bh, bo, n = self.row.get() if self.row.exists() else (0, None, None, None, None, None, None, None)
        for batch in rows:
            for r in batch.itertuples(index=False):
                if self.seen.containsKey((r.origin, r.seq)):
                    continue
                self.seen.updateValue((r.origin, r.seq), (r.cl,))
                if r.cl > cl:
                    cl, a, ah, ao, b, bh, bo, n = int(r.cl), None, None, None, None, None, None, None
                if r.cl < cl:
                    continue
                stamp = (int(r.hlc), int(r.origin))
                if pd.notna(r.a) and (ah is None or stamp > (ah, ao)):
                    a, (ah, ao) = float(r.a), stamp
                if pd.notna(r.b) and (bh is None or stamp > (bh, bo)):
                    b, (bh, bo) = r.b, stamp
                if pd.notna(r.n):
                    n = (n or 0) + int(r.n)
        self.row.update((cl, a, ah, ao, b, bh, bo, n))
        yield pd.DataFrame({"pk": [key[0]], "cl": [cl], "a": pd.array([a], "Float64"), "b": pd.array([b], "string"), "n": pd.array([n], "Int64")})

    def close(self) -> None:
        pass


def merged_stream(records: DataFrame) -> DataFrame:
    """Changing rows (pk, cl, a, b, n) of a stream of records; needs the RocksDB state store."""
    return records.groupBy("pk").transformWithStateInPandas(statefulProcessor=Merger(), outputStructType="pk long, cl long, a double, b string, n long", outputMode="Update", timeMode="None")


def _newest_version(spark: SparkSession, target: str, below: int) -> str | None:
    """The newest whole version below a batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for version in range(below - 1, -1, -1):
        done = path(f"{target}/{version:06d}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            return f"{target}/{version:06d}"
    return None


def incremental(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 4) -> None:
    """Merge all files below ``source`` in micro-batches into cell and counter states below ``target``.

    Each batch folds its records and the previous states together: a state is itself a record of
    its generation, so the result is that of merging everything at once. Contributions to counters
    count once for each dot; the dots seen are kept as ranges, which shrink to one range a
    writer as its gaps fill. Versions are folders named by batch; rerunning a batch writes the same folder.
    """

    def fold(batch: DataFrame, number: int) -> None:
        # the fold may start from the newest version below this batch only
        before, seen = _newest_version(spark, target, number), _newest_version(spark, f"{target}-dots", number)
        fresh = merge.once(batch.select("origin", "seq", "pk", "cl", "hlc", "a", "b", "n"))
        dots = frontier.ranges_of(fresh)
        if seen is not None:
            held = spark.read.parquet(seen)
            points = fresh.withColumns({"lo": F.col("seq"), "hi": F.col("seq")})
            fresh = frontier.meets(points, held).withColumn("n", F.when(~F.col("met"), F.col("n")))
            dots = frontier.merge_intervals(held.unionByName(dots))
        states = fresh.select("pk", "cl", "hlc", "origin", "a", "b", "n")
        if before is not None:
            states = states.unionByName(spark.read.parquet(before))
        cells = merge.cells(states, ["a", "b"])
        newest = states.groupBy("pk", "cl").agg(F.sum("n").alias("n")).groupBy("pk").agg(F.max_by(F.struct("cl", "n"), "cl").alias("w")).select("pk", "w.cl", "w.n")
        winner = F.max_by(F.struct("hlc", "origin", "val"), F.struct("hlc", "origin")).alias("w")
        kept = cells.join(newest, ["pk", "cl"], "left_semi").groupBy("pk", "cl", "col").agg(winner)
        rows = kept.select(
            "pk",
            "cl",
            F.col("w.hlc").alias("hlc"),
            F.col("w.origin").alias("origin"),
            F.when(F.col("col") == "a", F.col("w.val").cast("double")).alias("a"),
            F.when(F.col("col") == "b", F.col("w.val")).alias("b"),
            F.lit(None).cast("long").alias("n"),
        )
        zero = F.lit(0).cast("long")
        rows = rows.unionByName(newest.select("pk", "cl", zero.alias("hlc"), zero.alias("origin"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("string").alias("b"), "n"))
        rows.write.mode("overwrite").parquet(f"{target}/{number:06d}")
        dots.write.mode("overwrite").parquet(f"{target}-dots/{number:06d}")

    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drain(records: DataFrame, journal: str, checkpoint: str, on_published=None) -> None:
    """Write a stream of records to ``journal`` in batches, each published only when all of it is written.

    A batch is a folder; its marker below ``_published`` is made after the folder is whole, so readers
    of :func:`published` never see part of one, and a rerun batch writes the same folder again.
    ``on_published`` is called with the number and the rows of each published batch.
    """
    spark = records.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path

    def apply(batch: DataFrame, number: int) -> None:
        folder = f"{journal}/batch={number:06d}"
        batch.write.mode("overwrite").option("compression", "zstd").parquet(folder)
        marker = path(f"{journal}/_published/{number:06d}")
        marker.getFileSystem(spark._jsc.hadoopConfiguration()).create(marker, True).close()
        if on_published is not None:
            on_published(number, spark.read.schema(batch.schema).parquet(folder))

    records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def published(spark: SparkSession, journal: str, schema: str = RECORD) -> DataFrame:
    """The records of the published batches, with the column ``batch``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{journal}/_published")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = sorted(status.getPath().getName() for status in files.listStatus(path)) if files.exists(path) else []
    if not numbers:
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(schema).option("basePath", journal).parquet(*(f"{journal}/batch={n}" for n in numbers))


def _log_stream(spark: SparkSession, sf_dir: str, files_per_batch: int) -> tuple[DataFrame, str]:
    """The derived log, written out of order and with repeats in six files, as a stream; and a scratch folder."""
    from tidemark.sources import workspace
    from tidemark.sources.changelog import change_log, with_repeats

    folder = workspace.new_dir(spark, "stream")
    with_repeats(change_log(spark, sf_dir)).drop("event_id").repartition(6, F.xxhash64("seq", "origin")).write.parquet(f"{folder}/log")
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/log"), folder


def drained(spark: SparkSession, sf_dir: str, files_per_batch: int = 2) -> DataFrame:
    """The derived log through :func:`drain`: what readers see of it."""
    stream, folder = _log_stream(spark, sf_dir, files_per_batch)
    drain(stream, f"{folder}/journal", f"{folder}/checkpoint")
    return published(spark, f"{folder}/journal")


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of :func:`incremental` over the derived log."""
    from tidemark.sources import workspace

    _, folder = _log_stream(spark, sf_dir, 2)
    incremental(spark, f"{folder}/log", f"{folder}/state", f"{folder}/checkpoint", files_per_batch=2)
    return spark.read.parquet(f"{folder}/state/{sorted(workspace.folders(spark, f'{folder}/state'))[-1]}")


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log, written out of order and with repeats, streamed back and merged."""
    return merge.merge_cells(stream_state(spark, sf_dir))
