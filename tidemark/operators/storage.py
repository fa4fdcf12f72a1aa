"""Planning over tables of stored files: sealing, compaction, chains, retention, and recovery.

A file row is (origin, lo, hi, bytes, …) of inclusive seq intervals. What follows a writer's log
in order is a sweep over ranges of the sort (see ``placing``), so one writer takes many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.workspace import materialize

from .placing import running, scan


def overlapping(frames: DataFrame, origin: Column, lo: Column, hi: Column) -> DataFrame:
    """Frames that hold any seq of an interval; on sealed Parquet this prunes row groups by their statistics."""
    return frames.filter((F.col("origin") == origin) & (F.col("lo") <= hi) & (F.col("hi") >= lo))


def within(files: DataFrame, others: DataFrame) -> DataFrame:
    """``files`` with covered: whether one of ``others`` holds the whole interval.

    One does if, of those that begin at or before the file, the one that reaches farthest reaches its end.
    """
    rest = [c for c in files.columns if c != "origin"]
    mine = files.select("origin", F.col("lo").alias("_at"), F.lit(1).alias("_kind"), F.struct(*rest).alias("_row"), F.lit(None).cast("long").alias("_reach"))
    theirs = others.select("origin", F.col("lo").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), F.col("hi").alias("_reach"))
    swept = scan(mine.unionByName(theirs), ["origin"], ["_at", "_kind"], maxes={"_far": "_reach"}).filter("_kind = 1")
    return swept.select("origin", "_row.*", F.coalesce(F.col("_far") >= F.col("_row.hi"), F.lit(False)).alias("covered"))


def seal(records: DataFrame, most_bytes: int, most_age: int) -> DataFrame:
    """(origin, lo, hi, bytes, records): epochs, cut at gaps, by size and by age (of ``at`` since the stretch began)."""
    rows = running(records.select("origin", "seq", "bytes", "at"), ["origin", "seq"], sums={"_ahead": "bytes"}, place="_place")
    rows = materialize(rows.withColumn("_stretch", F.col("seq") - F.col("_place")), "seal")
    begun = rows.groupBy("origin", "_stretch").agg(F.min("_ahead").alias("_before"), F.min("at").alias("_since"))
    # as many stretches as the log has gaps: a join that Spark splits where one is long
    rows = rows.join(begun, ["origin", "_stretch"])
    rows = rows.withColumn("_size", F.floor((F.col("_ahead") - F.col("_before")) / most_bytes)).withColumn("_age", F.floor((F.col("at") - F.col("_since")) / most_age))
    grouped = rows.groupBy("origin", "_stretch", "_size", "_age").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.sum("bytes").alias("bytes"), F.count("*").alias("records"))
    return grouped.drop("_stretch", "_size", "_age")


def sealed_heads(files: DataFrame) -> DataFrame:
    """(origin, contiguous, uploaded): the end of the unbroken prefix of sealed files, and the last seq uploaded."""
    rows = scan(files.select("origin", "lo", "hi"), ["origin"], ["lo", "hi"], maxes={"_reach": "hi"}).withColumn("_reach", F.coalesce("_reach", F.lit(0)))
    rows = materialize(rows, "sealed")
    # nothing from the first gap on belongs to the prefix
    gap = rows.groupBy("origin").agg(F.min(F.when(F.col("lo") > F.col("_reach") + 1, F.col("lo"))).alias("_gap"), F.max("hi").alias("uploaded"))
    kept = rows.join(gap, "origin").filter("_gap IS NULL OR lo < _gap").groupBy("origin").agg(F.max("hi").alias("contiguous"))
    return gap.join(kept, "origin", "left").select("origin", F.coalesce("contiguous", F.lit(0)).alias("contiguous"), "uploaded")


def compact(small: DataFrame, large: DataFrame, least: int, most: int) -> DataFrame:
    """(origin, lo, hi, files): runs of adjoining small files that no large file covers, ``most`` to an output, only runs of ``least`` files or more."""
    free = within(small.select("origin", "lo", "hi"), large).filter("NOT covered").drop("covered")
    rows = scan(free, ["origin"], ["lo"], lags={"_end": "hi"}).withColumn("_new", F.when(F.col("_end") == F.col("lo") - 1, 0).otherwise(1))
    rows = materialize(running(rows, ["origin", "lo"], sums={"_ahead": "_new"}, place="_place").withColumn("_run", F.col("_ahead") + F.col("_new")), "compact")
    runs = rows.groupBy("_run").agg(F.count("*").alias("_files"), F.min("_place").alias("_first")).filter(F.col("_files") >= least)
    rows = rows.join(runs, "_run").withColumn("_chunk", F.floor((F.col("_place") - F.col("_first")) / most))
    chunks = rows.groupBy("origin", "_run", "_chunk").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("files"))
    return chunks.drop("_run", "_chunk")


def chain(small: DataFrame, large: DataFrame) -> DataFrame:
    """(origin, level, lo, hi, place): the files of a restore: all large ones, and small ones they do not cover, in order."""
    loose = within(small.select("origin", "lo", "hi"), large).filter("NOT covered")
    files = large.select("origin", F.lit(1).alias("level"), "lo", "hi").unionByName(loose.select("origin", F.lit(0).alias("level"), "lo", "hi"))
    ordered = scan(files.withColumn("_one", F.lit(1)), ["origin"], ["lo", F.col("level").desc()], sums={"_n": "_one"})
    return ordered.withColumn("place", (F.col("_n") + 1).cast("long")).drop("_n", "_one")


def sweep(files: DataFrame, large: DataFrame, baselines: DataFrame, now: int, grace: int) -> DataFrame:
    """Small files that may go: past their grace, and covered by a large file or wholly below the newest baseline of their origin."""
    newest = baselines.groupBy("origin").agg(F.max("hi").alias("_base"))
    judged = within(files.filter(F.col("at") <= now - grace), large).join(newest, "origin", "left")
    return judged.filter("covered OR hi <= _base").select(*files.columns).distinct()


def collectable(segments: DataFrame, now: int, keep: int) -> DataFrame:
    """Journal segments behind both the snapshot marker and the sealed head, and old enough."""
    return segments.filter((F.col("hi") <= F.col("marker")) & (F.col("hi") <= F.col("sealed")) & (F.col("at") <= now - keep))


def dirty(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows an incremental snapshot has to write."""
    return after.exceptAll(before)


def recover(snapshot: DataFrame, log: DataFrame, markers: DataFrame) -> DataFrame:
    """Records to merge: the snapshot's rows as records, and the log above each origin's marker."""
    above = log.join(markers, "origin", "left").filter("seq > coalesce(marker, 0)").drop("marker")
    return snapshot.unionByName(above.select(*snapshot.columns))


def write_epochs(records: DataFrame, path: str, span: int = 1_000_000) -> None:
    """Append records to a journal: zstd Parquet by origin, ``span`` seqs to a file, sorted so that row groups have narrow statistics."""
    spread = records.repartition("origin", F.floor(F.col("seq") / span)).sortWithinPartitions("origin", "seq")
    spread.write.mode("append").option("compression", "zstd").partitionBy("origin").parquet(path)


def read_epochs(spark: SparkSession, path: str, origins: Sequence[int] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Records of a journal, of some writers and from ``low`` to ``high``; other folders and row groups are not read."""
    rows = spark.read.parquet(path)
    if origins is not None:
        rows = rows.filter(F.col("origin").isin(*origins))
    if low is not None:
        rows = rows.filter(F.col("seq") >= low)
    if high is not None:
        rows = rows.filter(F.col("seq") <= high)
    return rows.withColumn("origin", F.col("origin").cast("long"))
