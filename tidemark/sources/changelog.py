"""Change logs: their shape, and a deterministic one derived from the ``events`` table.

A record has origin and seq (its dot), hlc, the key pk, the causal length cl, op (I, U or D),
two register cells a and b and one counter contribution n; null means "column not carried".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import pack


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wall_ms(ts: str | Column = "ts") -> Column:
    """Milliseconds since the epoch of a timestamp without time zone, rounded down."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts) / 1000).cast("long")


def _running(*partition: str) -> Window:
    return Window.partitionBy(*partition).orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def stamped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its writer, dense seq, wall clock and delta."""
    events = table(spark, sf_dir, "events")
    base = events.select(
        (F.col("event_id") % 4 + 1).alias("origin"),
        wall_ms().alias("wall"),
        F.col("user_id").alias("pk"),
        F.col("event_type").alias("et"),
        "value",
        "event_id",
        F.round("value").cast("long").alias("delta"),
    )
    return base.withColumn("seq", F.row_number().over(Window.partitionBy("origin").orderBy("wall", "event_id")).cast("long"))


def lived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamped events with whether their row lives before and after, and its causal length."""
    mark = F.when(F.col("et").isin("signup", "error"), F.col("event_id") * 2 + F.when(F.col("et") == "signup", 1).otherwise(0))
    rows = stamped_events(spark, sf_dir).withColumn("k", F.max(mark).over(_running("pk")))
    rows = rows.withColumn("live", F.coalesce(F.col("k") % 2, F.lit(0)))
    rows = rows.withColumn("prev", F.coalesce(F.lag("live").over(Window.partitionBy("pk").orderBy("event_id")), F.lit(0)))
    return rows.withColumn("cl", F.sum(F.abs(F.col("live") - F.col("prev"))).over(_running("pk")))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log: four writers, two of them with skewed clocks, rows that die and come back."""
    skew = F.when(F.col("origin") == 3, 864000000).when(F.col("origin") == 4, -7200000).otherwise(0)
    first = (F.col("et") == "signup") & (F.col("prev") == 0)
    return (
        lived_events(spark, sf_dir)
        .filter((F.col("et") == "signup") | (F.col("prev") == 1))
        .select(
            "origin",
            "seq",
            pack(F.col("wall") + skew, F.lit(0)).alias("hlc"),
            "pk",
            F.col("cl").cast("long").alias("cl"),
            F.when(F.col("et") == "signup", F.when(F.col("prev") == 0, "I").otherwise("U")).when(F.col("et") == "error", "D").otherwise("U").alias("op"),
            F.when(F.col("et").isin("signup", "click"), F.col("value")).alias("a"),
            F.when(F.col("et").isin("signup", "view"), F.col("et")).alias("b"),
            F.when(F.col("et") == "purchase", F.col("delta")).when(first, F.col("delta")).alias("n"),
            "event_id",
        )
    )


def row_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as row groups ship it: full images, cells carried forward within a generation."""
    so_far = _running("pk", "cl")
    log = change_log(spark, sf_dir)
    return log.withColumns({"a": F.last("a", ignorenulls=True).over(so_far), "b": F.last("b", ignorenulls=True).over(so_far)})


def with_holes(log: DataFrame) -> DataFrame:
    """Without every seventeenth seq: real gaps."""
    return log.filter("seq % 17 <> 0")


def with_repeats(log: DataFrame) -> DataFrame:
    """With every thirteenth seq delivered twice."""
    return log.unionByName(log.filter("seq % 13 = 0"))
