"""Queries on stored files and recovery: IO."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import merge, storage
from tidemark.sources import workspace
from tidemark.sources.changelog import change_log, row_log, stamped_events, table

from .merge_queries import ROWS
from .registry import query
from .sql import over_log

FILES = "fl0 AS (SELECT user_id AS origin, event_id // 150 * 10 + 1 AS lo, event_id // 150 * 10 + 10 AS hi, event_id * 37 % 900 AS at FROM events WHERE event_id % 6 > 0), fl1 AS (SELECT user_id AS origin, event_id // 1500 * 100 + 1 AS lo, event_id // 1500 * 100 + 100 AS hi FROM events WHERE event_id % 7 = 0 AND event_id % 1500 < 300)"


def _files(spark, d):
    e = F.col("event_id")
    events = table(spark, d, "events")
    step = F.floor(e / 150).cast("long") * 10
    large = F.floor(e / 1500).cast("long") * 100
    small = events.filter("event_id % 6 > 0").groupBy(F.col("user_id").alias("origin"), (step + 1).alias("lo"), (step + 10).alias("hi")).agg(F.max(e * 37 % 900).alias("at"))
    return small, events.filter("event_id % 7 = 0 AND event_id % 1500 < 300").select(F.col("user_id").alias("origin"), (large + 1).alias("lo"), (large + 100).alias("hi")).distinct()


FILES += ", f0 AS (SELECT origin, lo, hi, max(at) AS at FROM fl0 GROUP BY origin, lo, hi), f1 AS (SELECT DISTINCT * FROM fl1)"
FREE = "NOT EXISTS (SELECT 1 FROM f1 WHERE f1.origin = f0.origin AND f0.lo >= f1.lo AND f0.hi <= f1.hi)"


def _journal(spark, d):
    """The derived log as a journal on disk."""
    folder = workspace.new_dir(spark, "journal")
    storage.write_epochs(change_log(spark, d).drop("event_id"), folder, span=500)
    return folder


@query("io1_journal_tail", over_log("SELECT origin, seq, hlc, pk, cl, op, a, b, n FROM log WHERE seq > 1000"))
def io1(spark, d):
    return storage.read_epochs(spark, _journal(spark, d), low=1001)


@query("io2_mirror_log", over_log("SELECT origin, seq, op, pk FROM log WHERE origin IN (2, 4) AND seq BETWEEN 300 AND 900"))
def io2(spark, d):
    return storage.read_epochs(spark, _journal(spark, d), origins=[2, 4], low=300, high=900).select("origin", "seq", "op", "pk")


@query("io3_frames_overlapping", f"WITH {FILES.replace(' AS at', ' AS tm').replace('max(at)', 'max(tm)')} SELECT origin, lo, hi FROM f0 WHERE origin = 7 AND lo <= 300 AND hi >= 100")
def io3(spark, d):
    small, _ = _files(spark, d)
    return storage.overlapping(small, F.lit(7), F.lit(100), F.lit(300)).select("origin", "lo", "hi")


@query(
    "io4_seal_epochs",
    over_log("""SELECT origin, min(seq) AS lo, max(seq) AS hi, cast(sum(bytes) AS BIGINT) AS bytes, count(*) AS records FROM (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY origin, st ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2000 AS size, (wall - min(wall) OVER (PARTITION BY origin, st)) // 40000000 AS age
    FROM (SELECT *, sum(g) OVER (PARTITION BY origin ORDER BY seq) AS st FROM (SELECT origin, seq, wall, seq % 90 + 10 AS bytes, CASE WHEN lag(seq) OVER (PARTITION BY origin ORDER BY seq) = seq - 1 THEN 0 ELSE 1 END AS g FROM st WHERE seq % 177 <> 0))) GROUP BY origin, st, size, age"""),
)
def io4(spark, d):
    records = stamped_events(spark, d).filter("seq % 177 <> 0").select("origin", "seq", F.col("wall").alias("at"), (F.col("seq") % 90 + 10).alias("bytes"))
    return storage.seal(records, 2000, 40_000_000)


NAMED = FILES.replace(" AS at", " AS tm").replace("max(at)", "max(tm)")


@query(
    "io5_sealed_heads",
    f"""WITH {NAMED} SELECT origin, coalesce(max(hi) FILTER (broken = 0), 0) AS contiguous, max(hi) AS uploaded FROM (SELECT *, max(CASE WHEN lo > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY origin ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS broken
    FROM (SELECT *, coalesce(max(hi) OVER (PARTITION BY origin ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM f0)) GROUP BY origin""",
)
def io5(spark, d):
    return storage.sealed_heads(_files(spark, d)[0])


@query(
    "io6_compaction_runs",
    f"""WITH {NAMED}, fr AS (SELECT * FROM f0 WHERE {FREE}), ru AS (SELECT *, sum(n) OVER (PARTITION BY origin ORDER BY lo) AS run FROM (SELECT *, CASE WHEN lag(hi) OVER (PARTITION BY origin ORDER BY lo) = lo - 1 THEN 0 ELSE 1 END AS n FROM fr))
    SELECT origin, min(lo) AS lo, max(hi) AS hi, count(*) AS files FROM (SELECT *, count(*) OVER (PARTITION BY origin, run) AS k, (row_number() OVER (PARTITION BY origin, run ORDER BY lo) - 1) // 4 AS chunk FROM ru) WHERE k >= 3 GROUP BY origin, run, chunk""",
)
def io6(spark, d):
    return storage.compact(*_files(spark, d), least=3, most=4)


@query("io7_restore_chain", f"WITH {NAMED}, c AS (SELECT origin, 1 AS level, lo, hi FROM f1 UNION ALL SELECT origin, 0, lo, hi FROM f0 WHERE {FREE}) SELECT *, row_number() OVER (PARTITION BY origin ORDER BY lo, level DESC) AS place FROM c")
def io7(spark, d):
    return storage.chain(*_files(spark, d))


@query(
    "io8_retention_sweep",
    f"WITH {NAMED} SELECT origin, lo, hi FROM f0 WHERE tm <= 900 - 200 AND (NOT {FREE} OR hi <= (SELECT max(f1.hi) FROM f1 WHERE f1.origin = f0.origin AND f1.lo < 300))",
)
def io8(spark, d):
    small, large = _files(spark, d)
    return storage.sweep(small, large, large.filter("lo < 300"), now=900, grace=200).select("origin", "lo", "hi")


@query("io9_journal_gc", f"WITH {NAMED} SELECT origin, lo, hi FROM f0 WHERE hi <= 400 AND hi <= 350 + origin % 100 AND tm <= 900 - 300")
def io9(spark, d):
    small, _ = _files(spark, d)
    segments = small.withColumns({"marker": F.lit(400), "sealed": F.lit(350) + F.col("origin") % 100})
    return storage.collectable(segments, now=900, keep=300).select("origin", "lo", "hi")


@query("io11_dirty_rows", over_log(f"SELECT * FROM ({ROWS.format(log='rowlog')}) EXCEPT ALL SELECT * FROM ({ROWS.format(log='(SELECT * FROM rowlog WHERE seq <= 1500)')})"))
def io11(spark, d):
    log = row_log(spark, d)
    return storage.dirty(merge.merge_rows(log.filter("seq <= 1500")), merge.merge_rows(log))


@query("io12_recovery_replay", over_log(ROWS.format(log="rowlog")))
def io12(spark, d):
    """Snapshot rows (the winners up to a marker, tombstones included) and the log above it merge to the same state."""
    log = row_log(spark, d)
    columns = ["pk", "cl", "hlc", "origin", "a", "b"]
    best = log.filter("seq <= 1200").groupBy("pk").agg(F.max_by(F.struct(*columns[1:]), F.struct("cl", "hlc", "origin")).alias("w")).select("pk", "w.*")
    markers = log.select("origin").distinct().withColumn("marker", F.lit(1200))
    return merge.merge_rows(storage.recover(best, log, markers))


@query("io15_dump", over_log("SELECT origin || ':' || seq || ' ' || op || ' pk=' || pk || ' cl=' || cl AS line FROM log"))
def io15(spark, d):
    return change_log(spark, d).select(F.format_string("%d:%d %s pk=%d cl=%d", "origin", "seq", "op", "pk", "cl").alias("line"))
