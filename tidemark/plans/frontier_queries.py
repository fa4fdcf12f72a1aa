"""Queries on frontiers, gaps and anti-entropy: FR."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import frontier
from tidemark.sources.changelog import change_log, stamped_events, table, with_holes, with_repeats

from .registry import query
from .sql import over_log

HELD = """holes AS (SELECT origin, seq FROM st WHERE seq % 17 <> 0 AND seq % 500 < 480),
  held AS (SELECT origin, min(seq) AS lo, max(seq) AS hi FROM (SELECT origin, seq, seq - row_number() OVER (PARTITION BY origin ORDER BY seq) AS g FROM holes) GROUP BY origin, g)"""
TIPS = HELD + ", tips AS (SELECT origin, max(seq) + 5 AS tip FROM st GROUP BY origin)"
MISSING = TIPS + """, mi AS (SELECT origin, hi + 1 AS lo, nxt AS hi FROM (SELECT *, coalesce(lead(lo) OVER (PARTITION BY origin ORDER BY lo) - 1, tip) AS nxt
  FROM (SELECT origin, 0 AS lo, 0 AS hi, tip FROM tips UNION ALL SELECT held.*, tip FROM held JOIN tips USING (origin))) WHERE nxt > hi)"""


def _dots(spark, d):
    return with_repeats(with_holes(stamped_events(spark, d)).filter("seq % 500 < 480")).select("origin", "seq")


def _held(spark, d):
    return frontier.ranges_of(_dots(spark, d))


def _tips(spark, d):
    return stamped_events(spark, d).groupBy("origin").agg((F.max("seq") + 5).alias("tip"))


@query("fr1_seq_ranges", over_log("SELECT * FROM held", HELD))
def fr1(spark, d):
    return _held(spark, d)


@query("fr2_contiguous_head", over_log("SELECT origin, coalesce(max(CASE WHEN lo = 1 THEN hi END), 0) AS head, max(hi) AS tip FROM held GROUP BY origin", HELD))
def fr2(spark, d):
    return frontier.heads(_held(spark, d))


@query("fr3_unseen_dots", over_log("SELECT origin, seq FROM st WHERE seq % 17 <> 0 AND seq % 500 < 480 AND seq % 5 <> 0 AND origin <> 2"))
def fr3(spark, d):
    return frontier.unseen(_dots(spark, d), stamped_events(spark, d).filter("seq % 5 = 0"), own=2)


@query("fr4_applied_tips", over_log("SELECT origin, max(seq) AS tip FROM holes GROUP BY origin", HELD))
def fr4(spark, d):
    return _dots(spark, d).groupBy("origin").agg(F.max("seq").alias("tip"))


@query("fr5_missing_ranges", over_log("SELECT * FROM mi", MISSING))
def fr5(spark, d):
    return frontier.missing(_held(spark, d), _tips(spark, d))


@query("fr6_retention_heads", over_log("SELECT origin, coalesce(max(CASE WHEN lo = 1 THEN hi END), 0) AS head FROM held WHERE origin <> 1 GROUP BY origin", HELD))
def fr6(spark, d):
    return frontier.retention_heads(_held(spark, d), own=1)


COVERAGE = "cov AS (SELECT event_id % 4 + 1 AS origin, event_id // 4 * 60 + 1 AS lo, event_id // 4 * 60 + 30 AS hi FROM events)"


@query(
    "fr7_fetch_plan",
    over_log(
        """SELECT *, row_number() OVER (PARTITION BY serveable ORDER BY origin, lo) AS place
        FROM (SELECT origin, lo, hi, EXISTS (SELECT 1 FROM cov WHERE cov.origin = mi.origin AND cov.lo <= mi.hi AND cov.hi >= mi.lo) AS serveable FROM mi WHERE origin <> 1)
        QUALIFY row_number() OVER (PARTITION BY serveable ORDER BY origin, lo) <= 150""",
        MISSING + ", " + COVERAGE,
    ),
)
def fr7(spark, d):
    e = F.col("event_id")
    start = F.floor(e / 4) * 60
    coverage = table(spark, d, "events").select((e % 4 + 1).alias("origin"), (start + 1).alias("lo"), (start + 30).alias("hi"))
    held = _held(spark, d)
    tips = frontier.merge_tips(_tips(spark, d), held.groupBy("origin").agg(F.max("hi").alias("tip")))
    return frontier.plan(held, tips, coverage, 150, own=1)


INTERVALS = "iv AS (SELECT user_id AS origin, event_id * 31 % 500 AS lo, event_id * 31 % 500 + event_id % 9 AS hi FROM events WHERE event_id % 3 = 0)"
MERGED = INTERVALS + """, mg AS (SELECT origin, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(n) OVER (PARTITION BY origin ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY origin ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM iv)) GROUP BY origin, g)"""


def _intervals(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").filter("event_id % 3 = 0").select(F.col("user_id").alias("origin"), (e * 31 % 500).alias("lo"), (e * 31 % 500 + e % 9).alias("hi"))


@query("fr8_merge_intervals", f"WITH {MERGED} SELECT * FROM mg")
def fr8(spark, d):
    return frontier.merge_intervals(_intervals(spark, d))


@query("fr9_gap_filler", over_log("SELECT origin, seq, CASE WHEN seq % 3 = 0 THEN 0 WHEN seq % 5 = 0 THEN 1 END AS source FROM st WHERE seq % 17 = 0"))
def fr9(spark, d):
    rows = stamped_events(spark, d).select("origin", "seq")
    return frontier.fill(rows.filter("seq % 17 = 0"), [rows.filter("seq % 3 = 0"), rows.filter("seq % 5 = 0")])


@query("fr10_backoff", "SELECT n_nationkey, least(500 * cast(power(2, n_nationkey) AS BIGINT), 60000) AS wait_ms FROM nation")
def fr10(spark, d):
    return table(spark, d, "nation").select("n_nationkey", frontier.backoff(F.col("n_nationkey"), 500, 60000).alias("wait_ms"))


@query(
    "fr11_serve",
    over_log(
        """SELECT origin, seq FROM (SELECT origin, seq, row_number() OVER w AS n, sum(seq % 90 + 10) OVER (PARTITION BY origin ORDER BY seq ROWS UNBOUNDED PRECEDING) AS bytes FROM st JOIN (SELECT origin AS o, lo, hi FROM held WHERE lo > 100) ON o = origin AND seq BETWEEN lo AND hi WINDOW w AS (PARTITION BY origin ORDER BY seq))
        WHERE n = 1 OR (n <= 300 AND bytes <= 15000)""",
        HELD,
    ),
)
def fr11(spark, d):
    records = stamped_events(spark, d).select("origin", "seq", (F.col("seq") % 90 + 10).alias("bytes"))
    return frontier.serve(records, _held(spark, d).filter("lo > 100"), 300, 15000).select("origin", "seq")


@query("fr12_all_peers_applied", over_log("SELECT origin, CASE WHEN origin = 4 THEN false ELSE origin <> 2 END AS applied FROM (SELECT DISTINCT origin FROM held)", HELD))
def fr12(spark, d):
    head = frontier.heads(_held(spark, d))
    peers = head.filter("origin <> 4").select("origin", F.explode(F.array(F.lit("p"), F.lit("q"))).alias("peer"), "head")
    peers = peers.select("origin", "peer", (F.col("head") - F.when((F.col("origin") == 2) & (F.col("peer") == "q"), 1).otherwise(0)).alias("peer_head"))
    return frontier.all_peers_applied(peers, head)


@query("fr13_discover", f"WITH {MERGED} SELECT mg.origin, lo, hi, tip FROM mg JOIN (SELECT origin, max(hi) AS tip FROM iv GROUP BY origin) USING (origin)")
def fr13(spark, d):
    tips, coverage = frontier.discover(_intervals(spark, d))
    return coverage.join(tips, "origin").select("origin", "lo", "hi", "tip")


@query("fr14_stability_horizon", over_log("SELECT min(last) AS horizon FROM (SELECT pk % 5 AS member, origin, max(hlc) AS last FROM log GROUP BY ALL)"))
def fr14(spark, d):
    progress = change_log(spark, d).select((F.col("pk") % 5).alias("member"), "origin", F.col("hlc").alias("last_hlc"))
    return frontier.horizon(progress, progress.select("member").distinct(), progress.select("origin").distinct())


@query(
    "fr15_prunable_tombstones",
    over_log("""SELECT pk, w.cl, w.hlc FROM (SELECT pk, arg_max({'cl': cl, 'hlc': hlc}, row(cl, hlc, origin)) AS w FROM log GROUP BY pk), (SELECT max(wall) AS top FROM b) WHERE w.cl % 2 = 0 AND w.hlc // 65536 < top - 3600000 AND w.hlc // 65536 < 4000000000000 - 1000"""),
)
def fr15(spark, d):
    log = change_log(spark, d)
    rows = log.groupBy("pk").agg(F.max_by(F.struct("cl", "hlc"), F.struct("cl", "hlc", "origin")).alias("w")).select("pk", "w.cl", "w.hlc")
    top = stamped_events(spark, d).agg(F.max("wall")).first()[0]
    return frontier.prunable(rows, F.lit(top), 4_000_000_000_000, 3_600_000, 1000)
