"""Queries on conflicts, quarantine, health and the change feed: CF, QR, HL and ST."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit, frontier, merge
from tidemark.sources.changelog import change_log, stamped_events, table
from tidemark.streaming import feed

from .capture_queries import AFTER, COLUMNS, _orders
from .frontier_queries import HELD, _held
from .merge_queries import CELLS
from .registry import query
from .sql import over_log

LOSSES = """tops AS (SELECT *, max(cl) OVER (PARTITION BY pk) AS top FROM log),
  gov AS (SELECT pk, any_value(top) AS top, max({'hlc': hlc, 'origin': origin, 'seq': seq}) FILTER (cl = top AND op IN ('I', 'D')) AS base,
          max({'hlc': hlc, 'origin': origin, 'seq': seq}) FILTER (cl = top AND op <> 'D' AND a IS NOT NULL) AS wa, max({'hlc': hlc, 'origin': origin, 'seq': seq}) FILTER (cl = top AND op <> 'D' AND b IS NOT NULL) AS wb FROM tops GROUP BY pk),
  ls AS (SELECT t.pk, t.origin, t.seq, t.op, t.cl, t.hlc, t.top, x.col, x.w FROM tops t JOIN gov g USING (pk), (SELECT unnest([
          CASE WHEN t.op = 'D' THEN {'col': '', 'w': g.base} END, CASE WHEN t.op <> 'D' AND t.a IS NOT NULL THEN {'col': 'a', 'w': coalesce(g.wa, g.base)} END, CASE WHEN t.op <> 'D' AND t.b IS NOT NULL THEN {'col': 'b', 'w': coalesce(g.wb, g.base)} END]) AS x)
         WHERE x IS NOT NULL AND x.w IS NOT NULL AND x.w.origin <> t.origin AND (t.cl < t.top OR row(x.w.hlc, x.w.origin) > row(t.hlc, t.origin))),
  cf AS (SELECT pk, origin, seq, op, w.origin AS winner_origin, w.seq AS winner_seq, CASE WHEN cl <> top THEN 'superseded' ELSE 'concurrent' END AS kind, string_agg(col, ',' ORDER BY col) AS cols
         FROM ls GROUP BY pk, origin, seq, op, cl, top, w)"""


@query("cf1_conflict_log", over_log("SELECT * FROM cf", LOSSES))
def cf1(spark, d):
    return audit.conflicts(change_log(spark, d))


@query("cf2_conflict_kinds", over_log("SELECT kind, count(*) AS n FROM cf GROUP BY kind", LOSSES))
def cf2(spark, d):
    return audit.conflicts(change_log(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query("cf3_newest_conflicts", over_log("SELECT pk, origin, seq, cols FROM cf ORDER BY seq * 10 + origin DESC, cols LIMIT 500", LOSSES))
def cf3(spark, d):
    rows = audit.conflicts(change_log(spark, d)).withColumn("at", F.col("seq") * 10 + F.col("origin"))
    return audit.newest(rows, "at", 500, ["cols"]).select("pk", "origin", "seq", "cols")


@query(
    "cf4_lost_columns",
    f"""WITH {AFTER} SELECT o_orderkey, 'o_orderstatus' AS col, o.o_orderstatus AS lost, n.o_orderstatus AS won FROM orders o JOIN after n USING (o_orderkey) WHERE o.o_orderstatus IS DISTINCT FROM n.o_orderstatus
    UNION ALL SELECT o_orderkey, 'o_orderpriority', o.o_orderpriority, n.o_orderpriority FROM orders o JOIN after n USING (o_orderkey) WHERE o.o_orderpriority IS DISTINCT FROM n.o_orderpriority""",
)
def cf4(spark, d):
    return audit.lost_columns(*_orders(spark, d), "o_orderkey", COLUMNS, counters=["o_custkey"])


BAD = "CASE WHEN n > 150 THEN 'delta too large' WHEN op = 'U' AND seq % 50 = 0 THEN 'no such row' END"


def _judged(spark, d, most=20):
    reason = F.when(F.col("n") > 150, "delta too large").when((F.col("op") == "U") & (F.col("seq") % 50 == 0), "no such row")
    return audit.quarantine(change_log(spark, d), reason, most)


@query("qr1_quarantine", over_log(f"SELECT origin, seq, reason FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY seq) AS rn FROM (SELECT *, {BAD} AS reason FROM log) WHERE reason IS NOT NULL) WHERE rn <= 20"))
def qr1(spark, d):
    return _judged(spark, d)[1].select("origin", "seq", "reason")


@query(
    "qr2_quarantine_stats",
    over_log(f"SELECT origin, count(*) AS n, min(hlc) AS first_seen, max(seq % 5) AS attempts FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY seq) AS rn FROM (SELECT *, {BAD} AS reason FROM log) WHERE reason IS NOT NULL) WHERE rn <= 20 GROUP BY origin"),
)
def qr2(spark, d):
    rows = _judged(spark, d)[1].withColumns({"first_seen": F.col("hlc"), "attempts": F.col("seq") % 5})
    return audit.quarantine_stats(rows)


@query(
    "hl1_inbound_health",
    over_log(
        f"""SELECT t.origin, coalesce(head, 0) AS head, tip, tip - coalesce(head, 0) AS lag, coalesce(q, 0) AS quarantined, coalesce(g, 0) AS held FROM (SELECT origin, max(seq) AS tip FROM st GROUP BY origin) t
        LEFT JOIN (SELECT origin, coalesce(max(CASE WHEN lo = 1 THEN hi END), 0) AS head FROM held GROUP BY origin) USING (origin)
        LEFT JOIN (SELECT origin, least(count(*), 20) AS q FROM log WHERE {BAD} IS NOT NULL GROUP BY origin) USING (origin) LEFT JOIN (SELECT origin, count(*) AS g FROM log WHERE seq % 9 > 5 GROUP BY origin) USING (origin)""",
        HELD,
    ),
)
def hl1(spark, d):
    tips = stamped_events(spark, d).groupBy("origin").agg(F.max("seq").alias("tip"))
    return audit.health(frontier.heads(_held(spark, d)), tips, _judged(spark, d)[1], change_log(spark, d).filter("seq % 9 > 5"))


@query(
    "hl1_peers",
    over_log(
        """SELECT peer, origin, peer_head, coalesce(head, 0) AS head, greatest(coalesce(head, 0) - peer_head, 0) AS behind, greatest(peer_head - coalesce(head, 0), 0) AS ahead, last_seen, last_seen > 4000 - 1500 AS alive
        FROM (SELECT pk % 4 AS peer, origin, max(seq) AS peer_head FROM log GROUP BY ALL) JOIN (SELECT pk % 4 AS peer, max(seq % (1000 * (pk % 4 + 1))) AS last_seen FROM log GROUP BY ALL) USING (peer)
        LEFT JOIN (SELECT origin, coalesce(max(CASE WHEN lo = 1 THEN hi END), 0) AS head FROM held GROUP BY origin) USING (origin)""",
        HELD,
    ),
)
def hl1_peers(spark, d):
    peer = F.col("pk") % 4
    progress = change_log(spark, d).select(peer.alias("peer"), "origin", F.col("seq").alias("peer_head"), (F.col("seq") % (1000 * (peer + 1))).alias("last_seen"))
    return audit.peers(progress, frontier.heads(_held(spark, d)), 4000, 1500)


@query(
    "hl2_restore_orphans",
    over_log("""SELECT tbl, clocks - present AS orphans FROM (SELECT 't' || pk % 5 AS tbl, count(*) FILTER (top % 2 = 1) AS clocks, count(*) FILTER (top % 2 = 1 AND pk % 4 > 0) AS present FROM (SELECT pk, max(cl) AS top FROM log GROUP BY pk) GROUP BY 1) WHERE clocks > present"""),
)
def hl2(spark, d):
    clocks = change_log(spark, d).groupBy("pk").agg(F.max("cl").alias("cl")).withColumn("tbl", F.concat(F.lit("t"), (F.col("pk") % 5).cast("string")))
    return audit.orphans(clocks, clocks.filter("cl % 2 = 1 AND pk % 4 > 0"), clocks.select("tbl").distinct())


@query(
    "hl3_apply_outcomes",
    over_log("""SELECT CASE WHEN origin = 1 OR seq % 13 = 0 THEN 'ignored' WHEN seq % 11 > 8 THEN 'schema-gated' WHEN n > 150 THEN 'quarantined' WHEN seq % 101 = 0 THEN 'transient' ELSE 'applied' END AS outcome, count(*) AS n FROM log GROUP BY 1"""),
)
def hl3(spark, d):
    s = F.col("seq")
    said = audit.outcome(F.col("origin") == 1, s % 13 == 0, s % 11 > 8, F.coalesce(F.col("n") > 150, F.lit(False)), s % 101 == 0)
    return change_log(spark, d).groupBy(said.alias("outcome")).agg(F.count("*").alias("n"))


@query("st1_notifications", over_log("SELECT origin, seq, count(*) AS records, 't' || pk % 3 AS table_name FROM log WHERE pk % 3 <> 1 GROUP BY origin, seq, pk % 3"))
def st1(spark, d):
    log = change_log(spark, d).withColumn("table_name", F.concat(F.lit("t"), (F.col("pk") % 3).cast("string")))
    return feed.notifications(log, tables=["t0", "t2"])


@query("st2_changes_scan", over_log("SELECT origin, seq, 't' || pk % 3 AS table_name, op, cast(pk AS VARCHAR) AS pk FROM log WHERE pk % 3 = 1"))
def st2(spark, d):
    log = change_log(spark, d).withColumn("table_name", F.concat(F.lit("t"), (F.col("pk") % 3).cast("string")))
    return feed.changes(log).filter("table_name = 't1'").select("origin", "seq", "table_name", "op", "pk")


@query(
    "st3_ring_truncation",
    "SELECT p_partkey, left(p_name || p_type || p_name, 72) AS pk, len(p_name || p_type || p_name) > 72 AS pk_truncated, left(p_brand || p_type || p_name, 32) AS table_name, len(p_brand || p_type || p_name) > 32 AS table_truncated FROM part",
)
def st3(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", "p_type", "p_name").alias("pk"), F.concat("p_brand", "p_type", "p_name").alias("table_name"))
    return feed.ring_slots(rows)


@query("st4_lossy_feed", over_log("SELECT origin, CASE WHEN count(*) > 1300 THEN true ELSE false END AS lossy, least(count(*), 1300) AS delivered FROM log GROUP BY origin"))
def st4(spark, d):
    return feed.delivered(change_log(spark, d), buffer=1300).groupBy("origin").agg(F.bool_or("lossy").alias("lossy"), F.count_if(~F.col("lossy")).alias("delivered"))


@query("st5_streaming_merge", over_log(CELLS))
def st5(spark, d):
    """The cell merge fed by a stream: every record in some micro-batch, late and repeated ones included."""
    return feed.stream_merge(spark, d)


@query("st5_streaming_counters", over_log("SELECT pk, cl, cast(sum(n) AS BIGINT) AS total, true AS in_range FROM newest WHERE cl % 2 = 1 GROUP BY pk, cl"))
def st5_counters(spark, d):
    """The counters of the same stream, whose repeated records count once."""
    return merge.merge_counters(feed.stream_state(spark, d)).withColumn("total", F.col("total").cast("long"))


@query("cp13_batch_sink", over_log("SELECT origin, seq, CASE WHEN seq % 13 = 0 THEN 2 ELSE 1 END AS times FROM log"))
def cp13(spark, d):
    """What readers see of a log that a sink has written and published in batches."""
    return feed.drained(spark, d).groupBy("origin", "seq").agg(F.count("*").alias("times"))


@query("st7_drained_batches", over_log("SELECT 3 AS batches, count(*) + count(*) FILTER (seq % 13 = 0) AS records FROM log"))
def st7(spark, d):
    """Six files, two to a batch."""
    return feed.drained(spark, d, files_per_batch=2).agg(F.count_distinct("batch").alias("batches"), F.count("*").alias("records"))
