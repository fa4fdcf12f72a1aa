"""Queries on merging: MG."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import merge
from tidemark.sources.changelog import change_log, row_log, table, with_holes, with_repeats

from .registry import query
from .sql import over_log

ROWS = "SELECT pk, w.cl, w.hlc, w.origin, w.a, w.b FROM (SELECT pk, arg_max({{'cl': cl, 'hlc': hlc, 'origin': origin, 'a': a, 'b': b}}, row(cl, hlc, origin)) AS w FROM {log} GROUP BY pk) WHERE w.cl % 2 = 1"


@query("mg1_row_merge", over_log(ROWS.format(log="rowlog")))
def mg1(spark, d):
    return merge.merge_rows(merge.once(with_repeats(row_log(spark, d))))


CELLS = """SELECT pk, cl, arg_max(a, row(hlc, origin)) FILTER (a IS NOT NULL) AS a, arg_max(b, row(hlc, origin)) FILTER (b IS NOT NULL) AS b FROM newest WHERE cl % 2 = 1 GROUP BY pk, cl"""


@query("mg2_cell_merge", over_log(CELLS))
def mg2(spark, d):
    return merge.merge_cells(merge.once(with_repeats(change_log(spark, d))))


@query(
    "mg3_as_cell_update",
    over_log("""SELECT origin, seq, CASE WHEN op = 'I' AND row(hlc, origin, seq) <> opened THEN 'U' ELSE op END AS acts_as, row_number() OVER (PARTITION BY pk, cl ORDER BY hlc, origin, seq) AS turn
    FROM (SELECT *, min(CASE WHEN op = 'I' THEN row(hlc, origin, seq) END) OVER (PARTITION BY pk, cl) AS opened FROM log)"""),
)
def mg3(spark, d):
    return merge.as_cell_updates(change_log(spark, d)).select("origin", "seq", "acts_as", "turn")


@query("mg4_counter_merge", over_log("SELECT pk, cl, cast(sum(n) AS BIGINT) AS total, true AS in_range FROM newest WHERE cl % 2 = 1 GROUP BY pk, cl"))
def mg4(spark, d):
    return merge.merge_counters(change_log(spark, d)).withColumn("total", F.col("total").cast("long"))


HUGE = "9223372036854775807"


@query(
    "mg5_checked_counter",
    over_log(f"""SELECT pk, CASE WHEN abs(total) <= {HUGE} THEN cast(total AS BIGINT) END AS total, CASE WHEN abs(total) <= {HUGE} OR total IS NULL THEN 'merged' ELSE 'quarantined' END AS outcome
    FROM (SELECT pk, sum(cast(n AS HUGEINT) * 4611686018427387) AS total FROM newest WHERE cl % 2 = 1 GROUP BY pk)"""),
)
def mg5(spark, d):
    big = F.col("n").cast("decimal(20,0)") * F.lit(4611686018427387).cast("decimal(18,0)")
    return merge.checked_counters(change_log(spark, d).withColumn("n", big))


WIRE = "w AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'I' ELSE 'U' END AS op, event_id % 5 < 3 AS is_counter, CASE WHEN event_id % 7 < 4 THEN 2 ELSE 1 END AS format, CASE WHEN event_id % 11 = 0 THEN 3 ELSE 1 END AS type_tag FROM events)"


@query(
    "mg6_counter_validation",
    f"""WITH {WIRE} SELECT event_id, CASE WHEN format = 2 AND NOT is_counter THEN 'delta on a register' WHEN format = 2 AND type_tag <> 1 THEN 'delta is not an integer'
    WHEN is_counter AND op = 'U' AND format <> 2 THEN 'counter update without delta' WHEN is_counter AND op = 'I' AND format = 2 THEN 'counter image as delta' END AS reason FROM w""",
)
def mg6(spark, d):
    e = F.col("event_id")
    wire = table(spark, d, "events").select(
        "event_id",
        F.when(e % 3 == 0, "I").otherwise("U").alias("op"),
        (e % 5 < 3).alias("is_counter"),
        F.when(e % 7 < 4, 2).otherwise(1).alias("format"),
        F.when(e % 11 == 0, 3).otherwise(1).alias("type_tag"),
    )
    return merge.counter_errors(wire).select("event_id", "reason")


@query("mg7_exactly_once", over_log("SELECT pk, count(*) AS records, cast(sum(n) AS BIGINT) AS total FROM log GROUP BY pk"))
def mg7(spark, d):
    return merge.once(with_repeats(change_log(spark, d))).groupBy("pk").agg(F.count("*").alias("records"), F.sum("n").alias("total"))


@query(
    "mg8_adopted_counters",
    over_log("""SELECT pk, cl, cast(sum(n) AS BIGINT) AS total FROM (SELECT pk, cl, n FROM newest WHERE cl % 2 = 1 UNION ALL SELECT pk, cl, pk * 10 FROM (SELECT DISTINCT pk, cl FROM newest WHERE cl = 1)) GROUP BY pk, cl"""),
)
def mg8(spark, d):
    log = change_log(spark, d)
    rows = log.groupBy("pk").agg(F.max("cl").alias("cl")).filter("cl = 1")
    adopted = rows.select("pk", "cl", (F.col("pk") * 10).alias("n"), F.lit(0).cast("long").alias("origin"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("hlc"), F.lit("I").alias("op"))
    return merge.merge_counters(merge.with_adopted(log, adopted)).select("pk", "cl", F.col("total").cast("long").alias("total"))


CLOCKS = """clocks AS (SELECT pk, cl, col, w.hlc, w.origin, w.val FROM (SELECT pk, cl, col, arg_max({'hlc': hlc, 'origin': origin, 'val': val}, row(hlc, origin)) AS w
  FROM (SELECT pk, cl, hlc, origin, 'a' AS col, cast(a AS VARCHAR) AS val FROM newest WHERE a IS NOT NULL AND cl % 2 = 1 UNION ALL SELECT pk, cl, hlc, origin, 'b', b FROM newest WHERE b IS NOT NULL AND cl % 2 = 1) GROUP BY pk, cl, col))"""


@query("mg9_collapse", over_log("SELECT pk, cl, bool_or(n = 2) AS covers_all FROM (SELECT pk, cl, hlc, origin, count(DISTINCT col) AS n FROM clocks GROUP BY ALL) GROUP BY pk, cl", CLOCKS))
def mg9(spark, d):
    return merge.collapse(merge.cell_clocks(change_log(spark, d)), 2)


@query(
    "mg10_effective_stamp",
    over_log("SELECT s.pk, coalesce(CASE WHEN s.pk % 3 = 0 THEN s.hlc + 1 END, c.hlc, s.hlc) AS governs FROM (SELECT pk, max(hlc) AS hlc FROM newest WHERE cl % 2 = 1 GROUP BY pk) s LEFT JOIN (SELECT pk, hlc FROM clocks WHERE col = 'a') c USING (pk)", CLOCKS),
)
def mg10(spark, d):
    log = change_log(spark, d)
    base = merge.newest_generation(log).filter("cl % 2 = 1").groupBy("pk").agg(F.max("hlc").alias("base"))
    cell = merge.cell_clocks(log).filter("col = 'a'").select("pk", F.col("hlc").alias("cell"))
    joined = base.join(cell, "pk", "left").withColumn("range", F.when(F.col("pk") % 3 == 0, F.col("base") + 1))
    return joined.select("pk", merge.effective(F.col("range"), F.col("cell"), F.col("base")).alias("governs"))


@query(
    "mg18_pending_updates",
    over_log("""SELECT pk, w.cl, w.op, w.origin, w.seq FROM (SELECT pk, arg_max({'cl': cl, 'op': op, 'origin': origin, 'seq': seq}, row(cl, hlc, origin)) AS w FROM holes GROUP BY pk) WHERE w.op = 'U'
    AND NOT EXISTS (SELECT 1 FROM holes i WHERE i.op = 'I' AND i.pk = q.pk AND i.cl = w.cl)""".replace("GROUP BY pk) WHERE", "GROUP BY pk) q WHERE"), "holes AS (SELECT * FROM log WHERE seq % 17 <> 0)"),
)
def mg18(spark, d):
    return merge.pending_updates(with_holes(change_log(spark, d)))


@query(
    "mg19_dropped_columns",
    over_log("""SELECT pk, col, CASE col WHEN 'a' THEN 'applied' ELSE 'ignored' END AS outcome FROM clocks UNION ALL SELECT DISTINCT pk, 'c', 'held' FROM newest WHERE cl % 2 = 1""", CLOCKS),
)
def mg19(spark, d):
    log = change_log(spark, d)
    cells = merge.cell_clocks(log).select("pk", "col").unionByName(merge.newest_generation(log).filter("cl % 2 = 1").select("pk").distinct().withColumn("col", F.lit("c")))
    known = spark.createDataFrame([("a", False), ("b", True)], "col string, dropped boolean")
    return merge.live_cells(cells, known)


@query("mg20_repair_set", over_log(f"SELECT * FROM ({ROWS.format(log='rowlog')}) EXCEPT ALL SELECT * FROM ({ROWS.format(log='(SELECT * FROM rowlog WHERE origin <> 3)')})"))
def mg20(spark, d):
    log = row_log(spark, d)
    return merge.repairs(merge.merge_rows(log.filter("origin <> 3")), merge.merge_rows(log))


@query(
    "mg21_atomic_changesets",
    "SELECT l_orderkey AS origin, count(*) AS records FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber <> 5) = max(CASE WHEN l_linenumber <> 5 THEN parts END) "
    "".replace("FROM lineitem", "FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS parts FROM lineitem)"),
)
def mg21(spark, d):
    lines = table(spark, d, "lineitem")
    parts = lines.groupBy("l_orderkey").agg(F.count("*").alias("parts"))
    arrived = lines.filter("l_linenumber <> 5").join(parts, "l_orderkey").select(F.col("l_orderkey").alias("origin"), F.lit(1).alias("seq"), "parts")
    return merge.whole_changesets(arrived).groupBy("origin").agg(F.count("*").alias("records"))


@query("mg22_order_free", over_log(CELLS))
def mg22(spark, d):
    """The model property: a shuffled log with repeats gives the same rows."""
    shuffled = with_repeats(change_log(spark, d)).repartition(7, F.xxhash64("origin", "seq")).sortWithinPartitions(F.xxhash64("seq", "origin"))
    return merge.merge_cells(merge.once(shuffled))


STATES = """gov AS (SELECT {key}, any_value(top) AS cl, max({{'hlc': hlc, 'origin': origin}}) FILTER (cl = top AND op IN ('I', 'D')) AS base,
  max({{'hlc': hlc, 'origin': origin}}) FILTER (cl = top AND op <> 'D' AND {a}) AS wa, max({{'hlc': hlc, 'origin': origin}}) FILTER (cl = top AND op <> 'D' AND {b}) AS wb FROM (SELECT *, max(cl) OVER (PARTITION BY {key}) AS top FROM {log}) GROUP BY {key})"""
STATE_ROWS = """SELECT {key}, cl, base.hlc AS base_hlc, base.origin AS base_origin, concat_ws(',', CASE WHEN wa IS NOT NULL AND (base IS NULL OR row(wa.hlc, wa.origin) > row(base.hlc, base.origin)) THEN 'a@' || wa.hlc || '/' || wa.origin END,
  CASE WHEN wb IS NOT NULL AND (base IS NULL OR row(wb.hlc, wb.origin) > row(base.hlc, base.origin)) THEN 'b@' || wb.hlc || '/' || wb.origin END) AS cells FROM gov"""


def _states(rows):
    """Row states with their cells as text."""
    text = F.transform("cells", lambda c: F.concat(c["col"], F.lit("@"), c["hlc"].cast("string"), F.lit("/"), c["origin"].cast("string")))
    return rows.withColumn("cells", F.array_join(text, ","))


@query("mg23_row_states", over_log(STATE_ROWS.format(key="pk"), STATES.format(key="pk", a="a IS NOT NULL", b="b IS NOT NULL", log="log")))
def mg23(spark, d):
    return _states(merge.row_states(change_log(spark, d)))


#: Two tables, a key of two columns, and updates that write null: every fifth update of "a", every seventh of "b".
TABLES = """wide AS (SELECT 't' || pk % 2 AS tbl, pk // 2 AS k1, 'k' || pk % 3 AS k2, origin, seq, hlc, cl, op, CASE WHEN op = 'U' AND seq % 5 = 0 THEN NULL ELSE a END AS a, CASE WHEN op = 'U' AND seq % 7 = 0 THEN NULL ELSE b END AS b,
  a IS NOT NULL AS a_present, b IS NOT NULL AS b_present, n FROM log)"""
KEY = ["tbl", "k1", "k2"]


def _wide(spark, d):
    log = change_log(spark, d)
    null = lambda c, every: F.when(~((F.col("op") == "U") & (F.col("seq") % every == 0)), F.col(c))
    pk = F.col("pk")
    return log.select(
        F.concat(F.lit("t"), (pk % 2).cast("string")).alias("tbl"), F.floor(pk / 2).alias("k1"), F.concat(F.lit("k"), (pk % 3).cast("string")).alias("k2"),
        "origin", "seq", "hlc", "cl", "op", null("a", 5).alias("a"), null("b", 7).alias("b"), F.col("a").isNotNull().alias("a_present"), F.col("b").isNotNull().alias("b_present"), "n",
    )


@query(
    "mg2_null_writes",
    over_log(
        """SELECT tbl, k1, k2, top AS cl, arg_max_null(a, row(hlc, origin)) FILTER (a_present) AS a, arg_max_null(b, row(hlc, origin)) FILTER (b_present) AS b
        FROM (SELECT *, max(cl) OVER (PARTITION BY tbl, k1, k2) AS top FROM wide) WHERE cl = top AND top % 2 = 1 GROUP BY tbl, k1, k2, top""",
        TABLES,
    ),
)
def mg2_null_writes(spark, d):
    return merge.merge_cells(merge.once(with_repeats(_wide(spark, d))), key=KEY)


@query("mg23_cell_stamps", over_log(STATE_ROWS.format(key="tbl, k1, k2"), TABLES + ", " + STATES.format(key="tbl, k1, k2", a="a_present", b="b_present", log="wide")))
def mg23_cell_stamps(spark, d):
    return _states(merge.row_states(_wide(spark, d), key=KEY))


@query("mg4_compound_key", over_log("SELECT tbl, k1, k2, top AS cl, cast(sum(n) AS BIGINT) AS total, true AS in_range FROM (SELECT *, max(cl) OVER (PARTITION BY tbl, k1, k2) AS top FROM wide) WHERE cl = top AND top % 2 = 1 GROUP BY tbl, k1, k2, top", TABLES))
def mg4_compound_key(spark, d):
    return merge.merge_counters(_wide(spark, d), key=KEY).withColumn("total", F.col("total").cast("long"))


@query(
    "dml_upsert",
    over_log("SELECT coalesce(c_custkey, pk) AS c_custkey, CASE WHEN pk IS NOT NULL THEN b ELSE c_mktsegment END AS c_mktsegment FROM customer FULL JOIN (" + CELLS + ") ON c_custkey = pk"),
)
def upsert(spark, d):
    changes = merge.merge_cells(change_log(spark, d)).select(F.col("pk").alias("c_custkey"), F.col("b").alias("c_mktsegment"))
    return merge.upsert(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), changes, "c_custkey", ["c_mktsegment"])
