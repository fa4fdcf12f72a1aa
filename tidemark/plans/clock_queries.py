"""Queries on identity, clocks and scalar functions: ID, PR and FN."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import clock, codec, ids, predicate
from tidemark.sources.changelog import change_log, lived_events, stamped_events, table

from .registry import query
from .sql import over_log

COARSE = "t AS (SELECT origin, event_id, wall // 3600000 AS wall, event_id % 5 AS logical FROM b)"


def _coarse(spark, d):
    return stamped_events(spark, d).select("origin", "event_id", F.floor(F.col("wall") / 3600000).cast("long").alias("wall"), (F.col("event_id") % 5).alias("logical"))


@query(
    "id1_clock_compare",
    over_log(
        """SELECT event_id, coalesce((pw, pl) < (wall, logical), false) AS is_less, coalesce(pw = wall AND pl = logical, false) AS is_equal,
        CASE WHEN pw IS NULL OR (pw, pl) < (wall, logical) THEN wall ELSE pw END AS fwd_wall, CASE WHEN pw IS NULL OR (pw, pl) < (wall, logical) THEN logical ELSE pl END AS fwd_logical
        FROM (SELECT *, lag(wall) OVER (PARTITION BY origin ORDER BY event_id) AS pw, lag(logical) OVER (PARTITION BY origin ORDER BY event_id) AS pl FROM t)""",
        COARSE,
    ),
)
def id1(spark, d):
    by = Window.partitionBy("origin").orderBy("event_id")
    rows = _coarse(spark, d).withColumns({"pw": F.lag("wall").over(by), "pl": F.lag("logical").over(by)})
    before, now = (F.col("pw"), F.col("pl")), (F.col("wall"), F.col("logical"))
    later = F.when(F.col("pw").isNull(), F.struct(F.col("wall").alias("wall"), F.col("logical").alias("logical"))).otherwise(clock.forward(before, now))
    rows = rows.withColumn("fwd", later)
    less = F.coalesce(F.col("pw").isNotNull() & clock.less(before, now), F.lit(False))
    return rows.select("event_id", less.alias("is_less"), F.coalesce(clock.equal(before, now), F.lit(False)).alias("is_equal"), F.col("fwd.wall").alias("fwd_wall"), F.col("fwd.logical").alias("fwd_logical"))


@query("id2_pack", over_log("SELECT event_id, wall * 65536 + logical AS packed, wall, logical FROM t", COARSE))
def id2(spark, d):
    rows = _coarse(spark, d).withColumn("packed", clock.pack(F.col("wall"), F.col("logical"), checked=True))
    wall, logical = clock.unpack(F.col("packed"))
    return rows.select("event_id", "packed", wall.alias("wall"), logical.alias("logical"))


@query(
    "id3_dominates",
    over_log("SELECT event_id, ph IS NULL OR (hlc, origin) > (ph, po) AS dominates FROM (SELECT *, lag(hlc) OVER w AS ph, lag(origin) OVER w AS po FROM log WINDOW w AS (PARTITION BY pk ORDER BY event_id))"),
)
def id3(spark, d):
    by = Window.partitionBy("pk").orderBy("event_id")
    rows = change_log(spark, d).withColumn("s", clock.stamp())
    return rows.withColumn("p", F.lag("s").over(by)).select("event_id", clock.dominates(F.col("s"), F.col("p")).alias("dominates"))


@query(
    "id4_stamp_hlc",
    over_log(
        """SELECT event_id, hlc_wall, row_number() OVER (PARTITION BY origin, hlc_wall ORDER BY event_id) - 1 AS hlc_logical
        FROM (SELECT *, max(wall - event_id * 7 % 5) OVER (PARTITION BY origin ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hlc_wall FROM t)""",
        COARSE,
    ),
)
def id4(spark, d):
    rows = _coarse(spark, d).withColumn("wall", F.col("wall") - F.col("event_id") * 7 % 5)
    return clock.stamp_hlc(rows, "origin", "event_id", "wall").select("event_id", "hlc_wall", "hlc_logical")


@query("id5_observe_hlc", over_log("SELECT event_id, max(hlc) OVER (PARTITION BY pk ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_hlc FROM log"))
def id5(spark, d):
    return clock.observed(change_log(spark, d), "pk", "event_id", "hlc").select("event_id", "last_hlc")


@query("id6_alloc_seq", over_log("SELECT event_id, origin, row_number() OVER (PARTITION BY origin ORDER BY wall, event_id) AS seq FROM b"))
def id6(spark, d):
    return clock.allocate_seq(stamped_events(spark, d).drop("seq"), "origin", "wall", "event_id").select("event_id", "origin", "seq")


@query(
    "id7_skew_guard",
    over_log("SELECT event_id, CASE WHEN hlc // 65536 > w + 30000 THEN (w + 30000) * 65536 ELSE hlc END AS observed, hlc FROM (SELECT log.*, b.wall AS w FROM log JOIN b USING (event_id))"),
)
def id7(spark, d):
    now = stamped_events(spark, d).select("event_id", F.col("wall").alias("now"))
    return change_log(spark, d).join(now, "event_id").select("event_id", clock.admit(F.col("hlc"), F.col("now")).alias("observed"), "hlc")


@query(
    "id8_deps_satisfied",
    over_log("SELECT event_id, coalesce(have, 0) >= event_id % 1000 AS satisfied FROM b LEFT JOIN (SELECT n_nationkey % 25 AS chain, n_nationkey * 40 AS have FROM nation WHERE n_nationkey < 20) ON chain = pk % 25"),
)
def id8(spark, d):
    needs = stamped_events(spark, d).select("event_id", (F.col("pk") % 25).alias("chain"), (F.col("event_id") % 1000).alias("need"))
    have = table(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("chain"), (F.col("n_nationkey") * 40).cast("long").alias("have"))
    return clock.satisfied(needs, have).select("event_id", "satisfied")


@query("id9_encode_tuple", "SELECT l_orderkey, l_linenumber, md5('l_orderkey') || '0108' || lpad(lower(hex(l_orderkey)), 16, '0') || md5('l_linenumber') || '0108' || lpad(lower(hex(l_linenumber)), 16, '0') AS pk_blob FROM lineitem")
def id9(spark, d):
    blob = codec.encode_tuple([("l_orderkey", F.col("l_orderkey")), ("l_linenumber", F.col("l_linenumber").cast("long"))])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lower(F.hex(blob)).alias("pk_blob"))


@query("id10_generations", over_log("SELECT event_id, cast(cl AS BIGINT) AS cl, cast(CASE WHEN cl % 2 = 0 THEN cl + 1 ELSE cl END AS BIGINT) AS next_live, cast(CASE WHEN cl % 2 = 1 THEN cl + 1 ELSE cl END AS BIGINT) AS next_tomb FROM cl"))
def id10(spark, d):
    return lived_events(spark, d).select("event_id", "cl", clock.next_live(F.col("cl")).alias("next_live"), clock.next_tomb(F.col("cl")).alias("next_tomb"))


@query("id11_liveness", over_log("SELECT CASE WHEN cl = 0 THEN 'never' WHEN cl % 2 = 1 THEN 'live' ELSE 'tombstone' END AS state, count(*) AS n FROM cl GROUP BY 1"))
def id11(spark, d):
    return lived_events(spark, d).groupBy(clock.liveness(F.col("cl")).alias("state")).agg(F.count("*").alias("n"))


NULLED = "c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal, c_name FROM customer)"


def _nulled(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("seg"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"), "c_name")


@query("pr1_is_null", f"WITH {NULLED} SELECT c_custkey, seg IS NULL AS seg_null, bal IS NOT NULL AS bal_set FROM c")
def pr1(spark, d):
    P = predicate
    return _nulled(spark, d).select("c_custkey", P.compile(("is_null", "seg")).alias("seg_null"), P.compile(("not_null", "bal")).alias("bal_set"))


@query("pr2_compare", f"WITH {NULLED} SELECT c_custkey, bal < 1000 AS lt, bal >= 1000 AS ge, bal <> 1000 AS ne, seg = 'MACHINERY' AS eq FROM c")
def pr2(spark, d):
    P = predicate
    return _nulled(spark, d).select("c_custkey", P.compile(("<", "bal", 1000)).alias("lt"), P.compile((">=", "bal", 1000)).alias("ge"), P.compile(("<>", "bal", 1000)).alias("ne"), P.compile(("=", "seg", "MACHINERY")).alias("eq"))


@query("pr3_in", f"WITH {NULLED} SELECT c_custkey, seg IN ('MACHINERY', 'FURNITURE') AS inside, seg IN ('MACHINERY', NULL) AS with_null, seg NOT IN ('MACHINERY', NULL) AS outside FROM c")
def pr3(spark, d):
    P = predicate
    return _nulled(spark, d).select(
        "c_custkey",
        P.compile(("in", "seg", ("MACHINERY", "FURNITURE"))).alias("inside"),
        P.compile(("in", "seg", ("MACHINERY", None))).alias("with_null"),
        P.compile(("not_in", "seg", ("MACHINERY", None))).alias("outside"),
    )


@query("pr4_participates", f"WITH {NULLED} SELECT c_custkey FROM c WHERE (seg = 'MACHINERY' OR bal > 5000) AND NOT (bal < 0)")
def pr4(spark, d):
    return predicate.participating(_nulled(spark, d), ("and", ("or", ("=", "seg", "MACHINERY"), (">", "bal", 5000)), ("not", ("<", "bal", 0)))).select("c_custkey")


@query(
    "pr5_collations",
    "SELECT n_nationkey, translate(n_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = lower(n_name) AS nocase, rtrim(n_name || '  ', ' ') = n_name AS rtrimmed, n_name || ' ' = n_name AS bare FROM nation",
)
def pr5(spark, d):
    C = predicate.collate
    name = F.col("n_name")
    return table(spark, d, "nation").select(
        "n_nationkey",
        (C(name, "NOCASE") == C(F.lower(name), "NOCASE")).alias("nocase"),
        (C(F.concat(name, F.lit("  ")), "RTRIM") == C(name, "RTRIM")).alias("rtrimmed"),
        (C(F.concat(name, F.lit(" ")), "BINARY") == C(name, "BINARY")).alias("bare"),
    )


@query(
    "pr6_class_rank",
    """SELECT c_custkey, row_number() OVER (ORDER BY rank, num NULLS FIRST, txt NULLS FIRST, c_custkey) AS place
    FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rank, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS num, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS txt FROM customer)""",
)
def pr6(spark, d):
    tag = F.when(F.col("c_custkey") % 3 == 0, 2).when(F.col("c_custkey") % 3 == 1, 3).otherwise(4)
    rows = table(spark, d, "customer").select("c_custkey", tag.alias("tag"), F.when(F.col("tag") == 2, F.col("c_acctbal")).alias("num"), F.when(F.col("tag") > 2, F.col("c_name")).alias("txt"))
    return predicate.ranked(rows, "tag", "num", "txt", "c_custkey").select("c_custkey", "place")


@query("pr7_predicate_render", "SELECT c_custkey FROM customer WHERE (c_mktsegment IN ('MACHINERY', 'O''Neil') OR c_acctbal <= 10.5) AND c_name IS NOT NULL")
def pr7(spark, d):
    tree = predicate.parse("(c_mktsegment IN ('MACHINERY', 'O''Neil') OR c_acctbal <= 10.5) AND c_name IS NOT NULL")
    return table(spark, d, "customer").filter(F.expr(predicate.render(tree))).select("c_custkey")


@query("pr8_projection", "SELECT p_partkey AS id, p_name AS title, p_size AS size FROM part")
def pr8(spark, d):
    return predicate.project(table(spark, d, "part"), {"p_partkey": "id", "p_name": "title", "p_size": "size"})


@query("fn1_uuidv7")
def fn1(spark, d):
    return ids.with_uuid7(table(spark, d, "nation").select("n_nationkey"), "id")


@query("fn2_gen_id", "SELECT c_custkey, 777 * 8589934592 + row_number() OVER (ORDER BY c_custkey) AS id FROM customer")
def fn2(spark, d):
    return ids.with_gen_id(table(spark, d, "customer").select("c_custkey"), "c_custkey", partition=777)


@query("fn3_id_slice", "SELECT n_nationkey, cast(n_nationkey AS BIGINT) * 140737488355328 + 1 AS low, (cast(n_nationkey AS BIGINT) + 1) * 140737488355328 - 1 AS high FROM nation")
def fn3(spark, d):
    low, high = ids.id_slice(F.col("n_nationkey"))
    return table(spark, d, "nation").select("n_nationkey", low.alias("low"), high.alias("high"))


@query("fn4_pk_decode", "SELECT l_orderkey, l_linenumber, cast(l_orderkey AS VARCHAR) || ',' || cast(l_linenumber AS VARCHAR) AS decoded FROM lineitem")
def fn4(spark, d):
    blob = codec.encode_tuple([("l_orderkey", F.col("l_orderkey")), ("l_linenumber", F.col("l_linenumber").cast("long"))])
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", blob.alias("blob"))
    return rows.select("l_orderkey", "l_linenumber", codec.decode_tuple(F.col("blob")).alias("decoded"))


@query(
    "fn6_changeset_codec",
    over_log("""SELECT origin, seq, hlc, seq % 100 AS need, pk, op, CASE WHEN op <> 'D' THEN b END AS b, true AS intact,
        printf('02%016x%016x%016x', origin, seq, hlc) || md5('cluster') || printf('010000%016x', seq % 100) AS head FROM log"""),
)
def fn6(spark, d):
    """Changesets by their bytes: the header as it stands on the wire, and the records read back."""
    records = change_log(spark, d).select("origin", "seq", "hlc", "cl", "pk", "op", F.col("a").cast("string").alias("a"), "b", "n", (F.col("seq") % 100).alias("required_schema_seq"))
    payloads = codec.encode_changesets(records)
    heads = payloads.select("origin", "seq", F.lower(F.hex(F.substring("payload", 1, codec.HEADER + codec.DEP))).alias("head"))
    return codec.decode_changesets(payloads).select("origin", "seq", "hlc", "need", "pk", "op", "b", "intact").join(heads, ["origin", "seq"])


@query("fn7_canonical_values", "SELECT c_custkey, '1:' || cast(c_custkey AS VARCHAR) AS as_int, CASE WHEN c_acctbal < 0 THEN '1:1' ELSE '1:0' END AS as_bool, '3:' || c_name AS as_text, '4:' || lower(hex(encode(c_name))) AS as_blob FROM customer")
def fn7(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey",
        codec.canonical(F.col("c_custkey"), "bigint").alias("as_int"),
        codec.canonical(F.col("c_acctbal") < 0, "boolean").alias("as_bool"),
        codec.canonical(F.col("c_name"), "varchar").alias("as_text"),
        codec.canonical(F.col("c_name").cast("binary"), "bytea").alias("as_blob"),
    )


@query(
    "fn8_affinity",
    """SELECT t, CASE WHEN contains(u, 'INT') THEN 'INTEGER' WHEN contains(u, 'CHAR') OR contains(u, 'CLOB') OR contains(u, 'TEXT') THEN 'TEXT' WHEN contains(u, 'BLOB') OR u = '' THEN 'BLOB'
    WHEN contains(u, 'REAL') OR contains(u, 'FLOA') OR contains(u, 'DOUB') THEN 'REAL' ELSE 'NUMERIC' END AS affinity
    FROM (SELECT t, upper(t) AS u FROM (SELECT DISTINCT split_part(p_type, ' ', 1) || CASE p_size % 6 WHEN 0 THEN ' int' WHEN 1 THEN ' varchar(9)' WHEN 2 THEN ' Blob' WHEN 3 THEN ' double' WHEN 4 THEN '' ELSE ' decimal' END AS t FROM part))""",
)
def fn8(spark, d):
    kind = F.when(F.col("p_size") % 6 == 0, " int").when(F.col("p_size") % 6 == 1, " varchar(9)").when(F.col("p_size") % 6 == 2, " Blob").when(F.col("p_size") % 6 == 3, " double").when(F.col("p_size") % 6 == 4, "").otherwise(" decimal")
    types = table(spark, d, "part").select(F.concat(F.split_part("p_type", F.lit(" "), F.lit(1)), kind).alias("t")).distinct()
    return types.select("t", predicate.affinity(F.col("t")).alias("affinity"))


@query("fn9_default_ids", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'gen_id' WHEN 1 THEN 'uuidv7' END AS kind FROM nation")
def fn9(spark, d):
    text = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(" GEN_ID( '"), "n_name", F.lit("' )"))).when(F.col("n_nationkey") % 3 == 1, "(uuidv7())").otherwise(F.concat("n_name", F.lit("()")))
    return table(spark, d, "nation").select("n_nationkey", ids.default_kind(text).alias("kind"))
