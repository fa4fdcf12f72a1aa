"""Queries on the schema log and the delegated SQL: SC and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.engine import MergeEngine
from tidemark.operators import catalog
from tidemark.sources import workspace
from tidemark.sources.changelog import change_log, row_log, table

from .merge_queries import ROWS
from .registry import query
from .sql import over_log

EVENTS = """ev AS (SELECT p_partkey AS schema_seq, p_partkey - 1 - CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE 0 END AS parent_seq, CASE p_partkey % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'column' ELSE 'key' END AS object_kind,
  'o' || p_partkey % 3 || '-' || p_partkey % 181 AS object_id, CASE WHEN p_partkey <= 543 THEN 'create' WHEN p_size % 4 = 0 THEN 'drop' ELSE 'rename' END AS action, p_name AS name FROM part)"""
FOLD = "SELECT object_kind, object_id, arg_max(name, schema_seq) FILTER (action IN ('create', 'rename')) AS name, min(schema_seq) FILTER (action = 'create') AS create_seq, max(schema_seq) FILTER (action = 'drop') AS drop_seq FROM ev {where} GROUP BY 1, 2"


def _events(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("schema_seq"),
        (k - 1 - F.when(k % 97 == 0, 1).otherwise(0)).alias("parent_seq"),
        F.when(k % 3 == 0, "table").when(k % 3 == 1, "column").otherwise("key").alias("object_kind"),
        F.concat(F.lit("o"), (k % 3).cast("string"), F.lit("-"), (k % 181).cast("string")).alias("object_id"),
        F.when(k <= 543, "create").when(F.col("p_size") % 4 == 0, "drop").otherwise("rename").alias("action"),
        F.col("p_name").alias("name"),
    )


@query("sc1_append_order", f"WITH {EVENTS} SELECT schema_seq, parent_seq = coalesce(lag(schema_seq) OVER (ORDER BY schema_seq), 0) AS in_order FROM ev")
def sc1(spark, d):
    return catalog.valid_chain(_events(spark, d)).select("schema_seq", "in_order")


@query("sc2_read_head", f"WITH {EVENTS} SELECT schema_seq, object_id, (SELECT max(schema_seq) FROM ev) AS head FROM ev WHERE schema_seq >= 100 ORDER BY schema_seq LIMIT 50")
def sc2(spark, d):
    events = _events(spark, d)
    return catalog.page(events, 100, 50).select("schema_seq", "object_id").join(F.broadcast(catalog.head(events)), F.col("schema_seq") <= F.col("head"))


KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in catalog.KINDS) + "]"


@query("sc3_schema_log_file", f"SELECT n_nationkey + 1 AS schema_seq, n_nationkey AS parent_seq, {KINDS_SQL}[n_nationkey % 19 + 1] AS kind, n_name AS name, (SELECT count(*) FROM nation) AS refused FROM nation")
def sc3(spark, d):
    """A schema log on disk: one event for each nation, each of them tried twice from the same parent."""
    folder = workspace.new_dir(spark, "schema-log")
    refused = 0
    for row in table(spark, d, "nation").orderBy("n_nationkey").collect():  # a log of DDL statements is written one by one
        event = {"kind": catalog.KINDS[row["n_nationkey"] % 19], "object_id": f"o{row['n_nationkey']}", "name": row["n_name"]}
        catalog.append(spark, folder, row["n_nationkey"], event)
        refused += not catalog.append(spark, folder, row["n_nationkey"], event)
    return catalog.read_log(spark, folder).select("schema_seq", "parent_seq", "kind", "name", F.lit(refused).cast("long").alias("refused"))


@query(
    "sc13_version_gate",
    f"""WITH o AS (SELECT p_partkey AS schema_seq, CASE WHEN p_partkey % 149 = 148 THEN 'explode_table' ELSE {KINDS_SQL}[p_partkey % 19 + 1] END AS kind, 'o' || p_partkey AS object_id FROM part)
    SELECT schema_seq, kind, object_id, CASE WHEN schema_seq < 148 THEN 'admitted' WHEN schema_seq = 148 THEN 'refused' ELSE 'held' END AS outcome FROM o""",
)
def sc13(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 149 == 148, "explode_table").otherwise(F.element_at(F.array(*map(F.lit, catalog.KINDS)), (k % 19 + 1).cast("int")))
    version = F.when(k % 211 == 210, 9).otherwise(1)
    ops = table(spark, d, "part").select(k.alias("schema_seq"), F.to_json(F.struct(version.alias("version"), kind.alias("kind"), F.concat(F.lit("o"), k.cast("string")).alias("object_id"))).alias("op"))
    return catalog.admit(ops)


@query("sc5_catalog_fold", f"WITH {EVENTS} {FOLD.format(where='')}")
def sc5(spark, d):
    return catalog.fold(_events(spark, d))


@query("sc4_op_kinds", f"WITH {EVENTS} SELECT object_kind, action, count(*) AS n, count(DISTINCT object_id) AS objects FROM ev GROUP BY 1, 2")
def sc4(spark, d):
    return _events(spark, d).groupBy("object_kind", "action").agg(F.count("*").alias("n"), F.count_distinct("object_id").alias("objects"))


@query("sc6_catalog_as_of", f"WITH {EVENTS}, f AS ({FOLD.format(where='')}) SELECT object_id, name FROM f WHERE create_seq <= 900 AND (drop_seq IS NULL OR drop_seq > 900)")
def sc6(spark, d):
    return catalog.live_at(catalog.fold(_events(spark, d)), F.lit(900)).select("object_id", "name")


@query("sc7_schema_gate", over_log("SELECT origin, count(*) FILTER (seq % 100 <= 70) AS ready, count(*) FILTER (seq % 100 > 70) AS held FROM log GROUP BY origin"))
def sc7(spark, d):
    ready, held = catalog.gate(change_log(spark, d).withColumn("required_schema_seq", F.col("seq") % 100), 70)
    return ready.groupBy("origin").agg(F.count("*").alias("ready")).join(held.groupBy("origin").agg(F.count("*").alias("held")), "origin")


@query("sc8_terminal_keys", f"WITH {EVENTS} SELECT object_id, arg_max(action, schema_seq) AS action, max(schema_seq) AS schema_seq FROM ev WHERE object_kind = 'key' GROUP BY 1")
def sc8(spark, d):
    return catalog.terminal(_events(spark, d).filter("object_kind = 'key'"), "object_id").select("object_id", "action", "schema_seq")


@query("sc9_terminal_named_ddl", f"WITH {EVENTS} SELECT name, arg_max(action, schema_seq) AS action, max(schema_seq) AS schema_seq FROM ev GROUP BY 1")
def sc9(spark, d):
    return catalog.terminal(_events(spark, d), "name").select("name", "action", "schema_seq")


@query("sc10_cascade_as_query", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))")
def sc10(spark, d):
    regions = table(spark, d, "region").filter("r_regionkey IN (1, 3)")
    nations = table(spark, d, "nation")
    kept = catalog.cascade(nations, regions, "n_regionkey", "r_regionkey", "cascade")
    lost = nations.join(kept, "n_nationkey", "left_anti")
    return catalog.cascade(table(spark, d, "customer"), lost, "c_nationkey", "n_nationkey", "cascade").select("c_custkey", "c_name", "c_nationkey")


@query(
    "sc11_cascade_actions",
    "SELECT n_nationkey, CASE WHEN n_regionkey IN (1, 3) THEN NULL ELSE n_regionkey END AS nulled, CASE WHEN n_regionkey IN (1, 3) THEN 0 ELSE n_regionkey END AS defaulted, CASE n_regionkey WHEN 2 THEN 20 ELSE n_regionkey END AS renamed FROM nation",
)
def sc11(spark, d):
    nations = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    gone = table(spark, d, "region").filter("r_regionkey IN (1, 3)")
    part = lambda df, name: df.select("n_nationkey", F.col("n_regionkey").alias(name))
    nulled = part(catalog.cascade(nations, gone, "n_regionkey", "r_regionkey", "set null"), "nulled")
    defaulted = part(catalog.cascade(nations, gone, "n_regionkey", "r_regionkey", "set default", F.lit(0)), "defaulted")
    renames = spark.createDataFrame([(2, 20)], "old_key int, new_key int")
    return nulled.join(defaulted, "n_nationkey").join(part(catalog.rename_cascade(nations, renames, "n_regionkey"), "renamed"), "n_nationkey")


STATEMENTS = ("CREATE TABLE t (id int)", "ALTER TABLE t ADD COLUMN c int", "ALTER TABLE t ADD COLUMN c int NOT NULL", "ALTER TABLE t ALTER COLUMN c TYPE text", "CREATE FUNCTION f()", "VACUUM", "DROP INDEX i", "CREATE TYPE x", "TRUNCATE t", "create view v as select 1")
VERDICTS = ("replicated", "replicated", "rejected", "rejected", "local", "local", "replicated", "rejected", "rejected", "replicated")


@query("sc12_ddl_admission", "SELECT n_nationkey, [" + ", ".join(f"'{v}'" for v in VERDICTS) + "][n_nationkey % 10 + 1] AS verdict FROM nation")
def sc12(spark, d):
    statement = F.element_at(F.array(*map(F.lit, STATEMENTS)), F.col("n_nationkey") % 10 + 1)
    return table(spark, d, "nation").select("n_nationkey", catalog.admission(statement).alias("verdict"))


@query("sql_merged_view", over_log(f"SELECT b, count(*) AS n, cast(sum(a) AS DOUBLE) AS total FROM ({ROWS.format(log='rowlog')}) WHERE a > 50 GROUP BY b"))
def sql_merged_view(spark, d):
    engine = MergeEngine(spark, row_log(spark, d))
    engine.view("merged_rows")
    return spark.sql("SELECT b, count(*) AS n, cast(sum(a) AS DOUBLE) AS total FROM merged_rows WHERE a > 50 GROUP BY b")


@query(
    "sql_joins_and_windows",
    """SELECT r_name, n_name, customers, rank() OVER (PARTITION BY r_name ORDER BY customers DESC, n_name) AS place FROM (SELECT r_name, n_name, count(c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)""",
)
def sql_joins(spark, d):
    for name in ("region", "nation", "customer"):
        table(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(
        """SELECT r_name, n_name, customers, cast(rank() OVER (PARTITION BY r_name ORDER BY customers DESC, n_name) AS BIGINT) AS place FROM (SELECT r_name, n_name, count(c_custkey) AS customers
        FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
    )


@query("sql_json_and_dates", "SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY 1, 2")
def sql_json(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"))


@query("sql_set_ops", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 20 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0 UNION ALL (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def sql_set_ops(spark, d):
    nation, supplier, customer = (table(spark, d, t) for t in ("nation", "supplier", "customer"))
    first = nation.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("k")).exceptAll(nation.limit(0).select("n_nationkey")).subtract(supplier.filter("s_acctbal < 0").select("s_nationkey"))
    return first.unionAll(customer.select("c_nationkey").intersect(supplier.select("s_nationkey")))
