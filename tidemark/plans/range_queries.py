"""Queries on byte ranges: MG11 to MG17, CP7 and CP8."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ranges
from tidemark.sources.changelog import table

from .registry import query

PATCHES = "p AS (SELECT user_id AS pk, event_id * 37 % 200 AS start, event_id * 37 % 200 + 1 + event_id * 13 % 40 AS \"end\", event_id * 7919 % 10007 AS hlc, event_id % 4 + 1 AS origin FROM events)"
WON = PATCHES + """, bd AS (SELECT DISTINCT pk, unnest([start, "end"]) AS pos FROM p), sg AS (SELECT * FROM (SELECT pk, pos, lead(pos) OVER (PARTITION BY pk ORDER BY pos) AS until FROM bd) WHERE until IS NOT NULL),
  won AS (SELECT pk, pos AS start, until AS "end", s.hlc, s.origin FROM (SELECT sg.pk, pos, until, max({'hlc': hlc, 'origin': origin}) AS s FROM sg JOIN p ON p.pk = sg.pk AND p.start <= pos AND p."end" >= until GROUP BY ALL))"""
RUNS = """ru AS (SELECT pk, min(start) AS start, max("end") AS "end", hlc, origin FROM (SELECT *, sum(n) OVER (PARTITION BY pk ORDER BY start ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, CASE WHEN lag("end") OVER w = start AND lag(hlc) OVER w = hlc AND lag(origin) OVER w = origin THEN 0 ELSE 1 END AS n FROM won WINDOW w AS (PARTITION BY pk ORDER BY start))) GROUP BY pk, run, hlc, origin)"""


def _patches(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("pk"), (e * 37 % 200).alias("start"), (e * 37 % 200 + 1 + e * 13 % 40).alias("end"), (e * 7919 % 10007).alias("hlc"), (e % 4 + 1).alias("origin")
    )


@query("mg11_range_overlay", f"WITH {WON}, {RUNS} SELECT pk, start, \"end\", hlc, origin FROM ru")
def mg11(spark, d):
    return ranges.overlay(_patches(spark, d))


@query("mg12_range_at", f"WITH {WON}, {RUNS} SELECT q.pk, q.pos AS \"at\", ru.hlc, ru.origin FROM (SELECT DISTINCT user_id AS pk, user_id * 3 % 230 AS pos FROM events) q LEFT JOIN ru ON ru.pk = q.pk AND start <= q.pos AND q.pos < \"end\"")
def mg12(spark, d):
    points = table(spark, d, "events").select(F.col("user_id").alias("pk"), (F.col("user_id") * 3 % 230).alias("at")).distinct()
    return ranges.at(ranges.overlay(_patches(spark, d)), points)


@query("mg13_range_prune", f"WITH {WON}, {RUNS} SELECT pk, start, \"end\", hlc, origin FROM ru WHERE row(hlc, origin) > row(9000, 2)")
def mg13(spark, d):
    floor = F.struct(F.lit(9000).cast("long").alias("hlc"), F.lit(2).cast("long").alias("origin"))
    return ranges.prune(ranges.overlay(_patches(spark, d)), floor)


@query("mg14_range_clip", f"WITH {WON}, {RUNS} SELECT pk, start, least(\"end\", 100) AS \"end\", hlc, origin FROM ru WHERE start < 100")
def mg14(spark, d):
    return ranges.clip(ranges.overlay(_patches(spark, d)), F.lit(100).cast("long"))


@query("mg15_coalesce_runs", f"WITH {WON}, {RUNS} SELECT pk, count(*) AS runs, cast(sum(\"end\" - start) AS BIGINT) AS bytes FROM ru GROUP BY pk")
def mg15(spark, d):
    return ranges.overlay(_patches(spark, d)).groupBy("pk").agg(F.count("*").alias("runs"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


def _blob_patches(spark, d):
    parts = table(spark, d, "part")
    size = F.col("p_size").cast("long")
    late = parts.select(F.col("p_partkey").alias("pk"), (size % 7).alias("start"), size.alias("hlc"), F.lit(1).cast("long").alias("origin"), F.col("p_brand").cast("binary").alias("bytes"))
    far = parts.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("pk"), (size % 5 + 3).alias("start"), F.lit(25).cast("long").alias("hlc"), F.lit(2).cast("long").alias("origin"), F.lit("<patch>").cast("binary").alias("bytes"))
    return late.unionByName(far)


BLOBS = """r AS (SELECT p_partkey AS pk, p_name, p_size, p_partkey % 3 = 0 AS two, p_brand FROM part WHERE p_partkey % 10 <> 0),
  s AS (SELECT pk, p_name, CASE WHEN two AND 25 < p_size THEN '<patch>' ELSE p_brand END AS b1, CASE WHEN two AND 25 < p_size THEN p_size % 5 + 3 ELSE p_size % 7 END AS o1, CASE WHEN NOT two THEN NULL WHEN 25 < p_size THEN p_brand ELSE '<patch>' END AS b2, CASE WHEN 25 < p_size THEN p_size % 7 ELSE p_size % 5 + 3 END AS o2 FROM r),
  f AS (SELECT pk, rpad(p_name, cast(greatest(len(p_name), o1 + len(b1)) AS INTEGER), chr(0)) AS t, * EXCLUDE (pk) FROM s),
  g AS (SELECT pk, left(t, cast(o1 AS INTEGER)) || b1 || substr(t, cast(o1 + len(b1) + 1 AS INTEGER)) AS t, b2, o2 FROM f),
  h AS (SELECT pk, CASE WHEN b2 IS NULL THEN t ELSE left(rpad(t, cast(greatest(len(t), o2 + len(b2)) AS INTEGER), chr(0)), cast(o2 AS INTEGER)) || b2 || substr(t, cast(o2 + len(b2) + 1 AS INTEGER)) END AS t FROM g)"""


@query("mg16_blob_assemble", f"WITH {BLOBS} SELECT pk, lower(hex(encode(t))) AS blob FROM h")
def mg16(spark, d):
    base = table(spark, d, "part").select(F.col("p_partkey").alias("pk"), F.col("p_name").cast("binary").alias("blob"), (F.col("p_partkey") % 10 != 0).alias("live"))
    return ranges.assemble(base, _blob_patches(spark, d)).select("pk", F.lower(F.hex("blob")).alias("blob"))


@query(
    "mg17_effective_length",
    f"WITH {WON}, {RUNS} SELECT w.pk, greatest(w.length, coalesce(max(ru.\"end\"), 0)) AS length FROM (SELECT DISTINCT user_id AS pk, user_id % 120 AS length, 9900 AS hlc, 1 AS origin FROM events) w LEFT JOIN ru ON ru.pk = w.pk AND row(ru.hlc, ru.origin) > row(w.hlc, w.origin) GROUP BY w.pk, w.length",
)
def mg17(spark, d):
    writes = table(spark, d, "events").select(F.col("user_id").alias("pk")).distinct()
    writes = writes.select("pk", (F.col("pk") % 120).alias("length"), F.lit(9900).cast("long").alias("hlc"), F.lit(1).cast("long").alias("origin"))
    return ranges.effective_lengths(writes, ranges.overlay(_patches(spark, d)))


@query(
    "cp7_blob_diff",
    """WITH s AS (SELECT p_partkey AS pk, p_name AS o, replace(p_name, 'a', 'e') || CASE WHEN p_partkey % 2 = 0 THEN '!!' ELSE '' END AS n FROM part),
    i AS (SELECT pk, i FROM (SELECT *, unnest(range(len(n))) AS i FROM s) WHERE i >= len(o) OR substr(o, cast(i + 1 AS INTEGER), 1) <> substr(n, cast(i + 1 AS INTEGER), 1))
    SELECT pk, min(i) AS start, max(i) + 1 AS "end" FROM (SELECT *, i - row_number() OVER (PARTITION BY pk ORDER BY i) AS run FROM i) GROUP BY pk, run""",
)
def cp7(spark, d):
    new = F.concat(F.replace("p_name", F.lit("a"), F.lit("e")), F.when(F.col("p_partkey") % 2 == 0, "!!").otherwise(""))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("o"), new.alias("n"))
    return ranges.diff(rows, "pk", "o", "n")


ISLANDS = """SELECT pk, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(n) OVER (PARTITION BY pk ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY pk ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM {source})) GROUP BY pk, g"""


@query("cp8_coalesce_ranges", f"WITH {PATCHES} " + ISLANDS.format(source="(SELECT pk, start * 5 AS start, \"end\" * 5 - 3 AS \"end\" FROM p WHERE \"end\" > start + 1)"))
def cp8(spark, d):
    rows = _patches(spark, d).filter("end > start + 1").select("pk", (F.col("start") * 5).alias("start"), (F.col("end") * 5 - 3).alias("end"))
    return ranges.coalesce_ranges(rows, ["pk"])


@query(
    "fn5_blob_write",
    "SELECT p_partkey AS pk, 'P' AS op, p_size % 7 AS start, lower(hex(encode(p_brand))) AS bytes FROM part",
)
def fn5(spark, d):
    """A byte-range write as the patch record it emits."""
    rows = _blob_patches(spark, d).filter("origin = 1")
    return rows.select("pk", F.lit("P").alias("op"), "start", F.lower(F.hex("bytes")).alias("bytes"))
