"""What a replica has: contiguous heads, gaps, and plans to fetch what is missing.

Sets of sequence numbers are rows (origin, lo, hi) of inclusive ranges. What follows a writer's
log in order is a sweep over ranges of the sort (see ``placing``), so one writer takes many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.workspace import materialize

from .placing import running, scan
from .ranges import coalesce_ranges


def ranges_of(dots: DataFrame, key: str = "origin", seq: str = "seq") -> DataFrame:
    """(key, lo, hi): the distinct seqs of each origin as ranges."""
    # places go up by one with every row, so seq less place is the same all along a range
    rows = running(dots.select(key, seq).distinct(), [key, seq], place="_place").withColumn("_island", F.col(seq) - F.col("_place"))
    return rows.groupBy(key, "_island").agg(F.min(seq).alias("lo"), F.max(seq).alias("hi")).drop("_island")


def heads(held: DataFrame, key: str = "origin") -> DataFrame:
    """(key, head, tip): the end of the range that starts at 1 (else 0), and the last seq at all; from ranges."""
    return held.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("lo") == 1, F.col("hi"))), F.lit(0)).alias("head"), F.max("hi").alias("tip"))


def unseen(dots: DataFrame, applied: DataFrame, own: int | None = None) -> DataFrame:
    """Dots that are neither applied yet nor one's own."""
    fresh = dots.dropDuplicates(["origin", "seq"]).join(applied.select("origin", "seq"), ["origin", "seq"], "left_anti")
    return fresh if own is None else fresh.filter(F.col("origin") != own)


def missing(held: DataFrame, tips: DataFrame, key: str = "origin") -> DataFrame:
    """(key, lo, hi): what is missing of 1 to the tip of each origin; ``tips`` (key, tip).

    In front of each range, and of what lies behind the tip, is a gap if the range before ends earlier.
    """
    ends = tips.select(key, (F.col("tip") + 1).alias("lo"), F.lit(None).cast("long").alias("hi"))
    rows = scan(held.select(key, "lo", "hi").unionByName(ends), [key], ["lo", F.col("hi").asc_nulls_first()], maxes={"reach": "hi"})
    gaps = rows.select(key, (F.coalesce("reach", F.lit(0)) + 1).alias("lo"), (F.col("lo") - 1).alias("hi")).join(tips, key)
    return gaps.filter("lo <= hi AND lo <= tip").select(key, "lo", F.least("hi", "tip").alias("hi"))


def retention_heads(held: DataFrame, own: int) -> DataFrame:
    """Contiguous heads of the other origins."""
    return heads(held.filter(F.col("origin") != own)).select("origin", "head")


def merge_tips(*tips: DataFrame) -> DataFrame:
    """(origin, tip): the largest tip anyone knows."""
    every = tips[0]
    for more in tips[1:]:
        every = every.unionByName(more)
    return every.groupBy("origin").agg(F.max("tip").alias("tip"))


def meets(ranges: DataFrame, others: DataFrame, key: str = "origin") -> DataFrame:
    """``ranges`` (key, lo, hi, …) with met: whether one of ``others`` (key, lo, hi) overlaps it.

    One does if, of those that begin at or before the end of the range, the one that reaches farthest reaches its start.
    """
    rest = [c for c in ranges.columns if c not in (key, "lo", "hi")]
    mine = ranges.select(key, F.col("hi").alias("_at"), F.lit(1).alias("_kind"), F.struct("lo", "hi", *rest).alias("_row"), F.lit(None).cast("long").alias("_reach"))
    theirs = others.select(key, F.col("lo").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), F.col("hi").alias("_reach"))
    swept = scan(mine.unionByName(theirs), [key], ["_at", "_kind"], maxes={"_far": "_reach"}).filter("_kind = 1")
    return swept.select(key, "_row.*", F.coalesce(F.col("_far") >= F.col("_row.lo"), F.lit(False)).alias("met"))


def plan(held: DataFrame, tips: DataFrame, coverage: DataFrame | None, most: int, own: int | None = None) -> DataFrame:
    """(origin, lo, hi, serveable, place): missing ranges of the other origins, in order, ``most`` of those to fetch now and as many that no source covers.

    A range that a source covers in part is fetched; one that none does is only probed for. Without a
    ``coverage`` nothing is known to be out of reach, so all of them are fetched. Places count within each kind.
    """
    wanted = missing(held, tips)
    if own is not None:
        wanted = wanted.filter(F.col("origin") != own)
    if coverage is None:
        judged = wanted.withColumn("serveable", F.lit(True))
    else:
        judged = meets(wanted, coverage.select("origin", "lo", "hi")).withColumnRenamed("met", "serveable")
    judged = materialize(judged, "plan")
    taken = [judged.filter(kind).orderBy("origin", "lo").limit(most) for kind in (F.col("serveable"), ~F.col("serveable"))]
    # a plan is a request, of twice ``most`` rows
    return taken[0].unionByName(taken[1]).withColumn("place", F.row_number().over(Window.partitionBy("serveable").orderBy("origin", "lo")).cast("long"))


def merge_intervals(intervals: DataFrame, key: Sequence[str] = ("origin",)) -> DataFrame:
    """Inclusive intervals, overlapping and adjacent ones merged."""
    half = intervals.select(*key, F.col("lo").alias("start"), (F.col("hi") + 1).alias("end"))
    return coalesce_ranges(half, key).select(*key, F.col("start").alias("lo"), (F.col("end") - 1).alias("hi"))


def fill(wanted: DataFrame, sources: Sequence[DataFrame]) -> DataFrame:
    """(origin, seq, source): which source, in order of preference, delivers each wanted seq; null if none."""
    offers = None
    for rank, source in enumerate(sources):
        rows = source.select("origin", "seq", F.lit(rank).alias("rank"))
        offers = rows if offers is None else offers.unionByName(rows)
    best = offers.groupBy("origin", "seq").agg(F.min("rank").alias("source"))
    return wanted.join(best, ["origin", "seq"], "left")


def backoff(failures: Column, base_ms: int, most_ms: int) -> Column:
    """Milliseconds to the next round: doubled for each failure in a row, up to a most."""
    return F.least(F.lit(base_ms).cast("long") * F.pow(F.lit(2), F.least(failures, F.lit(30))).cast("long"), F.lit(most_ms).cast("long"))


def serve(records: DataFrame, wanted: DataFrame, most_records: int, most_bytes: int) -> DataFrame:
    """Records of the wanted ranges in order, per origin until a cap on records or bytes is met; the first is always served."""
    points = records.withColumns({"lo": F.col("seq"), "hi": F.col("seq")})
    inside = meets(points, wanted).filter("met").select(*records.columns, F.lit(1).alias("_one"))
    sums = scan(inside, ["origin"], ["seq"], sums={"_n": "_one", "_ahead": "bytes"})
    within = (F.col("_n") < most_records) & (F.col("_ahead") + F.col("bytes") <= most_bytes)
    return sums.filter((F.col("_n") == 0) | within).drop("_n", "_ahead", "_one")


def all_peers_applied(peers: DataFrame, heads_: DataFrame) -> DataFrame:
    """(origin, applied): whether every known peer has got to the head; false without peers."""
    joined = heads_.join(peers.select("origin", "peer", "peer_head"), "origin", "left")
    return joined.groupBy("origin").agg((F.count("peer") > 0).alias("some"), F.coalesce(F.min("peer_head") >= F.max("head"), F.lit(False)).alias("past")).select("origin", (F.col("some") & F.col("past")).alias("applied"))


def discover(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tips and coverage from a listing of sealed files (origin, lo, hi)."""
    return files.groupBy("origin").agg(F.max("hi").alias("tip")), merge_intervals(files)


def horizon(progress: DataFrame, members: DataFrame, origins: DataFrame) -> DataFrame:
    """(horizon): the smallest clock any member has of any origin, null while one is missing. A specified rule that the merge does not depend on."""
    cells = members.count() * origins.count()
    known = progress.join(members, "member", "left_semi").join(origins, "origin", "left_semi").groupBy("member", "origin").agg(F.max("last_hlc").alias("last_hlc"))
    return known.agg(F.when(F.count("*") == cells, F.min("last_hlc")).alias("horizon"))


def prunable(rows: DataFrame, horizon_ms: Column, now_ms: int, keep_ms: int, margin_ms: int) -> DataFrame:
    """Tombstones below both the horizon less ``keep_ms`` and now less ``margin_ms``."""
    wall = F.shiftright("hlc", 16)
    return rows.filter((F.col("cl") % 2 == 0) & (wall < horizon_ms - keep_ms) & (wall < now_ms - margin_ms))
