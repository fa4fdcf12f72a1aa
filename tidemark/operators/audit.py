"""What a merge discarded, refused or left behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import merge

#: Quarantined records of an origin that do not halt it yet.
DEFAULT_CAP = 128


def conflicts(log: DataFrame, registers: Sequence[str] = ("a", "b"), key: Sequence[str] = ("pk",), group: str = "cell") -> DataFrame:
    """(key, origin, seq, op, winner_origin, winner_seq, kind, cols): what the converged state discards of each record.

    In cell groups a carried register is lost if the stamp that rules it is later: that of its
    cell, or of the insert or delete that established the row. Registers of one record that different
    writers overruled give a row each. In row groups the winning record rules all registers. A
    delete carries nothing and is lost to the base. Losses against a record of the same origin
    are that writer's own history. The stamps of a key are one aggregate that the log joins.
    """
    if group == "cell":
        rules = merge.governing(log, registers, key)
        rules = rules.select(*key, F.col("cl").alias("_cl"), F.col("base").alias("_base"), *(F.coalesce(c, "base").alias(f"_w_{c}") for c in registers))
    else:
        best = F.max(F.struct("cl", "hlc", "origin", "seq"))
        rules = log.groupBy(*key).agg(best.alias("w"))
        winner = F.struct("w.hlc", "w.origin", "w.seq")
        rules = rules.select(*key, F.col("w.cl").alias("_cl"), winner.alias("_base"), *(winner.alias(f"_w_{c}") for c in registers))
    joined = log.join(rules, list(key))
    beaten = lambda w: F.col(w).isNotNull() & (F.col(f"{w}.origin") != F.col("origin")) & ((F.col("cl") < F.col("_cl")) | (F.struct(f"{w}.hlc", f"{w}.origin") > F.struct("hlc", "origin")))
    lost = F.filter(F.array(*(F.when(merge.carries(log, c) & beaten(f"_w_{c}"), F.struct(F.lit(c).alias("col"), F.col(f"_w_{c}").alias("w"))) for c in registers)), lambda x: x.isNotNull())
    removed = F.when(beaten("_base"), F.array(F.col("_base")))
    winners = F.when(F.col("op") == "D", removed).otherwise(F.array_distinct(F.transform("_lost", lambda x: x["w"])))
    rows = joined.withColumn("_lost", lost).withColumn("_w", F.explode(winners))
    cols = F.array_join(F.transform(F.filter("_lost", lambda x: x["w"] == F.col("_w")), lambda x: x["col"]), ",")
    return rows.select(
        *key,
        "origin",
        "seq",
        "op",
        F.col("_w.origin").alias("winner_origin"),
        F.col("_w.seq").alias("winner_seq"),
        kind(F.col("cl"), F.col("_cl")).alias("kind"),
        F.when(F.col("op") == "D", F.lit("")).otherwise(cols).alias("cols"),
    )


def kind(loser_cl: Column, winner_cl: Column) -> Column:
    """superseded: by another generation; concurrent: inside one."""
    return F.when(loser_cl != winner_cl, "superseded").otherwise("concurrent")


def newest(conflict_log: DataFrame, order: str, keep: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``keep`` newest entries; entries of one time in the order of ``ties``."""
    return conflict_log.orderBy(F.col(order).desc(), *ties).limit(keep)


def lost_columns(losers: DataFrame, winners: DataFrame, key: str, columns: Sequence[str], counters: Sequence[str] = ()) -> DataFrame:
    """(key, col, lost, won): registers whose value the winner changed; counters are never lost."""
    joined = losers.alias("l").join(winners.alias("w"), key)
    pairs = F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"l.{c}").cast("string").alias("lost"), F.col(f"w.{c}").cast("string").alias("won")) for c in columns if c not in counters))
    return joined.select(key, F.explode(pairs).alias("p")).filter("NOT (p.lost <=> p.won)").select(key, "p.col", "p.lost", "p.won")


def quarantine(records: DataFrame, reason: Column, most: int = DEFAULT_CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(applied, quarantined, halted): each record is in one of them.

    Invalid records are set aside with their reason, the first ``most`` of each origin. The next
    one halts its origin: it and all later records, valid ones (whose reason is null) included, wait.
    """
    judged = records.withColumn("reason", reason)
    first = Window.partitionBy("origin").orderBy("seq")
    bad = judged.filter("reason IS NOT NULL").withColumn("_n", F.row_number().over(first))
    over = bad.filter(F.col("_n") > most)
    halts = over.groupBy("origin").agg(F.min("seq").alias("_halt")).withColumnRenamed("origin", "_origin")
    valid = judged.filter("reason IS NULL").join(halts, F.col("origin").eqNullSafe(F.col("_origin")), "left")
    waits = F.coalesce(F.col("seq") >= F.col("_halt"), F.lit(False))
    halted = over.drop("_n").unionByName(valid.filter(waits).drop("_origin", "_halt"))
    return valid.filter(~waits).drop("reason", "_origin", "_halt"), bad.filter(F.col("_n") <= most).drop("_n"), halted


def quarantine_stats(quarantined: DataFrame) -> DataFrame:
    """(origin, n, first_seen, attempts)."""
    return quarantined.groupBy("origin").agg(F.count("*").alias("n"), F.min("first_seen").alias("first_seen"), F.max("attempts").alias("attempts"))


def health(heads: DataFrame, tips: DataFrame, quarantined: DataFrame, held: DataFrame) -> DataFrame:
    """One status row for each origin: head, tip, lag and what waits."""
    bad = quarantined.groupBy("origin").agg(F.count("*").alias("quarantined"))
    gated = held.groupBy("origin").agg(F.count("*").alias("held"))
    rows = tips.join(heads.select("origin", "head"), "origin", "left").join(bad, "origin", "left").join(gated, "origin", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("origin", zero("head").alias("head"), "tip", (F.col("tip") - zero("head")).alias("lag"), zero("quarantined").alias("quarantined"), zero("held").alias("held"))


def peers(progress: DataFrame, heads: DataFrame, now: int, silent: int) -> DataFrame:
    """(peer, origin, peer_head, head, behind, ahead, last_seen, alive) of ``progress`` (peer, origin, peer_head, last_seen) against the own ``heads``.

    A peer is alive if any of its reports is younger than ``silent``.
    """
    seen = progress.groupBy("peer").agg(F.max("last_seen").alias("last_seen"))
    known = progress.groupBy("peer", "origin").agg(F.max("peer_head").alias("peer_head"))
    rows = known.join(heads.select("origin", "head"), "origin", "left").join(seen, "peer").withColumn("head", F.coalesce("head", F.lit(0)))
    apart = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    return rows.select("peer", "origin", "peer_head", "head", apart("head", "peer_head").alias("behind"), apart("peer_head", "head").alias("ahead"), "last_seen", (F.col("last_seen") > now - silent).alias("alive"))


def orphans(clocks: DataFrame, rows: DataFrame, tables: DataFrame) -> DataFrame:
    """(tbl, orphans): live clocks without a physical row, of the tables that have any."""
    live = clocks.filter("cl % 2 = 1").groupBy("tbl").agg(F.count("*").alias("clocks"))
    present = rows.groupBy("tbl").agg(F.count("*").alias("present"))
    joined = tables.select("tbl").join(live, "tbl", "left").join(present, "tbl", "left")
    return joined.select("tbl", (F.coalesce("clocks", F.lit(0)) - F.coalesce("present", F.lit(0))).alias("orphans")).filter("orphans > 0")


def outcome(own: Column, applied: Column, gated: Column, invalid: Column, transient: Column) -> Column:
    """What becomes of a delivered changeset, first reason first."""
    return F.when(own | applied, "ignored").when(gated, "schema-gated").when(invalid, "quarantined").when(transient, "transient").otherwise("applied")
