"""Merging records of many writers into converged rows.

Everything is a pure function of the set of records: a generation (causal length) beats all
earlier ones, inside it the largest stamp wins per row or per cell, counters add up. Each merge
is one aggregate over the key, with partial aggregation before the shuffle.

``key`` names the columns that identify a row, the table among them where a log has several.
A record carries a register if its column ``<register>_present`` says so, and a null that is
carried is a value like any other; logs without that column carry what is not null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import stamp

MOST_LONG = (1 << 63) - 1


def carries(log: DataFrame, register: str) -> Column:
    """Whether a record writes the register."""
    flag = f"{register}_present"
    return F.coalesce(F.col(flag), F.lit(False)) if flag in log.columns else F.col(register).isNotNull()


def once(log: DataFrame) -> DataFrame:
    """Each dot once: redelivered records add nothing."""
    return log.dropDuplicates(["origin", "seq"])


def _order() -> Column:
    return F.struct("cl", "hlc", "origin")


def merge_rows(log: DataFrame, key: Sequence[str] = ("pk",), values: Sequence[str] = ("a", "b")) -> DataFrame:
    """Row groups: the image with the largest (cl, stamp) of each key; even generations are gone."""
    best = F.max_by(F.struct("cl", "hlc", "origin", *values), _order()).alias("w")
    merged = log.groupBy(*key).agg(best).select(*key, "w.cl", "w.hlc", "w.origin", *(f"w.{v}" for v in values))
    return merged.filter("cl % 2 = 1")


def newest_generation(log: DataFrame, key: Sequence[str] = ("pk",)) -> DataFrame:
    """Records of the largest causal length of their key.

    The largest cl comes from an aggregate that combines before the shuffle and a join that
    splits hot keys, so no key's records have to sit in one task.
    """
    newest = log.groupBy(*key).agg(F.max("cl").alias("cl"))
    return log.join(newest, [*key, "cl"], "left_semi")


def cells(log: DataFrame, registers: Sequence[str], key: Sequence[str] = ("pk",)) -> DataFrame:
    """One row for each carried register cell: (key, cl, hlc, origin, col, val)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val"), carries(log, c).alias("there")) for c in registers))
    found = log.select(*key, "cl", "hlc", "origin", F.explode(F.filter(pairs, lambda p: p["there"])).alias("p"))
    return found.select(*key, "cl", "hlc", "origin", "p.col", "p.val")


def merge_cells(log: DataFrame, registers: Sequence[str] = ("a", "b"), key: Sequence[str] = ("pk",)) -> DataFrame:
    """Cell groups: in the newest generation, each carried cell by its largest stamp; live rows only.

    One aggregate: the newest carrier of each cell is kept with its generation, and counts only
    if that is the newest generation of the row.
    """
    carried = [F.max_by(F.struct("cl", F.col(c).alias("val")), F.when(carries(log, c), _order())).alias(f"_w_{c}") for c in registers]
    merged = log.groupBy(*key).agg(F.max("cl").alias("cl"), *carried).filter("cl % 2 = 1")
    return merged.select(*key, "cl", *(F.when(F.col(f"_w_{c}.cl") == F.col("cl"), F.col(f"_w_{c}.val")).alias(c) for c in registers))


def cell_clocks(log: DataFrame, registers: Sequence[str] = ("a", "b"), key: Sequence[str] = ("pk",)) -> DataFrame:
    """(key, cl, col, hlc, origin, val): the winning stamp of each cell of the newest live generation."""
    winner = F.max_by(F.struct("hlc", "origin", "val"), stamp()).alias("w")
    return cells(newest_generation(log, key).filter("cl % 2 = 1"), registers, key).groupBy(*key, "cl", "col").agg(winner).select(*key, "cl", "col", "w.hlc", "w.origin", "w.val")


def as_cell_updates(log: DataFrame) -> DataFrame:
    """Inserts that meet a live row of their own generation act as updates; the others establish it."""
    first = Window.partitionBy("pk", "cl").orderBy("hlc", "origin", "seq")
    opened = F.min(F.when(F.col("op") == "I", F.struct("hlc", "origin", "seq"))).over(Window.partitionBy("pk", "cl"))
    return log.withColumn("acts_as", F.when((F.col("op") == "I") & (F.struct("hlc", "origin", "seq") != opened), "U").otherwise(F.col("op"))).withColumn("turn", F.row_number().over(first).cast("long"))


def merge_counters(log: DataFrame, counter: str = "n", key: Sequence[str] = ("pk",)) -> DataFrame:
    """(key, cl, total, in_range): contributions of the newest generation added up, deletes dominate.

    The sum is taken as a decimal, so a total outside 64 bits is found whatever the order. One
    aggregate: sums by generation, of which the newest is kept.
    """
    total = F.sum(F.col(counter).cast("decimal(38,0)")).alias("total")
    by_generation = log.groupBy(*key, "cl").agg(total)
    summed = by_generation.groupBy(*key).agg(F.max_by(F.struct("cl", "total"), "cl").alias("w")).select(*key, "w.cl", "w.total").filter("cl % 2 = 1")
    fits = F.coalesce(F.col("total").between(F.lit(-MOST_LONG - 1).cast("decimal(38,0)"), F.lit(MOST_LONG).cast("decimal(38,0)")), F.lit(True))
    return summed.withColumn("in_range", fits)


def checked_counters(log: DataFrame, counter: str = "n", key: Sequence[str] = ("pk",)) -> DataFrame:
    """(key, total, outcome): totals that fit 64 bits, and the keys that go to quarantine."""
    merged = merge_counters(log, counter, key)
    return merged.select(*key, F.when(F.col("in_range"), F.col("total").cast("long")).alias("total"), F.when(F.col("in_range"), "merged").otherwise("quarantined").alias("outcome"))


def counter_errors(records: DataFrame) -> DataFrame:
    """Wire rules of counter cells (op, is_counter, format, type_tag): the reason for rejection or null."""
    delta = F.col("format") == 2
    reason = (
        F.when(delta & ~F.col("is_counter"), "delta on a register")
        .when(delta & (F.col("type_tag") != 1), "delta is not an integer")
        .when(F.col("is_counter") & (F.col("op") == "U") & ~delta, "counter update without delta")
        .when(F.col("is_counter") & (F.col("op") == "I") & delta, "counter image as delta")
    )
    return records.withColumn("reason", reason)


def with_adopted(log: DataFrame, adopted: DataFrame) -> DataFrame:
    """The log and adopted physical rows as contributions of the generation they are found in."""
    return log.unionByName(adopted, allowMissingColumns=True)


def collapse(clocks: DataFrame, n_columns: int) -> DataFrame:
    """(pk, cl, covers_all): whether one update at one stamp covers every register of the row."""
    per_stamp = clocks.groupBy("pk", "cl", "hlc", "origin").agg(F.count_distinct("col").alias("covered"))
    return per_stamp.groupBy("pk", "cl").agg(F.max(F.col("covered") == n_columns).alias("covers_all"))


def effective(range_stamp: Column, cell_stamp: Column, base: Column) -> Column:
    """The stamp that governs a byte: of its range, else of its cell, else of the row."""
    return F.coalesce(range_stamp, cell_stamp, base)


def pending_updates(log: DataFrame, key: Sequence[str] = ("pk",)) -> DataFrame:
    """Winning row updates whose generation has no insert in sight: they wait."""
    winners = log.groupBy(*key).agg(F.max_by(F.struct("cl", "op", "origin", "seq"), _order()).alias("w")).select(*key, "w.cl", "w.op", "w.origin", "w.seq")
    inserts = log.filter("op = 'I'").select(*key, "cl")
    return winners.filter("op = 'U'").join(inserts, [*key, "cl"], "left_anti")


def live_cells(cell_rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells of known columns: dropped columns are ignored, unknown ones held back (outcome)."""
    joined = cell_rows.join(columns.select("col", "dropped"), "col", "left")
    return joined.withColumn("outcome", F.when(F.col("dropped").isNull(), "held").when(F.col("dropped"), "ignored").otherwise("applied")).drop("dropped")


def repairs(current: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows that a replica must still write: in the merged state, not in its own."""
    return merged.exceptAll(current.select(*merged.columns))


def whole_changesets(log: DataFrame) -> DataFrame:
    """Records of changesets that are complete (their ``parts`` records are all there)."""
    complete = log.groupBy("origin", "seq").agg(F.count("*").alias("n"), F.max("parts").alias("parts")).filter("n = parts").select("origin", "seq")
    return log.join(complete, ["origin", "seq"], "left_semi")


def governing(log: DataFrame, registers: Sequence[str] = ("a", "b"), key: Sequence[str] = ("pk",)) -> DataFrame:
    """(key, cl, base, a struct for each register): the stamps (hlc, origin, seq) that rule the newest generation of each key.

    The base is the latest insert or delete. A register is ruled by the latest record that carries
    it, null where only the base speaks for it. One aggregate.
    """
    order = F.struct("cl", "hlc", "origin", "seq")
    rules = log.groupBy(*key).agg(F.max("cl").alias("cl"), F.max(F.when(F.col("op").isin("I", "D"), order)).alias("base"), *(F.max(F.when(carries(log, c) & (F.col("op") != "D"), order)).alias(c) for c in registers))
    return rules.select(*key, "cl", *(F.when(F.col(f"{c}.cl") == F.col("cl"), F.struct(f"{c}.hlc", f"{c}.origin", f"{c}.seq")).alias(c) for c in ("base", *registers)))


def row_states(log: DataFrame, registers: Sequence[str] = ("a", "b"), key: Sequence[str] = ("pk",)) -> DataFrame:
    """(key, cl, base_hlc, base_origin, cells): clock state of each key; a new generation clears cells.

    ``cells`` has (col, hlc, origin) of the registers whose stamp is later than the base.
    """
    rules = governing(log, registers, key)
    later = lambda c: F.col(c).isNotNull() & (F.col("base").isNull() | (F.struct(f"{c}.hlc", f"{c}.origin") > F.struct("base.hlc", "base.origin")))
    found = F.array(*(F.when(later(c), F.struct(F.lit(c).alias("col"), F.col(f"{c}.hlc"), F.col(f"{c}.origin"))) for c in sorted(registers)))
    return rules.select(*key, "cl", F.col("base.hlc").alias("base_hlc"), F.col("base.origin").alias("base_origin"), F.filter(found, lambda c: c.isNotNull()).alias("cells"))


def upsert(current: DataFrame, changes: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """``current`` with rows of ``changes`` written over it, by a full outer join."""
    fresh = changes.select(F.col(key).alias("_key"), *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_new"))
    joined = current.join(fresh, current[key] == fresh["_key"], "full_outer")
    return joined.select(F.coalesce(key, "_key").alias(key), *(F.when(F.col("_new"), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values))
