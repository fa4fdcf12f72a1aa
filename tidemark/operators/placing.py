"""Places, prefix sums and sweeps over a whole table, without putting it or a group of it into one task.

Rows are ranged and sorted by the order and written once, so that every later step sees the
same rows in the same ranges. What lies before a range comes from one row a range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.workspace import materialize

#: Rows that one task may sort, when they are known to be no more.
FEW = 1 << 12
_INSIDE = (1 << 33) - 1


def running(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, str] | None = None, place: str = "place", ranges: int | None = None, most: int | None = None) -> DataFrame:
    """``df`` with ``place`` from 1 on, and under each name of ``sums`` the sum of its column over all rows before.

    Rows that are equal in ``order`` stand in some order, the same one for every reader.
    ``ranges``: how many ranges to sort in, by default as many as a shuffle has partitions.
    ``most``: a bound of the number of rows, if there is one; up to ``FEW`` are sorted by one task.
    """
    sums = dict(sums or {})
    if most is not None and most <= FEW:
        by = Window.orderBy(*order)
        before = by.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({place: F.row_number().over(by).cast("long")} | {name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in sums.items()})
    dealt = df.repartitionByRange(*order) if ranges is None else df.repartitionByRange(ranges, *order)
    ranged = dealt.sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    rows = materialize(ranged, "placed").withColumns({"_p": F.shiftright("_m", 33), "_r": F.col("_m").bitwiseAND(F.lit(_INSIDE))})
    totals = rows.groupBy("_p").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_t_{name}") for name, c in sums.items()))
    # one row for each range of the sort
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = totals.select("_p", ahead("_n").alias("_n"), *(ahead(f"_t_{name}").alias(f"_t_{name}") for name in sums))
    placed = rows.join(F.broadcast(offsets), "_p")
    made = {place: F.col("_n") + F.col("_r") + 1}
    if sums:
        inside = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
        made |= {name: F.col(f"_t_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()}
    return placed.withColumns(made).drop("_m", "_p", "_r", "_n", *(f"_t_{name}" for name in sums))


def scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    lags: Mapping[str, str] | None = None,
    maxes: Mapping[str, str] | None = None,
    sums: Mapping[str, str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """``df`` with what the rows before it in its group say: a window by ``group`` whose groups may span many tasks.

    Under each name of ``lags`` the column of the row before, of ``maxes`` the largest value before,
    of ``sums`` the sum before. A group that goes on from an earlier range takes over what the
    ranges before it found for that group; only the last group of a range can go on.
    """
    lags, maxes, sums = dict(lags or {}), dict(maxes or {}), dict(sums or {})
    by = [*group, *order]
    dealt = df.repartitionByRange(*by) if ranges is None else df.repartitionByRange(ranges, *by)
    rows = dealt.sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    rows = materialize(rows, "scanned").withColumns({"_p": F.shiftright("_m", 33), "_g": F.struct(*group)})

    held = [F.max_by(F.struct(*(F.col(c).alias(n) for n, c in lags.items()), F.lit(1).alias("_")), "_m").alias("last")]
    held += [F.max(c).alias(f"max_{n}") for n, c in maxes.items()] + [F.sum(c).alias(f"sum_{n}") for n, c in sums.items()]
    kept = ["last", *(f"max_{n}" for n in maxes), *(f"sum_{n}" for n in sums)]
    parts = rows.groupBy("_p", "_g").agg(F.max("_m").alias("_m"), *held)
    parts = parts.groupBy("_p").agg(F.min_by("_g", "_m").alias("begins"), F.max_by(F.struct("_g", *kept), "_m").alias("e")).select("_p", "begins", F.col("e._g").alias("ends"), *(f"e.{n}" for n in kept))
    # one row for each range of the sort; ranges that end in one group follow each other
    so_far = Window.partitionBy("ends").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = [F.col("last")] + [F.max(f"max_{n}").over(so_far).alias(f"max_{n}") for n in maxes] + [F.sum(f"sum_{n}").over(so_far).alias(f"sum_{n}") for n in sums]
    carry = parts.select("_p", "begins", "ends", F.struct(*grown).alias("c"))
    one = Window.orderBy("_p")
    carry = carry.select("_p", F.when(F.lag("ends").over(one) == F.col("begins"), F.lag("c").over(one)).alias("c"), "begins")
    joined = rows.join(F.broadcast(carry.filter("c IS NOT NULL").select(F.col("_p").alias("_q"), "begins", "c")), (F.col("_p") == F.col("_q")) & (F.col("_g") == F.col("begins")), "left")

    inside = Window.partitionBy("_p", "_g").orderBy("_m")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    begun = F.row_number().over(inside) > 1
    made = {n: F.when(begun, F.lag(c).over(inside)).otherwise(F.col(f"c.last.{n}")) for n, c in lags.items()}
    made |= {n: F.greatest(F.max(c).over(before), F.col(f"c.max_{n}")) for n, c in maxes.items()}
    made |= {n: F.coalesce(F.sum(c).over(before), F.lit(0)) + F.coalesce(F.col(f"c.sum_{n}"), F.lit(0)) for n, c in sums.items()}
    return joined.withColumns(made).drop("_m", "_p", "_q", "_g", "begins", "c")
