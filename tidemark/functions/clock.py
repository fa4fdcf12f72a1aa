"""Hybrid logical clocks, stamps and causal lengths as column expressions.

A clock is (wall milliseconds, logical); packed, it is ``wall * 65536 + logical``, which keeps
the order. A stamp is (packed clock, origin), ordered field by field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the logical part, and the largest wall clock (47 bits).
LOGICAL_BITS = 16
MOST_WALL = (1 << 47) - 1
MOST_LOGICAL = (1 << LOGICAL_BITS) - 1


def pack(wall: Column, logical: Column, checked: bool = False) -> Column:
    """The packed clock; ``checked`` raises for parts out of range."""
    packed = (F.shiftleft(wall.cast("long"), LOGICAL_BITS) + logical).cast("long")
    if not checked:
        return packed
    fits = wall.between(0, MOST_WALL) & logical.between(0, MOST_LOGICAL)
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("clock out of range")).cast("long"))


def unpack(packed: Column) -> tuple[Column, Column]:
    return F.shiftright(packed, LOGICAL_BITS), packed.bitwiseAND(F.lit(MOST_LOGICAL))


def less(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.struct(a[0].alias("w"), a[1].alias("l")) < F.struct(b[0].alias("w"), b[1].alias("l"))


def equal(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return (a[0] == b[0]) & (a[1] == b[1])


def forward(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The later of two clocks, as a struct."""
    return F.greatest(F.struct(a[0].alias("wall"), a[1].alias("logical")), F.struct(b[0].alias("wall"), b[1].alias("logical")))


def stamp(hlc: str | Column = "hlc", origin: str | Column = "origin") -> Column:
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(column(hlc).alias("hlc"), column(origin).alias("origin"))


def dominates(a: Column, b: Column) -> Column:
    """Strictly later in the total order of stamps; nothing dominates a missing stamp's absence."""
    return F.coalesce(a > b, a.isNotNull() & b.isNull())


def stamp_hlc(df: DataFrame, origin: str, order: str, wall: str) -> DataFrame:
    """Adds hlc_wall and hlc_logical as a writer stamps its commits one after another.

    The wall part is the running maximum; commits at the same maximum count up from 0.
    """
    so_far = Window.partitionBy(origin).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("hlc_wall", F.max(wall).over(so_far))
    return rows.withColumn("hlc_logical", (F.row_number().over(Window.partitionBy(origin, "hlc_wall").orderBy(order)) - 1).cast("long"))


def observed(df: DataFrame, node: str, order: str, hlc: str) -> DataFrame:
    """Adds last_hlc: the clock of ``node`` after observing each record."""
    so_far = Window.partitionBy(node).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("last_hlc", F.max(hlc).over(so_far))


def allocate_seq(df: DataFrame, origin: str, *order: str) -> DataFrame:
    """Adds a dense seq from 1 for each origin."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(origin).orderBy(*order)).cast("long"))


def admit(hlc: Column, now_ms: Column, bound_ms: int = 30_000) -> Column:
    """The clock to observe for a remote stamp: no later than ``now + bound``, logical 0 when capped."""
    wall, _ = unpack(hlc)
    return F.when(wall > now_ms + bound_ms, pack(now_ms + bound_ms, F.lit(0))).otherwise(hlc)


def satisfied(needs: DataFrame, have: DataFrame, chain: str = "chain") -> DataFrame:
    """``needs`` (…, chain, need) with satisfied: whether ``have`` (chain, have) has got that far."""
    joined = needs.join(have, chain, "left")
    return joined.withColumn("satisfied", F.coalesce(F.col("have"), F.lit(0)) >= F.col("need")).drop("have")


def next_live(cl: Column) -> Column:
    return F.when(cl % 2 == 0, cl + 1).otherwise(cl)


def next_tomb(cl: Column) -> Column:
    return F.when(cl % 2 == 1, cl + 1).otherwise(cl)


def liveness(cl: Column) -> Column:
    return F.when(cl == 0, "never").when(cl % 2 == 1, "live").otherwise("tombstone")
