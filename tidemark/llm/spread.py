"""Joins that no hot key can gather in one task, and row filters that shuffle no texts.

* A lookup joins rows with a table that has one row for each key and says how many rows have
  it. A table of at most ``MOST_HOT`` rows is broadcast. Of a larger one, the keys of more than
  ``total / MOST_HOT`` rows are, which are at most ``MOST_HOT`` many; all others meet in a
  shuffle without a hot key.
* A bitmap is a Bloom filter with one hash over ``SLOTS`` words, a table of at most that many
  rows whatever it was made of. Rows that miss it need no join at all; rows that hit it go on
  to an exact one. When a corpus is so large that the bitmap fills up, it lets more rows through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: Keys that are broadcast at most, and rows that a key needs to be one of them at least.
MOST_HOT, LEAST_HOT = 100_000, 256
#: Words of 64 bits in a bitmap.
SLOTS = 1 << 20


def fresh(columns: list[str], *names: str) -> tuple[str, ...]:
    """Names like ``names`` that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return tuple(found)


def quoted(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def lookup(rows: DataFrame, table: DataFrame, key: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` on ``key``; ``weight`` is the number of rows that a row of ``table`` meets.

    ``total`` is the number of all rows, or more, and ``table`` has no more rows than that.
    """
    if total <= MOST_HOT:
        return rows.join(F.broadcast(table), key, how)
    table = materialize(table, "lookup")
    if table.count() <= MOST_HOT:
        return rows.join(F.broadcast(table), key, how)
    limit = max(LEAST_HOT, total // MOST_HOT)
    hot, cold = table.filter(F.col(weight) > limit), table.filter(F.col(weight) <= limit)
    met = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key, how)
    return met.unionByName(rest)


def _place(hashed: Column) -> tuple[Column, Column]:
    return F.shiftright(hashed, 6).bitwiseAND(F.lit(SLOTS - 1)), hashed.bitwiseAND(F.lit(63)).cast("int")


def bitmap(rows: DataFrame, hashed: Column) -> DataFrame:
    """(slot, word) of the 64-bit hashes of ``rows``: ``SLOTS`` rows at most."""
    slot, bit = _place(hashed)
    return materialize(rows.select(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("word")).groupBy("slot").agg(F.bit_or("word").alias("word")), "bitmap")


def flagged(rows: DataFrame, hashed: Column, words: DataFrame, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: whether the hash may be in the bitmap."""
    slot_name, word_name = fresh(rows.columns, "_slot", "_word")
    slot, bit = _place(hashed)
    joined = rows.join(F.broadcast(words.select(F.col("slot").alias(slot_name), F.col("word").alias(word_name))), slot == F.col(slot_name), "left")
    hit = F.call_function("shiftright", F.coalesce(F.col(word_name), F.lit(0).cast("long")), bit).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn(name, hit).drop(slot_name, word_name)


def orderable(df: DataFrame) -> list[str]:
    """The columns of ``df`` that rows can be sorted by."""
    return [field.name for field in df.schema if not any(t in field.dataType.simpleString() for t in ("map<", "variant"))]


def without(df: DataFrame, key: Column, mark: Column, found: DataFrame, first: str) -> DataFrame:
    """``df`` without the rows that ``found`` (k, mark, stays, repeats) names by key and mark.

    Of rows that stay, one does: the first by the column ``first``, then by the others. Keys are
    compared with nulls as equal. Only rows that hit the bitmap of ``found`` are shuffled.
    """
    found = materialize(found.select(F.col("k").alias("_k"), F.col("mark").alias("_mark"), "stays", "repeats"), "found")
    total = found.agg(F.coalesce(F.sum("repeats"), F.lit(0))).first()[0]
    mine, name, hit = fresh(df.columns, "_mine", "_its", "_hit")
    named = lambda k, m: F.xxhash64(k.isNull(), k, m)
    packed = df.select(F.struct(*(quoted(c) for c in df.columns)).alias(mine), key.alias(name), mark.alias(hit))
    marked = flagged(packed, named(F.col(name), F.col(hit)), bitmap(found, named(F.col("_k"), F.col("_mark"))), "_may")
    passed = marked.filter("NOT _may").select(f"{mine}.*")
    # a null key joins as a flag and a value of its type
    blank = lambda c: F.struct(c.isNull().alias("none"), F.coalesce(c.cast("string"), F.lit("")).alias("value"))
    left = marked.filter("_may").select(mine, blank(F.col(name)).alias("_id"), F.col(hit).alias("_mark"))
    right = found.select(blank(F.col("_k")).alias("_id"), "_mark", "stays", "repeats")
    joined = lookup(left, right, ["_id", "_mark"], "repeats", total, "left")
    free = joined.filter("stays IS NULL OR (stays AND repeats = 1)").select(f"{mine}.*")
    order = F.struct(*(F.col(mine)[c] for c in [first, *orderable(df)]))
    one = joined.filter("stays AND repeats > 1").groupBy("_id", "_mark").agg(F.min_by(mine, order).alias(mine)).select(f"{mine}.*")
    return passed.unionByName(free).unionByName(one)
