"""Generated identifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.placing import running

COUNTER_BITS, SLICE_BITS = 33, 47


@F.pandas_udf(T.StringType())
def _uuid7(rows: pd.Series) -> pd.Series:
    import os
    import time

    # one clock for the batch, then one step of the 12-bit counter for each id, borrowing milliseconds from the future
    base = time.time_ns() // 1_000_000 << 12
    out = []
    for i in range(len(rows)):
        ms, step = divmod(base + i, 1 << 12)
        tail = int.from_bytes(os.urandom(8), "big") & (1 << 62) - 1
        value = f"{ms << 80 | 7 << 76 | step << 64 | 2 << 62 | tail:032x}"
        out.append("-".join((value[:8], value[8:12], value[12:16], value[16:20], value[20:])))
    return pd.Series(out, dtype=object)


def with_uuid7(df: DataFrame, name: str) -> DataFrame:
    """Adds a version 7 UUID, increasing within a batch."""
    return df.withColumn(name, _uuid7(F.monotonically_increasing_id()))


def with_gen_id(df: DataFrame, order: str, partition: int, name: str = "id") -> DataFrame:
    """Adds ids of one 30-bit random partition: a 33-bit counter in ``order``.

    The counter is dense over the whole table (see ``placing``).
    """
    base = F.shiftleft(F.lit(partition).cast("long"), COUNTER_BITS)
    return running(df, [order], place="_place").withColumn(name, base + F.col("_place")).drop("_place")


def id_slice(ordinal: Column) -> tuple[Column, Column]:
    """First and last id of a writer's 47-bit slice."""
    base = F.shiftleft(ordinal.cast("long"), SLICE_BITS)
    return base + 1, base + ((1 << SLICE_BITS) - 1)


def default_kind(text: Column) -> Column:
    """Which id function a column default calls, or null."""
    return F.when(text.rlike(r"(?i)^[\s(]*gen_id\s*\(\s*'[^']*'\s*\)[\s)]*$"), "gen_id").when(text.rlike(r"(?i)^[\s(]*uuidv7\s*\(\s*\)[\s)]*$"), "uuidv7")
