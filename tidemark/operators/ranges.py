"""Byte ranges: overlays of patches by stamp, coalescing, diffs and assembly.

Ranges are half-open, [start, end). The converged overlay of a set of patches is taken per
elementary segment: between two neighbouring boundaries of a key every byte has the same
covering patches, and the largest stamp of those wins. Segments are numbered within their key,
and a patch is cut into aligned runs of 1, 2, 4, … segments, about two for each power. A segment
asks the one run of each power that holds it. Both meet in equal (key, run), so a key with
very many patches is spread over tasks, and the rows grow with the logarithm of the patches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.workspace import materialize

from .placing import running, scan


def coalesce_ranges(df: DataFrame, key: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and adjacent ranges of a key merged."""
    key = list(key)
    rows = scan(df.select(*key, start, end), key, [start, end], maxes={"_reach": end})
    rows = rows.withColumn("_new", F.coalesce((F.col(start) > F.col("_reach")).cast("int"), F.lit(1)))
    # of equal ranges, the one that begins an island comes before those that go on with it, whatever order the second sort meets them in
    rows = running(rows, [*key, start, end, F.col("_new").desc()], sums={"_ahead": "_new"}, place="_place").withColumn("_island", F.col("_ahead") + F.col("_new"))
    return rows.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def _runs(low: Column, high: Column) -> Column:
    """The aligned runs (power, number) that make up the segments from ``low`` up to ``high``."""

    def at(power: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1).cast("long"), power)
        a, b = F.floor((low + step - 1) / step).cast("long"), F.floor(high / step).cast("long")
        run = lambda n, there: F.when((a < b) & there, F.struct(power.cast("int").alias("power"), n.alias("run")))
        return F.array(run(a, a % 2 == 1), run(b - 1, b % 2 == 1))

    powers = F.sequence(F.lit(0), F.ceil(F.log2(high - low + 1)).cast("int") + 1)
    return F.filter(F.flatten(F.transform(powers, at)), lambda r: r.isNotNull())


def overlay(patches: DataFrame, key: Sequence[str] = ("pk",), baseline: Column | None = None) -> DataFrame:
    """(key, start, end, hlc, origin): the winning stamp of each byte, equal neighbours merged.

    ``baseline``: bytes are won only by stamps above it.
    """
    key = list(key)
    bounds = patches.select(*key, F.explode(F.array("start", "end")).alias("at")).distinct()
    placed = materialize(scan(bounds.withColumn("_one", F.lit(1)), key, [F.col("at").desc()], lags={"until": "at"}, sums={"left": "_one"}), "bounds")
    counted = placed.groupBy(*key).agg(F.count("*").alias("bounds"))
    numbered = placed.join(counted, key).withColumn("number", F.col("bounds") - F.col("left") - 1)
    # patches by the numbers of their ends, as aligned runs of segments
    ends = [numbered.select(*key, F.col("at").alias(end), F.col("number").alias(f"_{end}")) for end in ("start", "end")]
    cut = patches.join(ends[0], [*key, "start"]).join(ends[1], [*key, "end"]).filter(F.col("_start") < F.col("_end"))
    cut = cut.select(*key, F.explode(_runs(F.col("_start"), F.col("_end"))).alias("r"), F.struct("hlc", "origin").alias("s"))
    best = cut.groupBy(*key, "r.power", "r.run").agg(F.max("s").alias("s"))
    powers = F.sequence(F.lit(0), F.ceil(F.log2("bounds")).cast("int") + 1)
    asked = F.transform(powers, lambda p: F.struct(p.alias("power"), F.call_function("shiftright", F.col("number"), p).alias("run")))
    segments = numbered.filter("until IS NOT NULL").select(*key, "at", "until", F.explode(asked).alias("r")).select(*key, "at", "until", "r.power", "r.run")
    won = segments.join(best, [*key, "power", "run"]).groupBy(*key, "at", "until").agg(F.max("s").alias("s"))
    if baseline is not None:
        won = won.filter(F.col("s") > baseline)
    return coalesce_runs(won.select(*key, F.col("at").alias("start"), F.col("until").alias("end"), "s.hlc", "s.origin"), key)


def coalesce_runs(segments: DataFrame, key: Sequence[str] = ("pk",)) -> DataFrame:
    """Neighbouring segments of equal stamp merged."""
    key = list(key)
    rows = scan(segments, key, ["start"], lags={"_end": "end", "_hlc": "hlc", "_origin": "origin"})
    same = (F.col("_end") == F.col("start")) & (F.col("_hlc") == F.col("hlc")) & (F.col("_origin") == F.col("origin"))
    rows = rows.withColumn("_new", F.when(same, 0).otherwise(1))
    rows = running(rows, [*key, "start"], sums={"_ahead": "_new"}, place="_place").withColumn("_run", F.col("_ahead") + F.col("_new"))
    return rows.groupBy(*key, "_run", "hlc", "origin").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def at(segments: DataFrame, points: DataFrame, key: Sequence[str] = ("pk",)) -> DataFrame:
    """(key, at, hlc, origin): the stamp at each point, null where nothing covers it; segments do not overlap."""
    key = list(key)
    nothing = F.lit(None)
    begun = segments.select(*key, F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("start", "end", "hlc", "origin").alias("s"))
    asked = points.select(*key, "at").distinct().select(*key, "at", F.lit(1).alias("kind"), nothing.cast(begun.schema["s"].dataType).alias("s"))
    swept = scan(begun.unionByName(asked), key, ["at", "kind"], maxes={"last": "s"}).filter("kind = 1")
    covers = F.col("last.end") > F.col("at")
    return swept.select(*key, "at", *(F.when(covers, F.col(f"last.{c}")).alias(c) for c in ("hlc", "origin")))


def prune(segments: DataFrame, floor: Column) -> DataFrame:
    """Segments whose stamp strictly dominates ``floor``."""
    return segments.filter(F.struct("hlc", "origin") > floor)


def clip(segments: DataFrame, most: Column) -> DataFrame:
    """Segments cut at ``most``."""
    return segments.filter(F.col("start") < most).withColumn("end", F.least(F.col("end"), most))


def diff(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, start, end): runs of bytes of ``new`` that differ from ``old``; what lies behind the end of ``old`` is one run.

    A shorter ``new`` has no run for the bytes it lacks. Values are compared as arrays, so a value gives as many rows as it has runs.
    """

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def runs(before: pd.Series, after: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(before, after):
            x, y = np.frombuffer(bytes(a or b""), np.uint8), np.frombuffer(bytes(b or b""), np.uint8)
            apart = np.ones(len(y) + 2, bool)
            shared = min(len(x), len(y))
            apart[0] = apart[-1] = False
            apart[1 : shared + 1] = x[:shared] != y[:shared]
            edges = np.flatnonzero(apart[1:] != apart[:-1])
            out.append([{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())])
        return pd.Series(out)

    found = df.select(key, F.explode(runs(F.col(old).cast("binary"), F.col(new).cast("binary"))).alias("r"))
    return found.select(key, "r.start", "r.end")


def assemble(base: DataFrame, patches: DataFrame, key: str = "pk") -> DataFrame:
    """(key, blob): ``base`` (key, blob, live) with the winning bytes of ``patches`` (key, start, hlc, origin, bytes) written in.

    Gaps behind the end are filled with zeros; patches of rows that are gone are dropped; rows
    without a base start out empty.
    """
    grouped = patches.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("hlc", "origin", "start", "bytes"))).alias("patches"))
    joined = base.join(grouped, key, "full_outer").filter("coalesce(live, true)").select(key, "blob", "patches")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for blob, found in zip(rows["blob"], rows["patches"]):
                data = bytearray(blob or b"")
                for patch in found if found is not None else ():  # in stamp order: later ones write over
                    start, new = patch["start"], patch["bytes"]
                    if len(data) < start + len(new):
                        data.extend(bytes(start + len(new) - len(data)))
                    data[start : start + len(new)] = new
                out.append(bytes(data))
            yield rows[[key]].assign(blob=out)

    kind = joined.schema[key].dataType.simpleString()
    return joined.mapInPandas(run, f"{key} {kind}, blob binary")


def effective_lengths(writes: DataFrame, segments: DataFrame, key: str = "pk") -> DataFrame:
    """(key, length): the written length, or the end of the last segment that survives it."""
    surviving = segments.join(writes.select(key, F.struct(F.col("hlc"), F.col("origin")).alias("w")), key).filter(F.struct("hlc", "origin") > F.col("w"))
    ends = surviving.groupBy(key).agg(F.max("end").alias("end"))
    return writes.join(ends, key, "left").select(key, F.greatest(F.col("length"), F.coalesce("end", F.lit(0))).alias("length"))
