"""Mixing sources to target weights.

Every document gets a hash-random key. Documents are range-sorted by source and key, and
distributed prefix sums (see ``placing``) tell how many words lie ahead of each in its source.
A source takes all its documents as often as whole epochs fit its target, and of the last epoch
those documents whose middle lies before the exact cut, so the taken words miss the target by
half a document at most. The documents a source takes once more are the ones up to its cut, so
one row a source decides for every document, and no text is shuffled.

Targets: the sources share ``share`` times all words in proportion to their weights; no
source gets more than ``most`` times its own words, and what is over is shared anew.

Defined results: null texts have no words; a null source is a source of its own, sorted last;
documents with the same key are ordered by size and text hash, and rows that repeat all of it
are interchangeable: they enter the sort as one entry, of which the cut takes a part; a source
without words takes nothing; an empty table gives an empty table; other columns are carried
along by :func:`mixed_rows`, whatever their names, and ignored by :func:`mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.placing import running

from .spread import fresh, lookup, orderable, quoted
from .store import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Documents of one range of the sort, on average, when that makes more ranges than a shuffle has partitions.
BUCKET_ROWS = 1 << 20
SEED = "mix-1"


def _counted(content: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(content, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def n_words(text: str) -> Column:
    """Number of words between ASCII white space; null has none."""
    return _counted(quoted(text))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with the target of each.

    With caps, the targets are ``least(most * size, level * weight)``. Sorted by the level at
    which they reach their cap, sources fill up one after another, so the level is the first
    one that its own source does not reach, which is the largest of such levels: prefix sums
    over the sorted sources find it without iterating.
    """
    last, most_sources = F.col("source").isNull(), sources.count()
    named = running(sources.select("source", "source_size"), [last, F.col("source")], most=most_sources)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    capped = named.withColumns({"weight": weight, "cap": F.col("source_size") * float(most)}).drop("place").withColumn("fill", F.col("cap") / F.col("weight"))
    filled = materialize(running(capped, [F.col("fill"), last, F.col("source")], {"caps": "cap", "weights": "weight"}, most=most_sources), "mix-levels")
    size, weight = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = (F.lit(share * float(size)) - F.col("caps")) / (F.lit(weight) - F.col("weights"))
    (found,) = filled.agg(F.max(F.when(level <= F.col("fill"), level))).first()
    return filled.select("source", "source_size", F.least("cap", F.lit(float("inf") if found is None else found) * F.col("weight")).alias("target"))


def _facts(key: Column, text: Column, source: Column, seed: str) -> dict[str, Column]:
    """What decides about a document: its source (null ones named too), and its place in it."""
    return {
        "name": F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("source")),
        "at": F.struct(
            F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")).alias("order"),
            key.alias("key"),
            _counted(text).alias("size"),
            F.xxhash64(text).alias("tie"),
        ),
    }


def _cuts(thin: DataFrame, weights: Sequence[int], share: float, most: int, bucket_rows: int) -> DataFrame:
    """One row for each source of ``thin`` (name, at): rows, source_size, target, epochs, and the last entry taken once more (cut) with its rows and how many of them are."""
    totals = materialize(thin.groupBy("name").agg(F.sum("at.size").alias("source_size"), F.count("*").alias("rows")), "mix-sources")
    wanted = targets(totals.select(F.when(~F.col("name.none"), F.col("name.source")).alias("source"), "source_size"), weights, share, most)
    wanted = wanted.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source")).alias("name"), "target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    totals = totals.join(wanted, "name").withColumn("epochs", epochs)

    # rows that repeat the same place are one entry
    entries = thin.groupBy("name", "at").agg(F.count("*").alias("repeats")).withColumn("words", F.col("repeats") * F.col("at.size"))
    total = thin.count()
    ranges = max(int(thin.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_rows))
    placed = materialize(running(entries, ["name", "at"], {"ahead": "words"}, ranges=ranges), "mix-placed")
    starts = placed.groupBy("name").agg(F.min("ahead").alias("start"))
    bounds = totals.join(starts, "name").withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).select("name", "rows", "start", "rest", "epochs", "source_size")
    size, left = F.col("at.size"), F.col("rest") - (F.col("ahead") - F.col("start"))
    fits = F.when(size / 2 > left, 0).when((F.col("repeats") == 1) | (size == 0), F.col("repeats")).otherwise(F.least("repeats", F.floor((left - size / 2) / size) + 1))
    once_more = lookup(placed, bounds, ["name"], "rows", total).withColumn("fits", fits).filter((F.col("fits") > 0) & (F.col("source_size") > 0) & (F.col("epochs") < most))
    cut = once_more.groupBy("name").agg(F.max_by(F.struct("at", "fits", "repeats"), "at").alias("cut"))
    return materialize(totals.join(cut, "name", "left"), "mix-cuts")


def _decided(rows: DataFrame, cuts: DataFrame, total: int, order: list[str | Column]) -> DataFrame:
    """``rows`` (name, at, …) with the columns of their source and ``copies``. Of rows that repeat the entry of the cut, the first ones by ``order`` are taken."""
    joined = lookup(rows, cuts, ["name"], "rows", total)
    parted = F.coalesce((F.col("at") == F.col("cut.at")) & (F.col("cut.fits") < F.col("cut.repeats")), F.lit(False))
    more = F.when(F.col("at") <= F.col("cut.at"), 1).otherwise(0)
    whole = joined.filter(~parted).withColumn("copies", (F.col("epochs") + more).cast("long"))
    several = cuts.filter("cut.fits < cut.repeats").agg(F.sum("cut.repeats")).first()[0]
    if not several:  # every entry that a cut ends with is a single row, or wholly taken
        return whole
    turns = materialize(running(joined.filter(parted), ["name", *order], most=several), "mix-turns")
    first = turns.groupBy("name").agg(F.min("place").alias("first"), F.count("*").alias("parted"))
    turns = lookup(turns, first, ["name"], "parted", several)
    turns = turns.withColumn("copies", (F.col("epochs") + F.when(F.col("place") - F.col("first") < F.col("cut.fits"), 1).otherwise(0)).cast("long"))
    return whole.unionByName(turns.drop("place", "first", "parted"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, size, source_size, target, copies, taken) of every row."""
    facts = _facts(quoted(key), quoted(text), quoted(source), seed)
    thin = materialize(df.select(*(c.alias(n) for n, c in facts.items()), F.monotonically_increasing_id().alias("row")), "mix-thin")
    placed = _decided(thin, _cuts(thin, weights, share, most, bucket_rows), thin.count(), ["row"])
    size = F.col("at.size")
    return placed.select(F.col("at.key").alias(key), size.alias("size"), "source_size", "target", "copies", (F.col("copies") * size).alias("taken"))


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    facts = _facts(quoted(key), quoted(text), quoted(source), seed)
    thin = materialize(df.select(*(c.alias(n) for n, c in facts.items())), "mix-thin")
    (mine,) = fresh(df.columns, "mine")
    whole = df.select(F.struct(*(quoted(c) for c in df.columns)).alias(mine), *(c.alias(n) for n, c in facts.items()))
    order = [F.col(mine)[c] for c in orderable(df)]
    placed = _decided(whole, _cuts(thin, weights, share, most, bucket_rows), thin.count(), order)
    taken = placed.filter("copies > 0").select(mine, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return taken.select(f"{mine}.*")
