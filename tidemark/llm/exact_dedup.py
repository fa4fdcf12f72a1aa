"""Exact duplicates by progressive refinement.

Rows are grouped by the length of their normalised text; rows that share a length, by a hash of
its first characters as well; and only rows that still share a group have their whole text
hashed. What survives a step reaches the next scan as a bitmap of fixed size, so texts are read
in place and only keys and hashes are shuffled. Counts are combined before their shuffle, and
the copies of a hot text meet their group in a broadcast (see ``spread``).

Texts are equal when they are identical after lower-casing A-Z. Null counts as the empty text.
Of equal texts the row with the largest key stays; a null key is smaller than all others. Of
repeated rows with that same key one stays. An empty table gives an empty table. Columns other
than key and text are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import bitmap, flagged, lookup, quoted, without
from .store import materialize

#: Characters that the second step hashes.
HEAD = 64


def normalized(text: str | Column) -> Column:
    """Null as empty, A-Z in lower case, everything else as it is."""
    column = quoted(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(column, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(normalized(text), 256))


def _bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def _head(text: Column, head: int) -> Column:
    return F.xxhash64(_bytes(text), normalized(F.substring(text, 1, head)))


def refine(df: DataFrame, text: str = "text", head: int = HEAD) -> DataFrame:
    """The bitmap of the (length, head) hashes that two rows or more share."""
    whole = quoted(text)
    lengths = df.groupBy(_bytes(whole).alias("bytes")).agg(F.count("*").alias("n")).filter("n > 1")
    shared = bitmap(lengths, F.xxhash64("bytes"))
    rows = flagged(df.select(whole.alias("text")), F.xxhash64(_bytes(F.col("text"))), shared, "shared").filter("shared")
    heads = rows.groupBy(_head(F.col("text"), head).alias("head")).agg(F.count("*").alias("n")).filter("n > 1")
    return bitmap(heads, F.col("head"))


def _groups(full: DataFrame) -> DataFrame:
    """(sha, stays, group_size) of the texts of two rows or more among ``full`` (row, key, sha); stays is the (key, row) that does."""
    groups = full.groupBy("sha").agg(F.max(F.struct("key", "row")).alias("stays"), F.count("*").alias("group_size"))
    return groups.filter("group_size > 1")


def mark_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row of ``df``."""
    rows = df.select(quoted(key).alias("key"), quoted(text).alias("text"))
    rows = flagged(rows, _head(F.col("text"), head), refine(df, text, head), "survives")
    full = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "key", _sha(F.col("text")).alias("sha"), "survives"), "exact-full")
    shared = full.filter("survives").select("row", "key", "sha")
    joined = lookup(shared, _groups(shared), ["sha"], "group_size", full.count(), "left")
    alone = F.col("group_size").isNull()
    marked = joined.select(
        "key",
        F.when(alone, F.col("key")).otherwise(F.col("stays.key")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("stays.row"))).alias("kept"),
        "sha",
    )
    single = full.filter("NOT survives").select("key", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return single.unionByName(marked).select(F.col("key").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one of each text.

    Of repeated rows with the key that stays, the first one by text and then by the other columns stays.
    """
    rows = df.select(quoted(key).alias("key"), quoted(text).alias("text"))
    rows = flagged(rows, _head(F.col("text"), head), refine(df, text, head), "survives").filter("survives")
    full = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "key", _sha(F.col("text")).alias("sha")), "exact-full")
    counted = full.groupBy("key", "sha").agg(F.count("*").alias("repeats"))
    groups = _groups(full)
    found = lookup(counted, groups, ["sha"], "group_size", full.count())
    found = found.select(F.col("key").alias("k"), F.col("sha").alias("mark"), F.col("key").eqNullSafe(F.col("stays.key")).alias("stays"), "repeats")
    return without(df, quoted(key), _sha(quoted(text)), found.filter("NOT stays OR repeats > 1"), text)
