"""The schema log and the catalog it folds into.

An event is (schema_seq, parent_seq, kind, object_kind, object_id, parent_id, name). Identities are
never reused; the last event of an identity decides.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The operations of the schema log.
KINDS = (
    "create_table", "rename_table", "drop_table", "add_column", "rename_column", "drop_column", "alter_column", "add_unique_key", "drop_unique_key", "create_index",
    "drop_index", "create_view", "drop_view", "create_vtab", "drop_vtab", "create_trigger", "drop_trigger", "bundle", "set_clock_group",
)
VERSION = 1


def append(spark: SparkSession, folder: str, parent: int, event: dict) -> bool:
    """Compare-and-swap: writes event ``parent + 1``; false if the log has moved on.

    The file is made under its final name only if it is not there, which the file system decides.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{parent + 1:012d}.json")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{parent:012d}.json")
    if parent > 0 and not files.exists(before):
        return False
    try:
        stream = files.create(path, False)
    except Exception as error:
        if "AlreadyExists" in str(error) or "already exists" in str(error):
            return False
        raise
    stream.write(bytearray(json.dumps(event | {"schema_seq": parent + 1, "parent_seq": parent, "version": VERSION}).encode()))
    stream.close()
    return True


def read_log(spark: SparkSession, folder: str, start: int = 0) -> DataFrame:
    """Events from ``start`` on; an event of an unknown version or kind stops the reader."""
    rows = spark.read.schema("schema_seq long, parent_seq long, version int, kind string, object_id string, name string").json(f"{folder}/*.json")
    known = (F.col("version") == VERSION) & F.col("kind").isin(*KINDS)
    checked = F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown schema event "), F.col("schema_seq").cast("string"))))
    return rows.filter(F.col("schema_seq") >= start).withColumn("kind", checked).orderBy("schema_seq")


def admit(ops: DataFrame, order: str = "schema_seq", text: str = "op") -> DataFrame:
    """(order, kind, object_id, outcome) of framed operations: JSON texts with version, kind and object_id.

    A reader stops at the first operation that it cannot read, whose version or kind it does not know:
    that one is refused, and all behind it wait.
    """
    read = F.from_json(text, "version int, kind string, object_id string")
    rows = ops.select(order, read.alias("r")).select(order, "r.version", "r.kind", "r.object_id")
    known = F.coalesce((F.col("version") == VERSION) & F.col("kind").isin(*KINDS), F.lit(False))
    first = rows.filter(~known).agg(F.min(order).alias("_stop"))
    outcome = F.when(F.col("_stop").isNull() | (F.col(order) < F.col("_stop")), "admitted").when(F.col(order) == F.col("_stop"), "refused").otherwise("held")
    stop = first.first()["_stop"]
    return rows.withColumn("_stop", F.lit(stop).cast(rows.schema[order].dataType)).select(order, "kind", "object_id", outcome.alias("outcome"))


def valid_chain(events: DataFrame) -> DataFrame:
    """Adds in_order: whether each event's parent is the event before it.

    The log is one totally ordered sequence; a window over all of it is its definition.
    """
    return events.withColumn("in_order", F.col("parent_seq") == F.coalesce(F.lag("schema_seq").over(Window.orderBy("schema_seq")), F.lit(0)))


def page(events: DataFrame, start: int, limit: int) -> DataFrame:
    return events.filter(F.col("schema_seq") >= start).orderBy("schema_seq").limit(limit)


def head(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.max("schema_seq"), F.lit(0)).alias("head"))


def fold(events: DataFrame, at: int | None = None) -> DataFrame:
    """(object_kind, object_id, name, create_seq, drop_seq) of every object, by the events up to ``at``."""
    seen = events if at is None else events.filter(F.col("schema_seq") <= at)
    named = F.col("action").isin("create", "rename")
    return seen.groupBy("object_kind", "object_id").agg(
        F.max_by("name", F.when(named, F.col("schema_seq"))).alias("name"),
        F.min(F.when(F.col("action") == "create", F.col("schema_seq"))).alias("create_seq"),
        F.max(F.when(F.col("action") == "drop", F.col("schema_seq"))).alias("drop_seq"),
    )


def live_at(objects: DataFrame, at: Column) -> DataFrame:
    """Objects that exist at a schema_seq."""
    return objects.filter((F.col("create_seq") <= at) & (F.col("drop_seq").isNull() | (F.col("drop_seq") > at)))


def gate(records: DataFrame, local: int) -> tuple[DataFrame, DataFrame]:
    """(ready, held): records whose schema the replica has, and those that wait."""
    ready = F.coalesce(F.col("required_schema_seq"), F.lit(0)) <= local
    return records.filter(ready), records.filter(~ready)


def terminal(events: DataFrame, key: str) -> DataFrame:
    """The last event of each key."""
    columns = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), "schema_seq").alias("e")).select(key, "e.*")


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, action: str, default: Column | None = None) -> DataFrame:
    """Children after the parents in ``parents`` are gone: cascade, set null or set default."""
    gone = parents.select(F.col(parent_key).alias("_gone")).distinct()
    if action == "cascade":
        return children.join(gone, F.col(child_key) == F.col("_gone"), "left_anti")
    value = F.lit(None) if action == "set null" else default
    joined = children.join(gone, F.col(child_key) == F.col("_gone"), "left")
    return joined.select(*(F.when(F.col("_gone").isNull(), F.col(c)).otherwise(value.cast(children.schema[c].dataType)).alias(c) if c == child_key else F.col(c) for c in children.columns))


def rename_cascade(children: DataFrame, renames: DataFrame, child_key: str) -> DataFrame:
    """Children after parent keys changed (renames: old_key, new_key)."""
    joined = children.join(renames, F.col(child_key) == F.col("old_key"), "left")
    return joined.select(*(F.coalesce("new_key", child_key).alias(c) if c == child_key else F.col(c) for c in children.columns))


def admission(statement: Column) -> Column:
    """Whether a DDL statement is shipped, stays local or is refused; only changes that relax are shipped."""
    said = F.upper(F.trim(statement))
    refused = said.rlike(r"^ALTER TABLE .* (ALTER COLUMN .* TYPE|SET NOT NULL|ADD CONSTRAINT|ADD CHECK)|^CREATE (TYPE|DOMAIN|RULE)|^ALTER TABLE .* ADD COLUMN .* NOT NULL(?!.* DEFAULT)|^TRUNCATE")
    local = said.rlike(r"^(CREATE|DROP|ALTER) (TEMP|TEMPORARY|ROLE|USER|FUNCTION|PROCEDURE|EXTENSION|PUBLICATION|SUBSCRIPTION|SEQUENCE)|^(VACUUM|ANALYZE|REINDEX|GRANT|REVOKE|COMMENT)|^CREATE (UNIQUE )?INDEX CONCURRENTLY")
    shipped = said.rlike(r"^(CREATE|DROP|ALTER) (TABLE|INDEX|VIEW|TRIGGER)|^CREATE (OR REPLACE )?(UNIQUE INDEX|VIEW)")
    return F.when(refused, "rejected").when(local, "local").when(shipped, "replicated").otherwise("rejected")
