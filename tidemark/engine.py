"""The programmatic surface: a change log in, converged tables and status out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import audit, catalog, frontier, merge, unique


class MergeEngine:
    """Converged tables of one change log.

    ``group`` is how rows merge: ``row`` (last writer wins by image) or ``cell`` (by column). ``key``
    names the columns that identify a row (the table among them if the log has several),
    ``registers`` the merged columns and ``counter`` the additive one. Records that require a schema
    above ``schema_seq`` are held back.
    """

    def __init__(
        self, spark: SparkSession, log: DataFrame, group: str = "row", schema_seq: int | None = None, key: Sequence[str] = ("pk",), registers: Sequence[str] = ("a", "b"), counter: str = "n"
    ):
        if group not in ("row", "cell"):
            raise ValueError("group is row or cell")
        self.spark, self.group, self.schema_seq = spark, group, schema_seq
        self.key, self.registers, self.counter = list(key), list(registers), counter
        self.held = log.limit(0)
        if schema_seq is not None:
            log, self.held = catalog.gate(log, schema_seq)
        self.log = merge.once(log)

    def merged(self) -> DataFrame:
        return merge.merge_rows(self.log, self.key, self.registers) if self.group == "row" else merge.merge_cells(self.log, self.registers, self.key)

    def counters(self) -> DataFrame:
        return merge.checked_counters(self.log, self.counter, self.key)

    def view(self, name: str) -> DataFrame:
        """The merged table as a view for ``spark.sql``."""
        rows = self.merged()
        rows.createOrReplaceTempView(name)
        return rows

    def write(self, records: DataFrame) -> MergeEngine:
        """An engine over this log and ``records`` of some writer."""
        log = self.log.unionByName(self.held).unionByName(records, allowMissingColumns=True)
        return MergeEngine(self.spark, log, self.group, self.schema_seq, self.key, self.registers, self.counter)

    def row_states(self) -> DataFrame:
        return merge.row_states(self.log, self.registers, self.key)

    def frontier(self) -> DataFrame:
        return frontier.heads(frontier.ranges_of(self.log))

    def missing(self, tips: DataFrame) -> DataFrame:
        return frontier.missing(frontier.ranges_of(self.log), tips)

    def peers(self, progress: DataFrame, now: int, silent: int) -> DataFrame:
        """Status of the other replicas; see :func:`audit.peers`."""
        return audit.peers(progress, self.frontier(), now, silent)

    def conflicts(self) -> DataFrame:
        return audit.conflicts(self.log, self.registers, self.key, self.group)

    def pending(self) -> DataFrame:
        return merge.pending_updates(self.log, self.key)

    def duplicates(self, column: str) -> DataFrame:
        return unique.duplicates(self.merged().withColumn("owner", F.struct(*self.key)), column, "owner")

    def health(self, tips: DataFrame) -> DataFrame:
        return audit.health(self.frontier(), tips, self.log.limit(0), self.held)
