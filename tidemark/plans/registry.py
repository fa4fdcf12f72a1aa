"""All queries of the merge engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


from . import audit_queries, capture_queries, clock_queries, frontier_queries, merge_queries, range_queries, schema_queries, storage_queries, unique_queries  # noqa: E402, F401
