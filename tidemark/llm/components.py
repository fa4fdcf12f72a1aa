"""Connected components of an edge table, by alternating star operations.

A large star joins every larger neighbour of a node to its smallest neighbour, a small star
does so with the smaller ones. Both replace edges by edges that connect the same nodes; they
end in one star for each component, whose centre is its smallest node. Every step is an
aggregate that combines before its shuffle, and a lookup in which nodes with very many edges
meet their row in a broadcast (see ``spread``), so no task gathers the edges of one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import MOST_HOT, lookup
from .store import materialize


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step over the ``total`` edges (a, b) with a > b."""
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    near = down.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else down
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = lookup(near, least, ["u"], "n", 2 * total)
    moved = joined.filter(F.col("v") > F.col("u") if large else F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a != b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    The number of rounds grows with the logarithm of the longest path.
    """
    current = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(current, "edges")
    while total := current.count():
        grown = _star(current, True, total).distinct()
        current = materialize(_star(grown if total <= MOST_HOT // 2 else materialize(grown, "components"), False, total).distinct(), "components")
        # done when nodes with a centre are no centres themselves and have no second one
        ends = current.select(F.col("a").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above"))
        ends = ends.unionByName(current.select(F.col("b").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        moving = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 OR (below > 0 AND above > 0)")
        if not moving.limit(1).count():
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
