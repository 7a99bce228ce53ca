"""Connected components of a graph held in DataFrames, by alternating large-star and small-star contraction.

Every step is a minimum per node, written first, and a plain equi-join with it, in which Spark can split a node of very many
edges; nothing is collected but whether a step has reached stars. The edges of each step are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.storage import discard, materialize


def _joined_least(edges: DataFrame, least: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` over the edges with each one's least neighbour of u, m; all written."""
    least = materialize(least, "least")
    after = materialize(step(edges.join(least, "u")), "edges")
    discard(least)
    return after


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _joined_least(both, least, lambda x: x.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))


def _small_star(edges: DataFrame) -> DataFrame:
    # the edge to the least neighbour stays, the others are led there
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u"))
    return _joined_least(edges, least, lambda x: x.select(moved.alias("u"), F.col("m").alias("v")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge, and no node that edges lead to has one: then each leads to its component's least."""
    centres = edges.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")).distinct()
    # a centre counts as a second, different end of its own edge
    ends = edges.unionByName(centres).groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n"), F.count("v").alias("k"))
    return ends.where("a <> b or (n > k and k > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns u, v (longs). Returns node and component (its least node) for every node of an edge. Loops and
    repeated edges do no harm; without edges the result is empty."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        large = _large_star(now)
        discard(now)
        now = _small_star(large)
        discard(large)
        if _stars(now):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
