"""Connected components by alternating large-star and small-star.

Edges are pairs of nodes of one orderable type. Each half-step is an aggregation with map-side combine and a join on the
same key; a hub's rows are split by adaptive execution. Every round is written to the shared folder.

Contract for odd input: loops, repeated edges and edges with a null node are ignored; no edges give no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.runtime import discard, materialize


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _least_neighbour(down)
    moved = linked.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(linked.select("u", F.col("m").alias("v"))).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """True if every node has one edge and none leads to a node that has an edge itself."""
    roots = edges.select(F.col("v").alias("u")).distinct().withColumn("root", F.lit(True))
    open_ = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).join(roots, "u", "left").filter((F.col("n") > 1) | F.col("root"))
    return not open_.limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge but the roots themselves; root is the smallest node of the component.

    ``edges`` has columns u and v; loops and repeats are ignored. No edges give no rows.
    """
    now = materialize(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_forest_of_stars(now):
        before, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
