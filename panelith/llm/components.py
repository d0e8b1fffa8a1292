"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelith.llm.common import drop, stored


def _least_neighbours(pairs: DataFrame) -> DataFrame:
    """Rows ``u, v`` with ``m``, the least of u and its neighbours. Both sides of the join are plain shuffles, so a node with very many neighbours is split."""
    return pairs.join(pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Each greater neighbour of u is linked to the least of u's neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbours(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """u and each lesser neighbour are linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    held = _least_neighbours(down)
    moved = held.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
    return moved.select("x.*").where("u <> v").distinct()


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge upwards or is a root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up = 1 and root = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node with an edge; the component is its least node.

    ``edges`` has ``u`` and ``v`` of one orderable type; direction, repetition and loops make no
    difference, and edges with a null are ignored. Each step is written, so a lost executor costs at most a step.
    """
    held = stored(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not is_forest_of_stars(held):
        wide = stored(large_star(held), "edges")
        near = stored(small_star(wide), "edges")
        drop(held, wide)
        held = near
    return held.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("x")).select("x.*").distinct()
