"""Connected components of a graph given by edges, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation (Kiveris et al., 2014): edges of each node are moved to the least of its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(least, "u")
    moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are stars around least nodes: no node has two edges down, no centre has one."""
    down = edges.groupBy("u").agg(F.count("*").alias("k"), F.lit(False).alias("centre"))
    centres = edges.groupBy("v").agg(F.lit(0).cast("long").alias("k"), F.lit(True).alias("centre")).withColumnRenamed("v", "u")
    nodes = down.unionByName(centres).groupBy("u").agg(F.max("k").alias("k"), F.max("centre").alias("centre"))
    return nodes.where("k > 1 OR (k > 0 AND centre)").isEmpty()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and root (the least node of its component) for every node of edges (u, v); others aren't listed.

    Each round is written to the shared folder, so a lost executor never repeats more than one. A hub's neighbours
    are reduced to their minimum before the shuffle, and its edges are joined row by row.
    """
    now = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most):
        if _settled(now):
            break
        now = kept(_star(_star(now, True), False).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
