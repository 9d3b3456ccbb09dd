"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _stars(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Hang neighbours on the smallest node around each `u`: the larger ones, or all smaller ones.

    Minima come from an aggregation that combines before its shuffle; the join back is one AQE
    can split where a node has very many neighbours.
    """
    if smaller_only:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = around.groupBy("u").agg(F.min("v").alias("low"))
    lowest = lowest.select("u", F.least("u", "low").alias("low"))
    joined = around.join(lowest, "u")
    if smaller_only:
        moved = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            lowest.select("u", F.col("low").alias("v")))
    else:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (long columns u, v); root is its component's smallest.

    Each round is checkpointed. The rounds grow with the logarithm of the longest path; they end
    when a round changes no edge.
    """
    edges = checkpointed(edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
        edges = checkpointed(_stars(_stars(edges, False), True))
