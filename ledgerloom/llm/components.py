"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(pairs: DataFrame) -> DataFrame:
    """For every node a with neighbours b: pairs (b, least of a and its neighbours), as asked."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return pairs.join(least, "a")


def _are_stars(edges: DataFrame) -> bool:
    """Has every node one edge to a lower one, which has none itself?"""
    ends = edges.select("a", F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    return ends.groupBy("a").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or low = 1 and high = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches), for all nodes of the edges (a, b).

    A star step joins each edge with the least neighbour of its node; a hot node's edges are summed
    up before the shuffle, and Spark may split them in the join. Rounds grow with the logarithm of
    the size of the largest component. An edge table without rows gives none.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = _stars(large)
        now = cut(small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
