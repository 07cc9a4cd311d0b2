"""Connected components of a graph that is a DataFrame, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import durable


def _least_neighbours(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) of every node of ``edges`` (``u``, ``v``).

    Each round hangs the larger neighbours of a node, then the smaller ones, on its least neighbour (large star, small star) until
    every edge points from a node to its root. Degrees of hot nodes are combined before the shuffle; the joins back can be split.
    NULL ends and loops are ignored; an empty table gives an empty result. Raises when ``most_rounds`` rounds don't settle it.
    """
    pairs = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = durable(pairs.distinct())
    for _ in range(most_rounds):
        both = _both_ways(current)
        large = both.join(_least_neighbours(both), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        # Every edge now points down; a node keeps the edge to its least neighbour and links the others to it.
        low = large.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        joined = large.join(low, "u")
        small = joined.select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
        after = durable(small.filter(F.col("u") != F.col("v")).distinct())
        # Settled: each node has one edge, and no node is both an end and a root.
        ends = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        roots = after.select(F.col("v").alias("u")).distinct()
        settled = ends.filter(F.col("n") > 1).isEmpty() and ends.join(roots, "u", "left_semi").isEmpty()
        current = after
        if settled:
            lone = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(lone).distinct()
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
