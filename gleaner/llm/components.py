"""Distributed union-find: connected components by alternating large and small stars.

Each step moves every edge to the least neighbour of one of its ends, so the
graph becomes a set of stars around component minima in a logarithmic number of
rounds.  A hub's edges are never gathered in one task: minima are aggregated
with partial sums, written, and joined back, where adaptive execution may split
a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.workspace import Workspace


def _is_stars(edges: DataFrame) -> bool:
    """Whether every edge leads to a centre: one edge out of a node, and none into one that has an edge out."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not nodes.where("out > 1 or (out = 1 and into = 1)").limit(1).count()


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b longs): the least id it is connected to."""
    now = ws.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _is_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = ws.save(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = ws.save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = ws.save(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        ws.drop(now, low, large, low2)
        now = after
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
