"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitefold.operators.joins import null_safe_join
from sitefold.session import cut_lineage


def _nearest(pairs: DataFrame) -> DataFrame:
    """(u, v, low): low is the least of u and its neighbours v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low"))
    return null_safe_join(pairs, least.withColumn("low", F.least("u", "low")), ["u"], "inner")


def _rooted(edges: DataFrame) -> bool:
    """Whether all edges (u, v) hang nodes on roots: one edge for each u, and no u is a v."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.agg(F.count_if(F.expr("up > 1 OR up = 1 AND down = 1"))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the component's least node.

    A large star hangs the larger neighbours of each node on the least one, a small star
    the smaller ones, until every node hangs on a root; a few rounds do for shallow
    graphs, none for edges that are stars already.  The least neighbour is found by a
    combined aggregate, and rows meet it in a join whose hot keys Spark splits, so a node
    with any number of neighbours is no single task's.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut_lineage(edges)
    while not _rooted(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        near = _nearest(large)
        small = near.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = small.unionByName(near.select("u", F.col("low").alias("v")))
        edges = cut_lineage(small.filter("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
