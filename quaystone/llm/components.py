"""Connected components of an edge table, by alternating large-star and small-star rounds over Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm import base


def _smallest(neighbours: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the smallest of u and all its neighbours. A hub's rows are pre-aggregated."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("w"))
    return neighbours.join(least.select("u", F.least("u", "w").alias("m")), "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) edges -> (node, component): the smallest node of each node's component.

    Repeated edges, both directions and self-loops are allowed; edges with a null end are ignored. Nodes without an
    edge to another node don't appear. Each round is written to shared storage; rounds grow as the logarithm of
    the longest path.
    """
    star = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    folder, nth = base.new_folder(edges.sparkSession), 0
    star, before = base.written(star, f"{folder}/0"), None
    while True:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        met = _smallest(large)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        star, nth = base.written(small, f"{folder}/{nth + 1}"), nth + 1
        base.removed(edges.sparkSession, f"{folder}/{nth - 1}")
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    roots = star.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
