"""Connected components of an edge table by alternating large and small stars.

Every step is a combinable minimum per node and an equi-join, so a hub's edges are spread over tasks; every round is a
table in the shared folder. Edges may repeat, point either way, or join a node to itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from every node that has an edge. ``edges``: a, b."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while True:
        # done when every node has one parent and no parent has one
        each = e.groupBy("hi").agg(F.count(F.lit(1)).alias("k"))
        more = each.where("k > 1").select("hi").unionByName(each.join(e.select(F.col("lo").alias("hi")), "hi", "left_semi").select("hi"))
        if not more.limit(1).count():
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = cut(small.unionByName(root.select("hi", F.col("m").alias("lo"))).distinct())
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
