"""Connected components of an edge table, by alternating large and small stars.

Each round is made of minimum aggregates and joins on unique keys, and its edges are written to
the shared folder. No neighbourhood is gathered; a node may have any number of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.session import Staging


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (large: the greater ones, small: all lesser ones) to its minimum."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        lesser = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = least.select("u", F.col("m").alias("v")).unionByName(lesser)
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, staging: Staging) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the component's least node."""
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = staging.put(edges.select(u, v).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        now = staging.put(_star(_star(now, large=True), large=False), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
