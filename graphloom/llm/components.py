"""Connected components of an edge list, by alternating large-star and small-star.

(Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014.)
Every round is a group minimum, which is combined before the shuffle, and an
equi-join of edges with one row per node, whose hot keys AQE can split; no
neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import settle


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (u > v)."""
    if small:
        around = edges.select("u", "v")
    else:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = around.join(least, "u")
    if small:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node of an edge list of longs.

    component is the smallest node that can be reached. Self loops and repeated
    or reversed edges change nothing; a null end drops the edge; no edges give
    no rows. A node with a self loop only has no row.
    """
    now = settle(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
        .distinct()
    )
    mark = None
    while True:
        now = settle(_star(_star(now, small=False), small=True))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select("v", "v").distinct())
