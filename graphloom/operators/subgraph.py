"""k-hop change subgraphs and topological tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import settle


@dataclass
class Subgraph:
    nodes: DataFrame
    edges: DataFrame

    def stats(self) -> DataFrame:
        """(part, type, n): nodes and edges by type."""
        by = lambda df, part: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "type", "n")
        return by(self.nodes, "node").union(by(self.edges, "edge"))


def change_subgraph(nodes: DataFrame, edges: DataFrame, focus: list[str], depth: int = 1, mode: str = "compact") -> Subgraph:
    """What lies within `depth` undirected hops of the focus files, over all edge types.

    compact adds the exported symbols of focus files, full every symbol of a
    reached file (and starts from the focus files' symbols too). Edges are those
    between reached nodes.
    """
    focus = [p.replace("\\", "/") for p in focus]
    seeds = [f"file:{p}" for p in focus]
    spark = nodes.sparkSession
    seen = spark.createDataFrame([(s,) for s in seeds] or [], "id string")
    symbols = nodes.filter("type = 'symbol' and path is not null").select("id", "path", "exported")
    if mode == "full":
        seen = seen.union(symbols.filter(F.col("path").isin(focus)).select("id")).distinct()
    both = settle(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    seen = settle(seen)
    frontier = seen
    for _ in range(max(0, depth)):
        frontier = settle(frontier.select(F.col("id").alias("src")).join(both, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    if mode == "full":
        more = symbols.withColumn("file", F.concat(F.lit("file:"), "path")).join(seen.withColumnRenamed("id", "file"), "file", "left_semi").select("id")
    else:
        more = symbols.filter(F.col("path").isin(focus) & F.col("exported")).select("id")
    reached = settle(seen.union(more).distinct())
    kept = edges.join(reached.withColumnRenamed("id", "src"), "src", "left_semi").join(reached.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Subgraph(nodes.join(reached, "id", "left_semi"), kept.select(edges.columns))


def topological_tiers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, tier): Kahn's tiers; nodes on or behind a cycle share the last tier.

    One anti-join for each tier; the number of tiers is the longest path.
    """
    left = settle(nodes.select("id").distinct())
    links = settle(edges.select("src", "dst").distinct())
    out, tier = None, 0
    while True:
        live = links.join(left.withColumnRenamed("id", "src"), "src", "left_semi")
        free = settle(left.join(live.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
        if free.isEmpty():
            break
        placed = free.withColumn("tier", F.lit(tier))
        out = placed if out is None else out.union(placed)
        left, tier = settle(left.join(free, "id", "left_anti")), tier + 1
    rest = left.withColumn("tier", F.lit(tier))
    return rest if out is None else out.union(rest)
