"""Ranking: adjacency, personalized PageRank, bounded BFS, scores and context selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import keywords
from ..plans.session import settle
from .packing import pack

ALPHA, MAX_ITERATIONS, TOLERANCE = 0.85, 50, 1e-6
#: Edges and nodes up to which one task ranks the graph in numpy.
LOCAL_LIMIT = 1_000_000

# Default weight of each edge type.
EDGE_WEIGHTS = {
    "defines": 1.0, "imports": 0.8, "calls": 1.0, "references": 0.6, "tests": 1.2, "contains": 0.5, "extends": 0.9, "implements": 0.9,
    "belongs_to_domain": 1.0, "in_layer": 0.7, "exposes_endpoint": 1.2, "implements_flow": 1.0, "flow_step": 1.0, "cross_domain": 0.5,
}


def default_weight(edge_type: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in EDGE_WEIGHTS.items() for x in kv)), edge_type)


def ranking_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of edges between known nodes; parallel edges all count."""
    ids = nodes.select("id")
    known = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    return known.select("src", "dst", weight.cast("double").alias("weight"))


def _rank_local(iterations, tolerance, alpha):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf.dst.isna()]
        edges = pdf[pdf.dst.notna()]
        ids = nodes.src.to_numpy()
        order = np.argsort(ids)
        index = pd.Index(ids[order])
        p = nodes.weight.to_numpy()[order]
        src, dst, w = index.get_indexer(edges.src), index.get_indexer(edges.dst), edges.weight.to_numpy()
        out = np.bincount(src, w, len(index))
        dangling = out == 0
        share = w / out[src] if len(w) else w
        r = np.full(len(index), 1 / max(1, len(index)))
        for _ in range(iterations):
            new = (1 - alpha) * p + alpha * (r[dangling].sum() / len(r) + np.bincount(dst, r[src] * share, len(index)))
            change = np.abs(new - r).sum()
            r = new
            if change < tolerance:
                break
        return pd.DataFrame({"id": index, "rank": r})

    return run


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: list[str] | None = None, iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE, alpha: float = ALPHA, local_limit: int = LOCAL_LIMIT) -> DataFrame:
    """(id, rank) by personalized PageRank.

    r' = (1 - alpha) p + alpha (dangling / N + sum of r w / W_out), from 1 / N, until
    the ranks change by less than tolerance in sum. p is uniform over the seeds
    that exist, or over all nodes without any. Graphs of up to local_limit nodes
    and edges are ranked in one task; larger ones by joins, with each iteration
    settled so that plans don't grow.
    """
    spark = nodes.sparkSession
    # nodes and edges may be long plans of their own: each is made once
    ids = settle(nodes.select("id").distinct())
    seeded = ids.filter(F.col("id").isin(seeds)).count() if seeds else 0
    n = ids.count()
    if not n:
        return spark.createDataFrame([], "id string, rank double")
    p = F.when(F.col("id").isin(seeds), F.lit(1.0 / seeded)).otherwise(F.lit(0.0)) if seeded else F.lit(1.0 / n)
    base = ids.select("id", p.alias("p"))
    links = settle(ranking_edges(ids, edges))
    if n <= local_limit and links.limit(local_limit + 1).count() <= local_limit:
        rows = base.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("p").alias("weight")).union(links)
        return rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_rank_local(iterations, tolerance, alpha), "id string, rank double")
    out = links.groupBy("src").agg(F.sum("weight").alias("total")).filter("total > 0")
    share = settle(links.join(out, "src").groupBy("src", "dst").agg(F.sum(F.col("weight") / F.col("total")).alias("share")))
    base = settle(base.join(out.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").withColumn("dangling", F.coalesce("dangling", F.lit(True))))
    ranks = settle(base.select("id", "p", "dangling", F.lit(1.0 / n).alias("rank")))
    for _ in range(iterations):
        # one job for the dangling mass, one for the step; the change comes with the step's table
        lost = ranks.filter("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = ranks.join(share, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = (1 - alpha) * F.col("p") + alpha * (F.lit(lost / n) + F.coalesce("got", F.lit(0.0)))
        ranks = settle(ranks.join(got, F.col("id") == F.col("dst"), "left").select("id", "p", "dangling", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")))
        if ranks.agg(F.sum("moved")).first()[0] < tolerance:
            break
        ranks = ranks.drop("moved")
    return ranks.select("id", "rank")


def bfs(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(id, dist): directed hops from known seeds, up to depth."""
    known = settle(nodes.select("id").distinct())
    seen = settle(seeds.select("id").distinct().join(known, "id", "left_semi").withColumn("dist", F.lit(0)))
    links = settle(ranking_edges(known, edges).select("src", "dst").distinct())
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.select(F.col("id").alias("src")).join(links, "src").select(F.col("dst").alias("id")).distinct()
        frontier = settle(reached.join(seen, "id", "left_anti").withColumn("dist", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def combined_score(rank: Column, dist: Column, multiplier: float = 1.0) -> Column:
    return rank / (1 + dist) * multiplier


def matched_domains(nodes: DataFrame, task: str) -> DataFrame:
    """Ids of domain nodes whose label equals, holds or is held by a keyword of the task."""
    words = nodes.sparkSession.range(1).select(keywords(F.lit(task)).alias("words"))
    low = F.lower("label")
    fits = F.exists("words", lambda w: low.contains(w) | w.contains(low))
    return nodes.filter("type = 'domain'").crossJoin(F.broadcast(words)).filter(fits).select("id")


def estimated_tokens(size: Column) -> Column:
    return F.greatest(F.lit(20), F.ceil(F.coalesce(size, F.lit(500)) / 4)).cast("long")


def score_files(nodes: DataFrame, edges: DataFrame, sizes: DataFrame, seeds: list[str] | None = None, task: str | None = None, boost: float = 1.5, depth: int = 2, candidates: int = 50, iterations: int = MAX_ITERATIONS) -> DataFrame:
    """(path, score, kind, tokens, hash, is_seed): the best files for a task."""
    files = nodes.filter("type = 'file' and path is not null and kind in ('code', 'test')")
    seed_ids = [f"file:{s}" for s in seeds or []]
    ranks = pagerank(files, edges, seed_ids, iterations)
    scored = files.join(ranks, "id")
    found = [r[0] for r in files.filter(F.col("id").isin(seed_ids)).select("id").collect()] if seed_ids else []
    score = F.col("rank")
    if found:
        near = bfs(files, edges, files.filter(F.col("id").isin(found)), depth)
        scored = scored.join(near, "id", "left")
        score = combined_score(F.col("rank"), F.coalesce("dist", F.lit(depth)))
    if task:
        boosted = edges.filter("type = 'belongs_to_domain'").join(matched_domains(nodes, task).withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("boosted", F.lit(True))
        scored = scored.join(boosted, "id", "left")
        score = score * F.when(F.col("boosted"), F.lit(boost)).otherwise(F.lit(1.0))
    scored = scored.join(sizes.select("path", F.col("size").alias("file_size")), "path", "left")
    # rounded before ordering: sums differ in their last bits with the order of rows
    best = scored.select("path", F.round(score, 12).alias("score"), "kind", estimated_tokens(F.col("file_size")).alias("tokens"), "hash", F.col("id").isin(found).alias("is_seed") if found else F.lit(False).alias("is_seed"))
    return best.orderBy(F.desc("score"), "path").limit(candidates)


def select_context(nodes: DataFrame, edges: DataFrame, sizes: DataFrame, budget: int = 12000, **options) -> DataFrame:
    """The packed context for a task: see score_files() and pack()."""
    return pack(score_files(nodes, edges, sizes, **options).withColumn("pack_id", F.lit(0)), budget)


def enrichment_targets(nodes: DataFrame, limit: int = 100) -> DataFrame:
    """Exported symbols most worth describing: classes, interfaces, types, functions."""
    # Priority of each symbol kind.
    order = {"class_declaration": 0, "class_definition": 0, "interface_declaration": 1, "type_alias_declaration": 2, "function_declaration": 3, "function_definition": 3}
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), F.col("kind"))
    return nodes.filter((F.col("type") == "symbol") & F.col("exported") & F.col("kind").isin(list(order))).withColumn("priority", rank).orderBy("priority", "id").limit(limit)
