"""Changes of a project: a frozen subgraph, a manifest and a state for each, for any number of them in one job."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import structural_domain
from ..plans.session import settle
from .rollups import match_entries
from .subgraph import Subgraph

# Names that a change may have.
CHANGE_NAME = r"^[a-zA-Z0-9._-]+$"


def check_name(change_id: str) -> str:
    """change_id, or an error that says what is allowed."""
    if not re.match(CHANGE_NAME, change_id):
        raise ValueError(f"not a change name: {change_id}; letters, digits, '.', '_' and '-' are allowed")
    return change_id


class ChangeGraphs(Subgraph):
    """Nodes (change_id, id, type) and edges (change_id, src, dst, type) of several changes."""

    def stats(self) -> DataFrame:
        """(change_id, part, type, n): nodes and edges of each change by type."""
        by = lambda df, part: df.groupBy("change_id", "type").agg(F.count("*").alias("n")).select("change_id", F.lit(part).alias("part"), "type", "n")
        return by(self.nodes, "node").union(by(self.edges, "edge"))

    def totals(self) -> DataFrame:
        """(change_id, n_nodes, n_edges)."""
        n = lambda df, name: df.groupBy("change_id").agg(F.count("*").alias(name))
        return n(self.nodes, "n_nodes").join(n(self.edges, "n_edges"), "change_id", "left").select("change_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def change_subgraphs(nodes: DataFrame, edges: DataFrame, focus: DataFrame, depth: int = 1) -> ChangeGraphs:
    """What lies within `depth` undirected hops of the focus files of each change; focus: (change_id, path, mode).

    As subgraph.change_subgraph() for one change: a compact change adds the exported
    symbols of its focus files, a full one starts from all of their symbols and adds
    every symbol of a reached file. A hop is one join for all changes together.
    """
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    focus = settle(focus.select("change_id", path.alias("path"), "mode").distinct())
    modes = focus.groupBy("change_id").agg(F.max("mode").alias("mode"))
    symbols = settle(nodes.filter("type = 'symbol' and path is not null").select("id", "path", "exported"))
    seen = focus.select("change_id", F.concat(F.lit("file:"), "path").alias("id"))
    seen = settle(seen.union(focus.filter("mode = 'full'").join(symbols, "path").select("change_id", "id")).distinct())
    both = settle(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    frontier = seen
    for _ in range(max(0, depth)):
        next_ = frontier.withColumnRenamed("id", "src").join(both, "src").select("change_id", F.col("dst").alias("id")).distinct()
        frontier = settle(next_.join(seen, ["change_id", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    own = focus.filter("mode <> 'full'").join(symbols.filter("exported"), "path").select("change_id", "id")
    full = modes.filter("mode = 'full'").select("change_id")
    of_file = symbols.select("id", F.concat(F.lit("file:"), "path").alias("file"))
    far = seen.join(full, "change_id", "left_semi").withColumnRenamed("id", "file").join(of_file, "file").select("change_id", "id")
    reached = settle(seen.union(own).union(far).distinct())
    held = edges.join(reached.select("change_id", F.col("id").alias("src")), "src").join(reached.select(F.col("change_id").alias("other"), F.col("id").alias("dst")), "dst")
    kept = held.filter("change_id = other").select("change_id", *edges.columns)
    return ChangeGraphs(nodes.join(reached, "id").select("change_id", *nodes.columns), kept)


def refresh(stored: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 1) -> tuple[ChangeGraphs, DataFrame]:
    """New subgraphs of stored changes (change_id, focus, mode), and (change_id, state): refreshed or skipped.

    A change without focus files is skipped; a missing mode is compact.
    """
    live = F.coalesce(F.size("focus"), F.lit(0)) > 0
    state = stored.select("change_id", F.when(live, "refreshed").otherwise("skipped").alias("state"))
    focus = stored.filter(live).select("change_id", F.explode("focus").alias("path"), F.coalesce("mode", F.lit("compact")).alias("mode"))
    return change_subgraphs(nodes, edges, focus, depth), state


def change_manifests(entries: DataFrame, focus: DataFrame) -> DataFrame:
    """(change_id, path, name, matched, match_type, reason, globs): the manifest of each change; focus: (change_id, path).

    Every entry is listed for every change, matched or left out, as one manifest lists
    all entries; entries are a project's skills and rules, a short list.
    """
    touched = focus.groupBy("change_id").agg(F.array_sort(F.collect_set(structural_domain(F.col("path")))).alias("touched"))
    return match_entries(touched.crossJoin(entries), ["change_id"])


def artifact_status(artifacts: DataFrame, now_ms: int) -> DataFrame:
    """(name, present, age_minutes, detail) of artifacts (name, mtime_ms, counts, value).

    counts maps what an artifact holds to how many; value is text beside it.
    """
    held = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["value"].cast("string"), F.lit(" "), e["key"])), ", ")
    detail = F.nullif(F.concat_ws(", ", F.nullif(held, F.lit("")), "value"), F.lit(""))
    age = F.floor((F.lit(now_ms) - F.col("mtime_ms")) / 60000 + 0.5).cast("long")
    gone = F.col("mtime_ms").isNull()
    return artifacts.select("name", (~gone).alias("present"), age.alias("age_minutes"), F.when(gone, "not found").otherwise(detail).alias("detail"))
