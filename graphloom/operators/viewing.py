"""What a graph viewer asks for: the visible part, legends, panels and groups, and its payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import structural_domain, sub_folder


def visible(nodes: DataFrame, edges: DataFrame, packed: DataFrame, pack_only: bool = False, symbols: bool = True, folders: bool = True, groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that the switches leave visible; packed: (path, reason, mode).

    nodes: (id, type, label, path, in_pack, reason, mode, parent), parent being the
    group of a file's folder or domain. Edges need both ends.
    """
    in_pack = packed.select(F.concat(F.lit("file:"), "path").alias("id"), "reason", "mode", F.lit(True).alias("in_pack"))
    out = nodes.join(in_pack, "id", "left").withColumn("in_pack", F.coalesce("in_pack", F.lit(False)))
    if pack_only:
        out = out.filter("type <> 'file' or in_pack")
    hidden = ([] if symbols else ["symbol"]) + ([] if folders else ["folder"])
    if hidden:
        out = out.filter(~F.col("type").isin(hidden))
    domain = structural_domain(F.col("path"))
    group = F.concat_ws("/", domain, sub_folder(F.col("path"), domain))
    parent = F.when((F.col("type") == "file") & F.col("path").isNotNull() & F.lit(groups), F.concat(F.lit("grp:"), group))
    label = F.coalesce(F.nullif("label", F.lit("")), F.element_at(F.split("id", "/"), -1))
    shown = out.select("id", "type", label.alias("label"), "path", "in_pack", "reason", "mode", parent.alias("parent"))
    ends = shown.select("id").distinct()
    kept = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    weight = F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0))
    return shown, kept.select("src", "dst", "type", weight.alias("weight"))


def legend_counts(nodes: DataFrame, edges: DataFrame, packed: DataFrame) -> DataFrame:
    """(legend, entry, n): nodes by kind, folders, internal symbols, packed files, and edges by type; only what occurs."""
    n = F.count("*").alias("n")
    kinds = nodes.filter("kind is not null").groupBy("kind").agg(n).select(F.lit("kind").alias("legend"), F.col("kind").alias("entry"), "n")
    one = lambda df, entry: df.agg(n).filter("n > 0").select(F.lit("node"), F.lit(entry), "n")
    out = kinds.union(one(nodes.filter("type = 'folder'"), "folder")).union(one(nodes.filter("type = 'symbol' and not exported"), "internal symbol")).union(one(packed, "in pack"))
    return out.union(edges.groupBy("type").agg(n).select(F.lit("edge"), "type", "n"))


def closed_neighbourhood(edges: DataFrame, node_id: str) -> DataFrame:
    """(id): a node and every node that an edge ties to it."""
    near = edges.filter((F.col("src") == node_id) | (F.col("dst") == node_id))
    me = edges.sparkSession.createDataFrame([(node_id,)], "id string")
    return me.union(near.select("src")).union(near.select("dst")).distinct()


def file_summaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, defines, imports, imported_by, tested_by) of each file."""
    count = lambda df, key, name: df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
    of = lambda kind: edges.filter(F.col("type") == kind)
    out = nodes.filter("type = 'file'").select("id")
    for name, found in {"defines": count(of("defines"), "src", "defines"), "imports": count(of("imports"), "src", "imports"), "imported_by": count(of("imports"), "dst", "imported_by"), "tested_by": count(of("tests"), "dst", "tested_by")}.items():
        out = out.join(found, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def group_leaves(nodes: DataFrame) -> DataFrame:
    """(group, parent, n_leaves): how many files a collapsed group stands for, by domain and by folder in it."""
    files = nodes.filter("type = 'file' and path is not null").select(structural_domain(F.col("path")).alias("domain"), "path")
    files = files.withColumn("sub", F.nullif(sub_folder(F.col("path"), F.col("domain")), F.lit("")))
    of_domain = F.concat(F.lit("grp:"), "domain")
    tops = files.groupBy("domain").agg(F.count("*").alias("n_leaves")).select(of_domain.alias("group"), F.lit(None).cast("string").alias("parent"), "n_leaves")
    subs = files.filter("sub is not null").groupBy("domain", "sub").agg(F.count("*").alias("n_leaves")).select(F.concat(of_domain, F.lit("/"), "sub"), of_domain, "n_leaves")
    return tops.union(subs)


def payload(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): a JSON line for each node and edge, which a viewer loads as they come."""
    line = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("line"))
    return line(nodes, "node").union(line(edges, "edge"))
