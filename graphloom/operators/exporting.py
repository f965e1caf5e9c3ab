"""Exports of a graph as lines of text, and writers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import escape_dot, escape_xml
from .ordering import number_rows

# Colours, shapes and line styles of the DOT form.
NODE_FILL = {"file": "#1f6feb", "symbol": "#21262d", "folder": "#484f58", "package": "#9e6a03"}
NODE_SHAPE = {"folder": "box", "symbol": "ellipse", "package": "octagon"}
EDGE_STYLE = {
    "defines": ("#6e7681", "solid"), "imports": ("#58a6ff", "solid"), "tests": ("#3fb950", "bold"), "extends": ("#bc8cff", "solid"),
    "implements": ("#d2a8ff", "dashed"), "contains": ("#30363d", "dotted"), "calls": ("#f0883e", "solid"), "references": ("#a5d6ff", "dashed"),
}
OTHER_FILL, OTHER_SHAPE, OTHER_STYLE = "#161b22", "circle", ("#8b949e", "solid")


def _lookup(table: dict, key, other: str):
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(other))


def _key(*columns: str):
    """What nodes and edges of a document are sorted by: their ids, not their text."""
    return F.array(*columns).alias("key")


def number(weight):
    """A weight as text: whole numbers without a fraction."""
    return F.when(weight == F.floor(weight), F.floor(weight).cast("string")).otherwise(weight.cast("string"))


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, line): a DOT line for each node and edge; a document has them in the order of part and key."""
    q = lambda c: F.concat(F.lit('"'), escape_dot(c), F.lit('"'))
    hidden = F.when((F.col("type") == "symbol") & ~F.col("exported"), ',style="filled,dashed"').otherwise("")
    n = nodes.select(F.lit(0).alias("part"), _key("id"), F.concat(
        F.lit("  "), q(F.col("id")), F.lit(" [label="), q(F.col("label")), F.lit(",shape="), _lookup(NODE_SHAPE, F.col("type"), OTHER_SHAPE), F.lit(',style="filled",fillcolor="'),
        _lookup(NODE_FILL, F.col("type"), OTHER_FILL), F.lit('",color="#30363d",tooltip='), q(F.coalesce("path", "label")), hidden, F.lit("];"),
    ).alias("line"))
    style = lambda k: _lookup({t: s[k] for t, s in EDGE_STYLE.items()}, F.col("type"), OTHER_STYLE[k])
    e = edges.select(F.lit(1), _key("src", "dst", "type"), F.concat(
        F.lit("  "), q(F.col("src")), F.lit(" -> "), q(F.col("dst")), F.lit(" [label="), q(F.col("type")), F.lit(',color="'), style(0), F.lit('",style="'), style(1),
        F.lit('",penwidth='), F.format_string("%.1f", F.coalesce("weight", F.lit(1.0))), F.lit("];"),
    ))
    return n.union(e)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, line): a GraphML element for each node and edge; edges are numbered in order."""
    data = lambda k, c: F.when(c.isNotNull(), F.concat(F.lit(f'      <data key="{k}">'), escape_xml(c), F.lit("</data>\n"))).otherwise(F.lit(""))
    n = nodes.select(F.lit(0).alias("part"), _key("id"), F.concat(
        F.lit('    <node id="'), escape_xml(F.col("id")), F.lit('">\n'), data("d_label", F.col("label")), data("d_type", F.col("type")), data("d_path", F.col("path")),
        data("d_kind", F.col("kind")), data("d_lang", F.col("lang")), data("d_exported", F.col("exported").cast("string")), F.lit("    </node>"),
    ).alias("line"))
    e = number_rows(edges, ["src", "dst", "type"]).select(F.lit(1), _key("src", "dst", "type"), F.concat(
        F.lit('    <edge id="e'), F.col("k").cast("string"), F.lit('" source="'), escape_xml(F.col("src")), F.lit('" target="'), escape_xml(F.col("dst")), F.lit('">\n'),
        data("d_etype", F.col("type")), data("d_weight", number(F.col("weight"))), F.lit("    </edge>"),
    ))
    return n.union(e)


def file_list(files: DataFrame, with_score: bool = True) -> DataFrame:
    """(path, line): list lines, with the score if asked for."""
    line = F.concat(F.lit("- "), F.col("path"))
    return files.select("path", (F.concat(line, F.format_string(" [score=%.4f]", "score")) if with_score else line).alias("line"))


def write_lines(lines: DataFrame, path: str, head: str, tail: str) -> None:
    """One local text file from (part, key, line), for documents that one reader opens."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(head)
        for row in lines.orderBy("part", "key").select("line").toLocalIterator():
            out.write(row["line"] + "\n")
        out.write(tail)


def write_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    head = 'digraph G {\n  rankdir=LR;\n  bgcolor="#0d1117";\n  node [fontname="Helvetica",fontsize=10,fontcolor="#e6edf3"];\n  edge [fontname="Helvetica",fontsize=8,fontcolor="#8b949e"];\n\n'
    write_lines(dot(nodes, edges), path, head, "}\n")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    keys = [("d_label", "node", "label", "string"), ("d_type", "node", "type", "string"), ("d_path", "node", "path", "string"), ("d_kind", "node", "kind", "string"), ("d_lang", "node", "lang", "string"), ("d_exported", "node", "exported", "boolean"), ("d_etype", "edge", "type", "string"), ("d_weight", "edge", "weight", "double")]
    declared = "".join(f'  <key id="{k}" for="{of}" attr.name="{name}" attr.type="{t}"/>\n' for k, of, name, t in keys)
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n{declared}  <graph id="G" edgedefault="directed">\n'
    write_lines(graphml(nodes, edges), path, head, "  </graph>\n</graphml>\n")
