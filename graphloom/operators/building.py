"""Building a code graph: nodes and edges from what the extractors found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname, language, normalize
from ..plans.session import settle
from . import extraction
from .ranking import default_weight

# What is tried, in order, to find the file of an import.
#: Rows up to which a table is broadcast, by count; beyond, a shuffled join.
BROADCAST_ROWS = 100_000
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")
EXTERNAL = r"(?i)^(@[a-z0-9][\w.-]*/)?[a-z0-9][\w.-]*"


#: What the extractors' results depend on beside a file's content; raise it when they change.
PARSER_VERSION = "1"


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    imported: DataFrame  # (path, target, ord): resolved imports of each file
    fragments: DataFrame  # what was found in each file, to be given to the next build
    cached: DataFrame  # (status, n): files reused and reparsed

    def stats(self) -> DataFrame:
        by = lambda df, part: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "type", "n")
        return by(self.nodes, "node").union(by(self.edges, "edge"))


def _node(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"id": "string", "type": "string", "label": "string", "path": "string", "kind": "string", "lang": "string", "exported": "boolean", "line": "int"}
    return df.select(*(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


def _edge(df: DataFrame, src: Column, dst: Column, kind: str | Column) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"))


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_id(path: Column, name: Column) -> Column:
    return F.concat(F.lit("symbol:"), path, F.lit("#"), name)


def _first_existing(tried: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target): for each key the first of its candidates (base, rank) that is a file."""
    each = tried.select(*keys, "rank", F.posexplode(F.array(*(F.concat("base", F.lit(s)) for s in SUFFIXES))).alias("place", "target"))
    each = each.withColumn("target", F.regexp_replace("target", "^/+", ""))
    known = paths.select(F.col("path").alias("target")).distinct()
    return each.join(known, "target", "left_semi").groupBy(*keys).agg(F.min_by("target", F.struct("rank", "place")).alias("target"))


def resolve_imports(paths: DataFrame, imports: DataFrame, aliases: DataFrame | None = None, rules: list[dict] | None = None) -> DataFrame:
    """imports with the file that each one means, or null.

    A workspace alias (name, path) decides first, then configured path aliases for
    non-relative sources, then relative candidates.
    """
    keys = ["path", "source"]
    asked = imports.select(*keys).distinct()
    relative = asked.filter("source like '.%'").select(*keys, F.lit(0).alias("rank"), normalize(F.concat(dirname(F.col("path")), F.lit("/"), "source")).alias("base"))
    tried = relative
    for r, rule in enumerate(rules or []):
        fits = F.col("source").startswith(rule["prefix"]) & F.col("source").endswith(rule["suffix"]) if rule["wildcard"] else F.col("source") == rule["prefix"]
        held = F.expr(f"substring(source, {len(rule['prefix']) + 1}, length(source) - {len(rule['prefix']) + len(rule['suffix'])})")
        for t, target in enumerate(rule["targets"]):
            head, star, tail = target.partition("*")
            filled = F.concat(F.lit(rule["base"] + "/" + head), held, F.lit(tail)) if star else F.lit(rule["base"] + "/" + target)
            tried = tried.union(asked.filter(~F.col("source").startswith(".") & fits).select(*keys, F.lit(1 + r * 100 + t), normalize(filled)))
    found = _first_existing(tried, paths, keys)
    out = imports.join(found, keys, "left")
    if aliases is None:
        return out
    named = aliases.select(F.col("name").alias("source"), F.col("path").alias("aliased"))
    few = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return out.join(F.broadcast(named) if few else named, "source", "left").withColumn("target", F.coalesce("aliased", "target")).drop("aliased")


def test_edges(paths: DataFrame) -> DataFrame:
    """Edges from test files to the file that their name is made of."""
    bare = F.regexp_replace("path", r"\.(?:test|spec)\.(ts|tsx|js|jsx)$", ".$1")
    tests = paths.select("path", bare.alias("impl")).filter("impl <> path")
    known = paths.select(F.col("path").alias("impl")).distinct()
    return _edge(tests.join(known, "impl", "left_semi"), file_id(F.col("path")), file_id(F.col("impl")), "tests")


def external(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of packages and of the names imported from them."""
    open_ = resolved.filter(F.col("target").isNull() & ~F.col("source").rlike("^[./]") & F.col("source").rlike(EXTERNAL))
    parts = F.split("source", "/")
    named = open_.withColumn("package", F.when(F.col("source").startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0]))
    package = F.concat(F.lit("package:"), "package")
    used = named.select("path", "line_no", "package", F.posexplode("specifiers").alias("ord", "s")).filter("s.kind <> 'namespace'")
    export = F.when(F.col("s.kind") == "default", "default").otherwise(F.coalesce("s.imported", "s.name"))
    used = used.select("path", "line_no", "ord", "package", export.alias("export"), "s.kind")
    symbol = F.concat(F.lit("external-symbol:"), "package", F.lit("#"), "export")
    # what kind a name is, the first file and line that imports it says
    first = used.groupBy("package", "export").agg(F.min_by("kind", F.struct("path", "line_no", "ord")).alias("kind"))
    nodes = _node(named.select("package").distinct(), id=package, type=F.lit("package"), label=F.col("package"), kind=F.lit("external"))
    nodes = nodes.union(_node(first, id=symbol, type=F.lit("external-symbol"), label=F.col("export"), path=F.col("package"), kind=F.col("kind")))
    edges = _edge(named, file_id(F.col("path")), package, "imports").union(_edge(used, file_id(F.col("path")), symbol, "imports"))
    return nodes, edges.distinct()


def resolve_names(wanted: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """wanted (path, name, ...) with target: the symbol that a name means in its file.

    The file's own symbols come first, then those of the files that it imports, in
    the order of its imports. Names that mean nothing are dropped.
    """
    known = symbols.select("path", "name").distinct()
    asked = wanted.select("path", "name").distinct()
    own = asked.join(known, ["path", "name"], "left_semi").select("path", "name", F.lit(-1).alias("ord"), F.col("path").alias("home"))
    far = asked.join(imported.select("path", F.col("target").alias("home"), "ord"), "path").join(known.withColumnRenamed("path", "home"), ["home", "name"], "left_semi").select("path", "name", "ord", "home")
    best = own.union(far).groupBy("path", "name").agg(F.min_by("home", F.struct("ord", "home")).alias("home"))
    return wanted.join(best, ["path", "name"]).withColumn("target", symbol_id(F.col("home"), F.col("name"))).drop("home")


def parse_fragments(code: DataFrame, names: bool = True) -> DataFrame:
    """What the extractors find in code files (path, hash, content), as rows of one table.

    part says what a row is: file (one for each), symbol, import, heritage and, with
    `names`, call and reference.
    """
    found = extraction.everything(extraction.lines(code, "hash"), names)
    return code.select("path", "hash", F.lit("file").alias("part")).unionByName(found, allowMissingColumns=True).withColumn("version", F.lit(PARSER_VERSION))


def _fragments(files: DataFrame, before: DataFrame | None, names: bool) -> tuple[DataFrame, DataFrame]:
    """(fragments of all code files, (status, n)); those of unchanged files come from `before`."""
    held = files if "hash" in files.columns else files.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
    code = held.filter("kind in ('code', 'test')").select("path", "hash", "content")
    count = lambda df, status: df.agg(F.count("*").alias("n")).select(F.lit(status).alias("status"), "n")
    if before is None:
        found = settle(parse_fragments(code, names))
        return found, count(found.filter("part = 'file'"), "reparsed").union(count(found.filter("false"), "reused"))
    # what is given may be a plan: it is worked out once
    good = settle(before.filter(F.col("version") == PARSER_VERSION).join(code.select("path", "hash"), ["path", "hash"], "left_semi"))
    todo = code.join(good.filter("part = 'file'").select("path", "hash"), ["path", "hash"], "left_anti")
    fresh = settle(parse_fragments(todo))
    return good.unionByName(fresh), count(fresh.filter("part = 'file'"), "reparsed").union(count(good.filter("part = 'file'"), "reused"))


def imported_files(files: DataFrame, aliases: DataFrame | None = None, rules: list[dict] | None = None) -> DataFrame:
    """(path, target, ord) as Graph.imported has it, for those who need no more: nothing but imports is looked for."""
    code = files.filter("kind in ('code', 'test')").select("path", "content")
    return _imported(resolve_imports(files.select("path"), settle(extraction.imports(extraction.lines(code))), aliases, rules))


def _imported(resolved: DataFrame) -> DataFrame:
    return resolved.filter("target is not null").groupBy("path", "target").agg(F.min("line_no").alias("ord"))


def build_graph(files: DataFrame, with_calls: bool = False, with_references: bool = False, aliases: DataFrame | None = None, rules: list[dict] | None = None, fragments: DataFrame | None = None) -> Graph:
    """The structural graph of files (path, kind, content[, hash]).

    fragments is the table of an earlier build: files whose path, content hash and
    parser version are in it are not parsed again.
    """
    from ..plans.views import folder_edges

    paths = files.select("path")
    found, cached = _fragments(files, fragments, with_calls or with_references or fragments is not None)
    symbols = found.filter("part = 'symbol'").select("path", "line_no", "kind", "name", "exported")
    resolved = settle(resolve_imports(paths, found.filter("part = 'import'").select("path", "line_no", "source", "specifiers"), aliases, rules))
    imported = settle(_imported(resolved))
    parents = found.filter("part = 'heritage'").select("path", "line_no", "ord", "kind", "child", "parent")
    lang = language(F.col("path"))
    nodes = _node(files, id=file_id(F.col("path")), type=F.lit("file"), label=basename(F.col("path")), path=F.col("path"), kind=F.col("kind"), lang=lang)
    nodes = nodes.union(_node(symbols, id=symbol_id(F.col("path"), F.col("name")), type=F.lit("symbol"), label=F.col("name"), path=F.col("path"), kind=F.col("kind"), lang=lang, exported=F.col("exported"), line=F.col("line_no")))
    more, external_edges = external(resolved)
    folders, contains = folder_edges(paths)
    nodes = nodes.union(more).union(_node(folders, id=F.col("id"), type=F.lit("folder"), label=basename(F.col("path")), path=F.col("path")))
    edges = _edge(symbols, file_id(F.col("path")), symbol_id(F.col("path"), F.col("name")), "defines").distinct()
    edges = edges.union(_edge(imported, file_id(F.col("path")), file_id(F.col("target")), "imports")).union(external_edges)
    edges = edges.union(test_edges(paths).distinct()).union(_edge(contains, F.col("src"), F.col("dst"), "contains"))
    # names of all relations are looked up together: (path, name, child, type)
    wanted = parents.select("path", F.col("parent").alias("name"), "child", F.col("kind").alias("type"))
    called = found.filter("part = 'call'").select("path", "name").distinct()
    if with_calls:
        wanted = wanted.union(called.select("path", "name", F.lit(None), F.lit("calls")))
    if with_references:
        handled = called.union(parents.select("path", "parent")).distinct()
        rest = found.filter("part = 'reference'").select("path", "name").distinct().join(handled, ["path", "name"], "left_anti")
        wanted = wanted.union(rest.select("path", "name", F.lit(None), F.lit("references")))
    source = F.when(F.col("type").isin("calls", "references"), file_id(F.col("path"))).otherwise(symbol_id(F.col("path"), F.col("child")))
    edges = edges.union(_edge(resolve_names(wanted, symbols, imported), source, F.col("target"), F.col("type")).distinct())
    # each family is without repeats, and no two of them share a type and a kind of target
    edges = edges.withColumn("weight", default_weight(F.col("type")))
    return Graph(nodes, edges, imported, found, cached)
