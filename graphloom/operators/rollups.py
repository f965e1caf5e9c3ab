"""Rollups per domain, dependency maps, reports, and the queries on a node's neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import skill_slug
from ..functions.paths import structural_domain, sub_folder

#: Rows up to which a table is broadcast, by count; beyond, a shuffled join.
BROADCAST_ROWS = 100_000

SHOWN_CODE, SHOWN_TESTS, MIN_FILES = 8, 5, 2


def file_domains(nodes: DataFrame) -> DataFrame:
    """(id, path, kind, domain) of file nodes, by their place in the tree."""
    return nodes.filter("type = 'file' and path is not null").select("id", "path", "kind", structural_domain(F.col("path")).alias("domain"))


def domain_kinds(nodes: DataFrame) -> DataFrame:
    """(domain, kind, n_files)."""
    return file_domains(nodes).groupBy("domain", "kind").agg(F.count("*").alias("n_files"))


def domain_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_domain, to_domain, type) of every edge between files of two domains."""
    of = file_domains(nodes)
    src, dst = of.select(F.col("id").alias("src"), F.col("domain").alias("from_domain")), of.select(F.col("id").alias("dst"), F.col("domain").alias("to_domain"))
    return edges.join(src, "src").join(dst, "dst").filter("from_domain <> to_domain").select("from_domain", "to_domain", "type")


def domain_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_domain, to_domain, imports, tests): edges between domains."""
    kinds = domain_edges(nodes, edges).filter(F.col("type").isin("imports", "tests"))
    n = lambda t: F.count(F.when(F.col("type") == t, 1)).alias(t)
    return kinds.groupBy("from_domain", "to_domain").agg(n("imports"), n("tests"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) over both ends of all edges."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def domain_skills(nodes: DataFrame, edges: DataFrame, min_files: int = MIN_FILES, shown: int = SHOWN_CODE, tests: int = SHOWN_TESTS) -> DataFrame:
    """(domain, section, place, path, degree): the busiest files of each domain that has enough."""
    files = file_domains(nodes).join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    section = F.when(F.col("kind") == "test", "tests").otherwise("code")
    sized = files.withColumn("n", F.count("*").over(Window.partitionBy("domain"))).filter(F.col("n") >= min_files).withColumn("section", section)
    ranked = sized.withColumn("place", F.row_number().over(Window.partitionBy("domain", "section").orderBy(F.desc("degree"), "path")).cast("long"))
    return ranked.filter(F.col("place") <= F.when(F.col("section") == "tests", tests).otherwise(shown)).select("domain", "section", "place", "path", "degree")


def skill_index(nodes: DataFrame, min_files: int = MIN_FILES) -> DataFrame:
    """(domain, slug, n_files, skipped, reason) for each domain."""
    n = file_domains(nodes).groupBy("domain").agg(F.count("*").alias("n_files"))
    few = F.col("n_files") < min_files
    why = F.when(few, F.concat(F.lit("only "), F.col("n_files").cast("string"), F.when(F.col("n_files") == 1, " file").otherwise(" files"), F.lit(f" (< {min_files})")))
    return n.select("domain", skill_slug(F.col("domain")).alias("slug"), "n_files", few.alias("skipped"), why.alias("reason"))


def top_domain(paths: DataFrame, default: str = "core") -> DataFrame:
    """The domain most paths are in, the first seen among equals; paths: (path, ord)."""
    best = paths.groupBy(structural_domain(F.col("path")).alias("domain")).agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first").limit(1)
    return best.agg(F.coalesce(F.max("domain"), F.lit(default)).alias("domain"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def cross_domain_deps(nodes: DataFrame, edges: DataFrame, domain: str) -> DataFrame:
    """(direction, other, n): imports between one domain and each other."""
    met = domain_edges(nodes, edges.filter("type = 'imports'")).filter((F.col("from_domain") == domain) | (F.col("to_domain") == domain))
    out = F.col("from_domain") == domain
    return met.groupBy(F.when(out, "depends_on").otherwise("used_by").alias("direction"), F.when(out, F.col("to_domain")).otherwise(F.col("from_domain")).alias("other")).agg(F.count("*").alias("n"))


def architecture(nodes: DataFrame, edges: DataFrame, affected: DataFrame) -> DataFrame:
    """(part, id, label, file): domains, endpoints and flows that affected files (path) take part in."""
    parts = {"belongs_to_domain": "domain", "exposes_endpoint": "endpoint", "implements_flow": "flow"}
    ids = affected.select(F.concat(F.lit("file:"), "path").alias("src")).distinct()
    met = edges.filter(F.col("type").isin(list(parts))).join(ids, "src", "left_semi").groupBy("type", "dst").agg(F.min("src").alias("src"))
    named = met.join(nodes.select(F.col("id").alias("dst"), "label"), "dst")
    part = F.element_at(F.create_map(*(F.lit(x) for kv in parts.items() for x in kv)), F.col("type"))
    return named.select(part.alias("part"), F.col("dst").alias("id"), "label", F.when(F.col("type") == "exposes_endpoint", F.regexp_replace("src", "^file:", "")).alias("file"))


# -- reports ----------------------------------------------------------------


def health(artifacts: DataFrame, now_ms: int | Column, stale_minutes: int = 60) -> DataFrame:
    """(name, present, age_minutes, warning) for (name, mtime_ms, watched, graph_hash, scan_hash[, tokens, budget]).

    With tokens and budget there is budget_used too, in percent; more than 90 is a warning.
    """
    budgeted = {"tokens", "budget"} <= set(artifacts.columns)
    used = F.when(F.col("budget") > 0, F.round(F.col("tokens") / F.col("budget") * 100, 1)) if budgeted else F.lit(None).cast("double")
    full = F.when(used > 90, F.concat(F.lit("budget at "), used.cast("string"), F.lit("%")))
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    age = F.greatest(F.lit(0), F.floor((now - F.col("mtime_ms")) / 60000 + 0.5)).cast("long")
    gone = F.col("mtime_ms").isNull()
    stale = F.when(F.col("watched") & (age > stale_minutes), F.concat(F.lit("stale ("), age.cast("string"), F.lit("m old)")))
    differs = F.when(F.col("graph_hash") != F.col("scan_hash"), F.lit("hash mismatch with scan"))
    warning = F.when(gone, F.concat("name", F.lit(" missing"))).otherwise(F.nullif(F.concat_ws("; ", stale, differs, full), F.lit("")))
    return artifacts.select("name", (~gone).alias("present"), age.alias("age_minutes"), warning.alias("warning"), *([used.alias("budget_used")] if budgeted else []))


def tag_covers(tag: Column, domain: Column) -> Column:
    """Whether a skill's tag covers a domain: by name, with or without packages/, or as a wildcard."""
    t, d = F.lower(F.trim(tag)), F.lower(domain)
    return (t != "") & (t.isin("all", "all-domains", "*") | (t == d) | (d == F.concat(F.lit("packages/"), t)) | (t == F.concat(F.lit("packages/"), d)))


def skill_coverage(domains: DataFrame, tags: DataFrame) -> DataFrame:
    """(domain, covered): domains (domain) met by any tag (tag)."""
    tags = tags.distinct()
    if tags.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hit = domains.join(F.broadcast(tags), tag_covers(F.col("tag"), F.col("domain")), "left_semi")
    else:
        # the same rule by equal keys, so that any number of tags can be shuffled
        both = lambda c: F.explode(F.array(c, F.concat(F.lit("packages/"), c)))
        tag = F.lower(F.trim("tag"))
        keys = tags.filter(tag != "").select(both(tag).alias("key")).distinct()
        every = tags.filter(tag.isin("all", "all-domains", "*")).limit(1)
        hit = domains.select("domain", both(F.lower("domain")).alias("key")).join(keys, "key", "left_semi").select("domain").union(domains.select("domain").join(F.broadcast(every), F.lit(True), "left_semi"))
    hit = hit.select("domain").withColumn("hit", F.lit(True))
    return domains.distinct().join(hit.distinct(), "domain", "left").select("domain", F.coalesce("hit", F.lit(False)).alias("covered"))


def sync_report(changed: DataFrame, packed: DataFrame, graph_hash: str | None, scan_hash: str | None) -> DataFrame:
    """One row: changed files by domain, staleness, whether the pack is affected, advice."""
    files = changed.filter("path is not null and path <> ''")
    by = files.groupBy(structural_domain(F.col("path")).alias("domain")).agg(F.count("*").alias("n"))
    domains = by.agg(F.array_sort(F.collect_list(F.concat("domain", F.lit("="), F.col("n").cast("string")))).alias("domains"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_changed"))
    touched = packed.join(files, "path", "left_semi").agg((F.count("*") > 0).alias("pack_affected"))
    stale = F.lit(bool(graph_hash and scan_hash and graph_hash != scan_hash))
    advice = F.array_compact(F.array(
        F.when(F.col("graph_stale"), "rebuild graph"), F.when(F.col("pack_affected"), "rebuild context"),
        F.when(F.col("n_changed") == 0, "nothing changed").when(~F.col("graph_stale") & ~F.col("pack_affected"), "artifacts are current"),
    ))
    return domains.crossJoin(touched).withColumn("graph_stale", stale).withColumn("advice", advice)


def manifest(entries: DataFrame, packed: DataFrame, prefixes: tuple[str, ...] = ("domain-", "ctx-")) -> DataFrame:
    """(path, name, matched, match_type, reason) of skills and rules for the packed files.

    entries: (path, name, domains, always_apply, is_skill). Always-apply comes
    first, then the entry's own domains, then, for skills without any, the domain
    that the name spells.
    """
    touched = packed.agg(F.array_sort(F.collect_set(structural_domain(F.col("path")))).alias("touched"))
    return match_entries(entries.crossJoin(F.broadcast(touched)), [], prefixes).drop("globs")


def match_entries(met: DataFrame, keys: list[str], prefixes: tuple[str, ...] = ("domain-", "ctx-")) -> DataFrame:
    """(keys, path, name, matched, match_type, reason, globs) of entries beside the domains touched.

    globs are the patterns of a rule's own domains that are touched, where they made
    it match.
    """
    own = F.coalesce("domains", F.array().cast("array<string>"))
    hit = F.get(F.filter(own, lambda d: F.array_contains("touched", d)), F.lit(0))
    spelled = F.replace(F.regexp_extract("name", f"^(?:{'|'.join(prefixes)})(.+)$", 1), F.lit("-"), F.lit("/"))
    by_name = F.when((F.size(own) == 0) & F.col("is_skill") & (spelled != "") & F.array_contains("touched", spelled), spelled)
    kind = F.when(F.col("always_apply"), "alwaysApply").when(hit.isNotNull(), "domain").when(by_name.isNotNull(), "explicit")
    reason = F.when(F.col("always_apply"), "skill marked alwaysApply").when(F.coalesce(hit, by_name).isNotNull(), F.concat(F.lit("task touches "), F.coalesce(hit, by_name))).otherwise("domain not touched")
    globs = F.when((kind == "domain") & ~F.col("is_skill"), F.array_sort(F.transform(F.filter(own, lambda d: F.array_contains("touched", d)), lambda d: F.concat(d, F.lit("/**")))))
    return met.select(*keys, "path", "name", kind.isNotNull().alias("matched"), kind.alias("match_type"), reason.alias("reason"), globs.alias("globs"))


# -- neighbourhoods ----------------------------------------------------------

SECTIONS = ("imports", "imported_by", "tests", "tested_by", "defines", "same_domain", "same_layer", "exposes_endpoint", "flows_participating", "other")


def neighbors(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """(section, item): what is next to a file in the graph, by kind of relation."""
    me = f"file:{path}"
    out = edges.filter(F.col("src") == me).select(F.col("dst").alias("id"), "type", F.lit("out").alias("dir"))
    into = edges.filter((F.col("dst") == me) & (F.col("src") != me)).select(F.col("src").alias("id"), "type", F.lit("in").alias("dir"))
    # a node is listed at its first relation: outgoing ones come first
    found = out.union(into).filter(F.col("id") != me)
    peers = None
    for kind, section in (("belongs_to_domain", "same_domain"), ("in_layer", "same_layer")):
        groups = edges.filter((F.col("src") == me) & (F.col("type") == kind)).select("dst").distinct()
        one = edges.filter((F.col("type") == kind) & (F.col("src") != me)).join(groups, "dst", "left_semi").select(F.col("src").alias("id"), F.lit(section).alias("section"))
        peers = one if peers is None else peers.union(one)
    t, d = F.col("type"), F.col("dir")
    section = (
        F.when((t == "imports") & (d == "out"), "imports").when(t == "imports", "imported_by").when((t == "tests") & (d == "out"), "tests").when(t == "tests", "tested_by")
        .when(t == "defines", "defines").when(t == "exposes_endpoint", "exposes_endpoint").when(t == "implements_flow", "flows_participating").when(t.isin("belongs_to_domain", "in_layer"), None).otherwise("other")
    )
    all_ = found.select("id", section.alias("section"), "type").union(peers.select("id", "section", F.lit(None).cast("string")))
    label = nodes.select("id", "path", "label", *(c for c in ("method", "framework") if c in nodes.columns)).dropDuplicates(["id"])
    named = all_.filter("section is not null").join(label, "id", "left")
    plain = F.coalesce("path", F.regexp_replace("id", "^file:", ""))
    endpoint = F.concat(F.coalesce("method", F.lit("?")), F.lit(" "), F.coalesce("path", F.lit("?")), F.coalesce(F.concat(F.lit(" ["), "framework", F.lit("]")), F.lit(""))) if "method" in nodes.columns else plain
    item = F.when(F.col("section") == "exposes_endpoint", endpoint).when(F.col("section") == "flows_participating", F.concat("label", F.lit(" ("), "id", F.lit(")"))).when(F.col("section") == "other", F.concat(F.lit("["), "type", F.lit("] "), plain)).otherwise(plain)
    return named.select("section", item.alias("item")).distinct()


def similar_paths(nodes: DataFrame, path: str, most: int = 5) -> DataFrame:
    """Paths that hold a missing file's base name (a short list)."""
    base = path.rsplit("/", 1)[-1]
    return nodes.filter((F.col("type") == "file") & F.col("path").contains(base)).select("path").orderBy("path").limit(most)


def domain_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain, n_files, n_code, n_tests, imports_out, imports_in): the map of domains."""
    n = lambda k, name: F.count(F.when(F.col("kind") == k, 1)).alias(name)
    own = file_domains(nodes).groupBy("domain").agg(F.count("*").alias("n_files"), n("code", "n_code"), n("test", "n_tests"))
    cross = domain_edges(nodes, edges.filter("type = 'imports'"))
    out, into = cross.groupBy(F.col("from_domain").alias("domain")).agg(F.count("*").alias("imports_out")), cross.groupBy(F.col("to_domain").alias("domain")).agg(F.count("*").alias("imports_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(out, "domain", "left").join(into, "domain", "left").select("domain", "n_files", "n_code", "n_tests", zero("imports_out"), zero("imports_in"))


def flow_steps(nodes: DataFrame, edges: DataFrame, flow_id: str) -> DataFrame:
    """(step_id, ord, file, layer): a flow's steps in order; the id may lack its prefix."""
    flow = flow_id if flow_id.startswith("flow:") else f"flow:{flow_id}"
    steps = edges.filter((F.col("type") == "flow_step") & (F.col("src") == flow)).select(F.col("dst").alias("id"))
    return nodes.filter("type = 'step'").join(steps, "id", "left_semi").select(F.col("id").alias("step_id"), "ord", "file", "layer")


def edge_panel(edges: DataFrame, shown: int = 6) -> DataFrame:
    """(id, dir, n, more, first): for each node and direction its first neighbours and how many follow."""
    ends = edges.select(F.col("src").alias("id"), F.lit("out").alias("dir"), F.col("dst").alias("other"), "type").union(edges.select("dst", F.lit("in"), "src", "type"))
    total = ends.groupBy("id", "dir").agg(F.count("*").alias("n"))
    # the filter on the rank is applied before the shuffle too, so a hub sends a few neighbours from each task
    ranked = ends.withColumn("k", F.row_number().over(Window.partitionBy("id", "dir").orderBy("other", "type"))).filter(F.col("k") <= shown)
    first = ranked.groupBy("id", "dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "other"))), lambda x: x["other"]), ",").alias("first"))
    return total.join(first, ["id", "dir"]).select("id", "dir", "n", F.greatest(F.lit(0), F.col("n") - shown).alias("more"), "first")


def node_type_counts(edges: DataFrame) -> DataFrame:
    """(id, type, n_out, n_in)."""
    ends = edges.select(F.col("src").alias("id"), "type", F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", "type", F.lit(0), F.lit(1)))
    return ends.groupBy("id", "type").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def sidebar(nodes: DataFrame, packed: DataFrame) -> DataFrame:
    """(domain, folder, n_files, n_packed): the tree of folders per domain."""
    files = file_domains(nodes).join(packed.select("path", F.lit(1).alias("in_pack")).distinct(), "path", "left")
    folder = F.coalesce(sub_folder(F.col("path"), F.col("domain")), F.lit("(root)"))
    return files.groupBy("domain", folder.alias("folder")).agg(F.count("*").alias("n_files"), F.count("in_pack").alias("n_packed"))


def search_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose label or path holds a text, whatever its case."""
    low = text.lower()
    return nodes.filter(F.lower("label").contains(low) | F.lower("path").contains(low)).select("id", "label", "path")


def semantic_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain, n_files, n_layers, n_endpoints, n_flows) from semantic nodes and edges.

    An endpoint is in the domain of the first file that exposes it.
    """
    of = edges.filter("type = 'belongs_to_domain'").select("src", F.col("dst").alias("domain_id"))
    files = of.groupBy("domain_id").agg(F.count("*").alias("n_files"))
    layer = edges.filter("type = 'in_layer'").select("src", "dst").join(of, "src").groupBy("domain_id").agg(F.count_distinct("dst").alias("n_layers"))
    first = edges.filter("type = 'exposes_endpoint'").groupBy("dst").agg(F.min("src").alias("src")).join(of, "src").groupBy("domain_id").agg(F.count("*").alias("n_endpoints"))
    flow = nodes.filter("type = 'flow'").select(F.concat(F.lit("domain:"), F.regexp_extract("id", "^flow:([^/]*)/", 1)).alias("domain_id")).groupBy("domain_id").agg(F.count("*").alias("n_flows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    named = nodes.filter("type = 'domain'").select(F.col("id").alias("domain_id"), F.col("label").alias("domain"))
    return named.join(files, "domain_id", "left").join(layer, "domain_id", "left").join(first, "domain_id", "left").join(flow, "domain_id", "left").select("domain", zero("n_files"), zero("n_layers"), zero("n_endpoints"), zero("n_flows"))
