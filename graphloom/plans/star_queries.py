"""Registered queries over the star-schema and document tables, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, paths
from ..operators import changes, exporting, guardrails, packing, ranking, rendering, rollups, subgraph, validation, viewing
from ..sources import scan
from . import views
from .session import settle
from .views import table

TASK = "Fix the src1 billing import bug in src12"
ITERATIONS = 10
SEED_DOCS = (0, 2, 4)
FOCUS_DOCS = (0, 1, 4)
IGNORE = ["en/7*", "de", "fr/1"]
DOMAIN = "packages/src3"


def _paths_of(spark, sf_dir, ids):
    return [r[0] for r in views.files(spark, sf_dir).filter(F.col("doc_id").isin(list(ids))).select("path").orderBy("path").collect()]


def _edges(spark, sf_dir, semantic=True):
    """The view's edges, a join of three tables, made once for operators that read them several times."""
    return settle(views.edges(spark, sf_dir, semantic))


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://[^/?#]*/([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", p.alias("path"))


def scan_files(spark, sf_dir):
    return views.files(spark, sf_dir).select("path", "ext", "size", "hash", "kind", "lang")


def ignored_paths(spark, sf_dir):
    return url_paths(spark, sf_dir).select("page_id", "path", paths.ignored(F.col("path"), IGNORE).alias("ignored"))


def scan_cache(spark, sf_dir):
    f = views.files(spark, sf_dir).select("doc_id", "path", "size")
    at = F.col("doc_id") * 10
    now = f.filter("doc_id % 5 <> 0").select("path", "size", at.alias("mtime"), at.alias("ctime"))
    later = lambda k: at + F.when(F.col("doc_id") % k == 0, 1).otherwise(0)
    before = f.filter("doc_id % 3 <> 0").select("path", "size", later(4).alias("mtime"), later(7).alias("ctime"))
    return scan.merge_cache(now, before)


def graph_cache(spark, sf_dir):
    f = views.files(spark, sf_dir)
    fragments = f.filter("doc_id % 3 = 0").select("path", "hash", F.when(F.col("doc_id") % 2 == 0, "v2").otherwise("v1").alias("version"), F.lit(1).alias("captures"))
    reused, again = scan.reuse_fragments(f.select("path", "hash", "kind"), fragments, "v2")
    n = lambda df, s: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(s).alias("status"), "kind", "n")
    return n(reused, "reused").union(n(again, "reparsed"))


def constraint_violations(spark, sf_dir):
    f = views.files(spark, sf_dir)
    broken = f.select(F.when(F.col("doc_id") % 11 != 0, F.col("path")).alias("path"), F.when(F.col("doc_id") % 13 == 0, -1).otherwise(F.col("size")).alias("size"), F.when(F.col("doc_id") % 17 == 0, F.substring("hash", 1, 10)).otherwise(F.col("hash")).alias("hash"), F.when(F.col("doc_id") % 19 == 0, "other").otherwise(F.col("kind")).alias("kind"), "doc_id")
    return validation.violations(broken, validation.SCHEMAS["scan"], "doc_id")


def event_constraints(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"), "value", "event_type")
    return validation.violations(e, [validation.Rule("k", True, at_least=10, at_most=90), validation.Rule("value", True, at_least=0)], "event_id").groupBy("column", "problem").agg(F.count("*").alias("n"))


def folder_nodes(spark, sf_dir):
    folders, _ = views.folder_edges(views.files(spark, sf_dir).select("path"))
    return folders


def folder_contains(spark, sf_dir):
    _, contains = views.folder_edges(url_paths(spark, sf_dir).filter("path <> ''").select("path").distinct())
    return contains


def test_edges(spark, sf_dir):
    from ..operators.building import test_edges as found

    f = views.files(spark, sf_dir).select("path")
    impl = f.select(F.regexp_replace("path", r"\.test\.ts$", ".ts").alias("path"))
    return found(f.union(impl).distinct())


def edge_stats(spark, sf_dir):
    e = views.edges(spark, sf_dir)
    return e.groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def domain_kinds(spark, sf_dir):
    return rollups.domain_kinds(views.nodes(spark, sf_dir))


def domain_relations(spark, sf_dir):
    return rollups.domain_relations(views.nodes(spark, sf_dir), views.edges(spark, sf_dir))


def domain_skills(spark, sf_dir):
    return rollups.domain_skills(views.nodes(spark, sf_dir), views.edges(spark, sf_dir))


def skill_index(spark, sf_dir):
    return rollups.skill_index(views.nodes(spark, sf_dir), 50)


def top_domain(spark, sf_dir):
    return rollups.top_domain(views.files(spark, sf_dir).select("path", F.col("doc_id").alias("ord")))


def cross_domain_deps(spark, sf_dir):
    return rollups.cross_domain_deps(views.nodes(spark, sf_dir), views.edges(spark, sf_dir), DOMAIN)


def degrees(spark, sf_dir):
    return rollups.degrees(views.edges(spark, sf_dir))


def pagerank(spark, sf_dir):
    n = views.nodes(spark, sf_dir).filter("type = 'file' and kind in ('code', 'test')")
    return ranking.pagerank(n, views.edges(spark, sf_dir, False), iterations=ITERATIONS, tolerance=0).select("id", F.round("rank", 6).alias("rank"))


def personalized_pagerank(spark, sf_dir):
    n = views.nodes(spark, sf_dir).filter("type = 'file' and kind in ('code', 'test')")
    seeds = [f"file:{p}" for p in _paths_of(spark, sf_dir, SEED_DOCS)]
    return ranking.pagerank(n, views.edges(spark, sf_dir, False), seeds, iterations=ITERATIONS, tolerance=0).select("id", F.round("rank", 6).alias("rank"))


def pagerank_by_joins(spark, sf_dir):
    """The distributed plan of the same operator, that graphs beyond one task take."""
    n = views.nodes(spark, sf_dir).filter("type = 'file' and kind in ('code', 'test')")
    return ranking.pagerank(n, views.edges(spark, sf_dir, False), iterations=3, tolerance=0, local_limit=0).select("id", F.round("rank", 6).alias("rank"))


def bfs_distances(spark, sf_dir):
    n = views.nodes(spark, sf_dir).filter("type = 'file'")
    seeds = views.files(spark, sf_dir).filter(F.col("doc_id").isin(list(SEED_DOCS))).select(F.concat(F.lit("file:"), "path").alias("id"))
    return ranking.bfs(n, views.edges(spark, sf_dir, False), seeds, 2)


def keywords(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(names.keywords(F.coalesce("text", F.lit("")))).alias("w")).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("w").alias("n_distinct"))


def matched_domains(spark, sf_dir):
    return ranking.matched_domains(views.nodes(spark, sf_dir), TASK)


def scored_files(spark, sf_dir):
    f = views.files(spark, sf_dir)
    best = ranking.score_files(views.nodes(spark, sf_dir), views.edges(spark, sf_dir), f.select("path", "size"), task=TASK, iterations=ITERATIONS, candidates=200)
    return best.select("path", F.round("score", 6).alias("score"), "tokens")


def context_pack(spark, sf_dir):
    """The flagship: rank the files, and pack the best into the budget."""
    f = views.files(spark, sf_dir)
    packed = ranking.select_context(views.nodes(spark, sf_dir), views.edges(spark, sf_dir), f.select("path", "size"), 8000, task=TASK, iterations=ITERATIONS)
    return packed.select("path", F.round("score", 6).alias("score"), "mode", "reason", "tokens", "estimated")


def _packs(spark, sf_dir):
    """Many packs at once: files of a source, scored by their number."""
    f = views.files(spark, sf_dir)
    return f.select(F.col("source").alias("pack_id"), "path", ((F.col("doc_id") * 7919) % 1009).cast("double").alias("score"), ranking.estimated_tokens(F.col("size")).alias("tokens"), (F.col("doc_id") % 31 == 0).alias("is_seed"), "hash")


def packer(spark, sf_dir):
    return packing.pack(_packs(spark, sf_dir), F.conv(F.substring(F.md5("pack_id"), 1, 4), 16, 10).cast("long") % 12000).select("pack_id", "path", "mode", "reason", "estimated")


def _context(spark, sf_dir):
    """The flagship pack, settled, as several queries start from it."""
    f = views.files(spark, sf_dir)
    return settle(ranking.select_context(views.nodes(spark, sf_dir), views.edges(spark, sf_dir), f.select("path", "size"), 8000, task=TASK, iterations=ITERATIONS))


def token_ledger(spark, sf_dir):
    return packing.token_ledger(views.files(spark, sf_dir), _context(spark, sf_dir))


def context_content(spark, sf_dir):
    """The pack with what it shows of each file."""
    f = views.files(spark, sf_dir).select("doc_id", "path")
    contents = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")).join(f, "doc_id")
    shown = packing.with_content(_context(spark, sf_dir), contents)
    return shown.select("path", "mode", F.length("shown").alias("n_chars"), F.sha2(F.col("shown").cast("binary"), 256).alias("shown_sha256"))


def change_nodes(spark, sf_dir):
    s = subgraph.change_subgraph(views.nodes(spark, sf_dir), _edges(spark, sf_dir, False), _paths_of(spark, sf_dir, FOCUS_DOCS), 2)
    return s.nodes.select("id", "type")


def change_edges(spark, sf_dir):
    s = subgraph.change_subgraph(views.nodes(spark, sf_dir), _edges(spark, sf_dir, False), _paths_of(spark, sf_dir, FOCUS_DOCS), 1)
    return s.edges


def change_stats(spark, sf_dir):
    return subgraph.change_subgraph(views.nodes(spark, sf_dir), _edges(spark, sf_dir), _paths_of(spark, sf_dir, FOCUS_DOCS), 1).stats()


def topological_tiers(spark, sf_dir):
    """Regions, nations and suppliers as a hierarchy, with a cycle beside it."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    e = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).union(s.select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey")))
    e = e.union(spark.createDataFrame([("x", "y"), ("y", "x"), ("y", "z")], "src string, dst string"))
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return subgraph.topological_tiers(ids, e)


def guardrail_violations(spark, sf_dir):
    changed = url_paths(spark, sf_dir).filter("path <> ''").select("path").distinct()
    return guardrails.validate_guardrails(changed, 1200, ["en/**", "fr/?*", "de/1*"], ["**/*.html", "en/9*"], 1000, 50)


def plan_tasks(spark, sf_dir):
    focus = views.files(spark, sf_dir).filter("doc_id % 2 = 0").select("path")
    return guardrails.derive_plan(_context(spark, sf_dir), focus)


def neighbors(spark, sf_dir):
    n, e = views.nodes(spark, sf_dir), _edges(spark, sf_dir)
    return rollups.neighbors(n, e, _paths_of(spark, sf_dir, [20])[0])


def domain_map(spark, sf_dir):
    return rollups.domain_map(views.nodes(spark, sf_dir), views.edges(spark, sf_dir))


def flow_steps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    flow = F.concat(F.lit("flow:"), F.col("conv_id").cast("string"))
    step = F.concat(F.lit("step:"), flow, F.lit("#"), F.col("turn").cast("string"))
    nodes = c.select(step.alias("id"), F.lit("step").alias("type"), F.col("turn").alias("ord"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("file"), F.col("role").alias("layer"))
    edges = c.select(flow.alias("src"), step.alias("dst"), F.lit("flow_step").alias("type"))
    return rollups.flow_steps(nodes, edges, "7")


def edge_panel(spark, sf_dir):
    return rollups.edge_panel(views.edges(spark, sf_dir))


def node_type_counts(spark, sf_dir):
    return rollups.node_type_counts(views.edges(spark, sf_dir))


def sidebar(spark, sf_dir):
    packed = views.files(spark, sf_dir).filter("doc_id % 9 = 0").select("path")
    return rollups.sidebar(views.nodes(spark, sf_dir), packed)


def search_nodes(spark, sf_dir):
    return rollups.search_nodes(views.nodes(spark, sf_dir), "DOC_1")


def sync_report(spark, sf_dir):
    f = views.files(spark, sf_dir)
    r = rollups.sync_report(f.filter("doc_id % 10 = 0").select("path"), f.filter("doc_id % 15 = 0").select("path"), "a", "b")
    return r.select(F.array_join("domains", ",").alias("domains"), "n_changed", "pack_affected", "graph_stale", F.array_join("advice", ",").alias("advice"))


def dot_lines(spark, sf_dir):
    return exporting.dot(views.nodes(spark, sf_dir), views.edges(spark, sf_dir)).select("part", "line")


def graphml_lines(spark, sf_dir):
    return exporting.graphml(views.nodes(spark, sf_dir), views.edges(spark, sf_dir)).select("part", "line")


def file_list(spark, sf_dir):
    return exporting.file_list(_packs(spark, sf_dir).select("path", (F.col("score") / 1009).alias("score")))


def name_shapes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.concat_ws("_", F.regexp_replace("p_name", " ", "Xy"), "p_brand")
    n = names
    return p.select(
        "p_partkey", n.slugify(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"), n.camel_to_kebab(raw).alias("kebab"), n.title_case(F.concat_ws("-", "p_name", "p_type")).alias("title"),
        n.purpose(F.concat(F.lit("src/"), F.regexp_replace("p_type", " ", "/"), F.when(F.col("p_size") % 2 == 0, "/index.ts").otherwise("/SomeHTTPFile.py"))).alias("purpose"),
        n.endpoint_slug(F.when(F.col("p_size") % 3 == 0, "CLI").otherwise("GET"), F.concat(F.lit("/"), F.lower("p_brand"), F.lit("/:id/{x}"))).alias("endpoint"),
        n.escape_html(F.concat(F.lit("<i>"), "p_name", F.lit("&"))).alias("html"), n.domain_of_slug(n.skill_slug(F.concat_ws("/", "p_type", "p_brand"))).alias("domain"), n.domain_colour(F.col("p_name"))["border"].alias("colour"),
        n.escape_xml(F.concat(F.lit("<a b='"), "p_name", F.lit("'>&\""))).alias("xml"), n.escape_dot(F.concat(F.lit('a"\\'), "p_name")).alias("dot"),
    )


def url_shapes(spark, sf_dir):
    u = url_paths(spark, sf_dir)
    p = F.col("path")
    return u.select("page_id", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"), paths.extname(p).alias("ext"), paths.normalize(F.concat(F.lit("a/./b/../"), p, F.lit("/../x"))).alias("normal"), paths.structural_domain(p).alias("domain"), paths.sub_folder(F.concat(F.lit("packages/p/"), p), F.lit("packages/p")).alias("sub"))


def type_counts(spark, sf_dir):
    """What each source holds, by kind, as text; kinds of one file are left out."""
    f = views.files(spark, sf_dir)
    n = f.groupBy("source", "kind").agg(F.count("*").cast("int").alias("n")).filter("n > 1")
    maps = n.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("counts"))
    none = F.create_map().cast("map<string,int>")
    return f.select("source").distinct().join(maps, "source", "left").select("source", names.type_counts(F.coalesce("counts", none)).alias("counts"))


def spec_parts(spark, sf_dir):
    n, e = views.nodes(spark, sf_dir), _edges(spark, sf_dir)
    return rendering.spec_parts(n, e, _context(spark, sf_dir), 8000)


def _entries(spark):
    rows = [("s/a.md", "a", ["packages/src1", "packages/src2"], False, True), ("s/b.md", "domain-packages-src3", [], False, True), ("s/c.md", "always", None, True, True), ("r/d.md", "d", ["packages/src2", "packages/src0", "other"], False, False), ("r/e.md", "ctx-packages-src1", [], False, False)]
    return spark.createDataFrame(rows, "path string, name string, domains array<string>, always_apply boolean, is_skill boolean")


def select_agent_context(spark, sf_dir):
    """Which skills and rules a task needs: the pack's domains decide."""
    return rollups.manifest(_entries(spark), _context(spark, sf_dir).filter("mode <> 'excluded'"))


def _focus(spark, sf_dir):
    """Some files of each language are a change; every other change is a full one."""
    f = views.files(spark, sf_dir).filter("doc_id % 40 = 1")
    return f.select(F.concat(F.lit("change-"), "lang_code").alias("change_id"), "path", F.when(F.col("lang_code").isin("de", "fr"), "full").otherwise("compact").alias("mode"))


def change_graph_stats(spark, sf_dir):
    return changes.change_subgraphs(views.nodes(spark, sf_dir), _edges(spark, sf_dir), _focus(spark, sf_dir), 1).stats()


def change_refresh(spark, sf_dir):
    """Stored changes with new subgraphs; one has no focus."""
    stored = _focus(spark, sf_dir).groupBy("change_id").agg(F.collect_list("path").alias("focus"), F.max("mode").alias("mode"))
    stored = stored.union(spark.createDataFrame([("empty", [], None), ("none", None, "full")], "change_id string, focus array<string>, mode string"))
    graphs, state = changes.refresh(stored, views.nodes(spark, sf_dir), _edges(spark, sf_dir, False))
    return state.join(graphs.totals(), "change_id", "left")


def change_manifests(spark, sf_dir):
    found = changes.change_manifests(_entries(spark), _focus(spark, sf_dir))
    return found.withColumn("globs", F.array_join("globs", ","))


def artifact_status(spark, sf_dir):
    f, e = views.files(spark, sf_dir), views.edges(spark, sf_dir)
    known = f.agg(F.count("*").alias("n")).select(F.lit("scan").alias("name"), F.lit(1_000_000).cast("long").alias("mtime_ms"), F.create_map(F.lit("files"), "n").alias("counts"), F.lit(None).cast("string").alias("value"))
    n = views.nodes(spark, sf_dir).agg(F.count("*").alias("nodes")).crossJoin(e.agg(F.count("*").alias("edges")))
    graph = n.select(F.lit("graph"), F.lit(4_000_000).cast("long"), F.create_map(F.lit("nodes"), "nodes", F.lit("edges"), "edges"), F.lit(None).cast("string"))
    plan = spark.createDataFrame([("plan", 4_900_000, None, "status: plan_only"), ("pack", None, None, None)], "name string, mtime_ms long, counts map<string,long>, value string")
    return changes.artifact_status(known.union(graph).union(plan), 5_000_000)


def _some_packed(spark, sf_dir):
    return views.files(spark, sf_dir).filter("doc_id % 9 = 0").select("path", F.lit("seed").alias("reason"), F.lit("full").alias("mode"))


def visible_nodes(spark, sf_dir):
    return viewing.visible(views.nodes(spark, sf_dir), views.edges(spark, sf_dir), _some_packed(spark, sf_dir))[0]


def visible_edges(spark, sf_dir):
    """With packed files only."""
    return viewing.visible(views.nodes(spark, sf_dir), views.edges(spark, sf_dir), _some_packed(spark, sf_dir), pack_only=True)[1]


def legend_counts(spark, sf_dir):
    return viewing.legend_counts(views.nodes(spark, sf_dir), views.edges(spark, sf_dir), _some_packed(spark, sf_dir))


def closed_neighbourhood(spark, sf_dir):
    return viewing.closed_neighbourhood(views.edges(spark, sf_dir), "domain:src2")


def file_summaries(spark, sf_dir):
    return viewing.file_summaries(views.nodes(spark, sf_dir), views.edges(spark, sf_dir))


def group_leaves(spark, sf_dir):
    return viewing.group_leaves(views.nodes(spark, sf_dir))


def viewer_payload(spark, sf_dir):
    n, e = views.nodes(spark, sf_dir), views.edges(spark, sf_dir)
    return viewing.payload(n.select("id", "type"), e.select("src", "dst", "type"))


def artifact_constraints(spark, sf_dir):
    """A plan, a spec and a ledger with rows that break their schemas."""
    f = views.files(spark, sf_dir)
    k = F.col("doc_id")
    plan = f.select("doc_id", F.when(k % 5 == 0, 0).otherwise(k + 1).alias("task"), F.when(k % 7 != 0, F.col("path")).alias("path"), (k % 3).alias("max_loc"), F.lit(2).alias("max_files"), F.when(k % 11 == 0, "done").otherwise("plan_only").alias("status"))
    spec = f.select("doc_id", F.when(k % 13 == 0, "Bad Id").otherwise("some-change").alias("change_id"), "path", F.lit("seed").alias("reason"), F.when(k % 17 == 0, "half").otherwise("full").alias("mode"), F.lit("").alias("domain"))
    n = lambda df, name: validation.violations(df, validation.SCHEMAS[name], "doc_id").groupBy("column", "problem").agg(F.count("*").alias("n")).select(F.lit(name).alias("artifact"), "column", "problem", "n")
    return n(plan, "plan").union(n(spec, "spec"))


QUERIES = {
    k: v for k, v in globals().items()
    if callable(v) and getattr(v, "__module__", None) == __name__ and not k.startswith("_") and k not in ("url_paths",)
}
