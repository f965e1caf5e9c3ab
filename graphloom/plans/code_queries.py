"""Registered queries of the operators that read code, over the literal source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import shortstat_delta
from ..operators import building, extraction, guardrails, ranking, rollups, semantics
from ..sources import scan
from .fixtures import CONFIG, DOCUMENTS_PER_TREE, code_files
from .session import settle


def _lines(spark, sf_dir):
    return extraction.lines(code_files(spark, sf_dir))


def _specs(c):
    text = F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["name"], s["imported"]))
    return F.array_join(text, ",")


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.declarations(_lines(spark, sf_dir))


def heritage(spark, sf_dir):
    return extraction.heritage(_lines(spark, sf_dir)).select("path", "line_no", "kind", "child", "parent")


def imports(spark, sf_dir):
    return extraction.imports(_lines(spark, sf_dir)).select("path", "line_no", "source", _specs("specifiers").alias("specifiers"))


def calls(spark, sf_dir):
    return extraction.calls(_lines(spark, sf_dir))


def references(spark, sf_dir):
    return extraction.references(_lines(spark, sf_dir))


def likely_endpoints(spark, sf_dir):
    return code_files(spark, sf_dir).select("path", extraction.likely_endpoint(F.col("path")).alias("likely"))


def endpoints(spark, sf_dir):
    return extraction.endpoints(code_files(spark, sf_dir))


def workspace_aliases(spark, sf_dir):
    return scan.workspace_aliases(code_files(spark, sf_dir), code_files(spark, sf_dir))


def front_matter(spark, sf_dir):
    found = scan.front_matter(code_files(spark, sf_dir).filter("path like 'docs/skills/%'"))
    return found.select("path", "name", "description", F.array_join("domains", ",").alias("domains"), "always_apply")


def _graph(spark, sf_dir):
    files = settle(code_files(spark, sf_dir))
    return building.build_graph(files, True, True, scan.workspace_aliases(files, files), scan.path_aliases(CONFIG))


def _imported(files):
    return building.imported_files(files, scan.workspace_aliases(files, files), scan.path_aliases(CONFIG))


def resolved_imports(spark, sf_dir):
    return _imported(settle(code_files(spark, sf_dir))).select("path", "target")


def build_nodes(spark, sf_dir):
    return _graph(spark, sf_dir).nodes.select("id", "type", "label", "kind", F.coalesce(F.col("exported").cast("string"), F.lit("")).alias("exported"))


def build_edges(spark, sf_dir):
    return _graph(spark, sf_dir).edges


def build_stats(spark, sf_dir):
    return _graph(spark, sf_dir).stats()


def fragment_reuse(spark, sf_dir):
    """A second build, with the fragments of a first one in which a third of the files differed."""
    files = settle(code_files(spark, sf_dir))
    changed = F.length("path") % 3 == 0
    first = building.build_graph(files.withColumn("content", F.when(changed, F.concat("content", F.lit("\n"))).otherwise(F.col("content"))))
    again = building.build_graph(files, True, True, scan.workspace_aliases(files, files), scan.path_aliases(CONFIG), building.parse_fragments(files.filter("kind in ('code', 'test') and length(path) % 3 <> 0").withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))).union(first.fragments.filter("length(path) % 3 = 0")))
    return again.cached.union(again.edges.agg(F.count("*").alias("n")).select(F.lit("edges"), "n"))


def parse_status(spark, sf_dir):
    """Files, some of which can't be read."""
    f = code_files(spark, sf_dir)
    broken = f.withColumn("content", F.when(F.length("path") % 4 != 0, F.col("content")))
    found = extraction.parse_files(broken)
    return found.select("path", "ok", "language", "engine", "reason", F.size("captures").alias("n_captures"))


def semantic_domains(spark, sf_dir):
    return semantics.domains(code_files(spark, sf_dir))


def semantic_layers(spark, sf_dir):
    return semantics.layers(code_files(spark, sf_dir))


def _semantic(spark, sf_dir):
    files = settle(code_files(spark, sf_dir))
    imported = settle(_imported(files))
    return files, semantics.detect(files, imported), imported


def _semantic_graph(spark, sf_dir):
    files, p, imported = _semantic(spark, sf_dir)
    return files, semantics.semantic_nodes(files, p.domain, p.layer, p.endpoints, p.flow), semantics.semantic_edges(p.domain, p.layer, p.endpoints, p.flow, imported)


def semantic_flows(spark, sf_dir):
    flow = _semantic(spark, sf_dir)[1].flow
    return flow.select("flow_id", "domain", "label", "entry", F.array_join(F.transform("steps", lambda s: F.concat(s["layer"], F.lit("="), s["file"])), ",").alias("steps"))


def semantic_nodes(spark, sf_dir):
    return _semantic_graph(spark, sf_dir)[1]


def semantic_edges(spark, sf_dir):
    return _semantic_graph(spark, sf_dir)[2]


def semantic_map(spark, sf_dir):
    _, nodes, edges = _semantic_graph(spark, sf_dir)
    return rollups.semantic_map(nodes, settle(edges))


def architecture(spark, sf_dir):
    files, nodes, edges = _semantic_graph(spark, sf_dir)
    return rollups.architecture(nodes, edges, files.filter("path like 'src/users/%'"))


def concepts(spark, sf_dir):
    """In each of many domains, two groups of four files that import each other, joined by one edge."""
    trees = max(1, spark.read.parquet(f"{sf_dir}/documents.parquet").count() // DOCUMENTS_PER_TREE)
    rows = [(f"{g}{i}.ts", f"{g}{j}.ts") for g in "ab" for i in range(4) for j in range(4) if i != j] + [("a0.ts", "b0.ts")]
    pairs = spark.range(trees).crossJoin(F.broadcast(spark.createDataFrame(rows, "a string, b string"))).withColumn("domain", F.concat(F.lit("shop"), F.col("id").cast("string")))
    at = lambda c: F.concat(F.lit("src/"), "domain", F.lit("/"), c).alias("path")
    imported = pairs.select(at("a"), at("b").alias("target"))
    domain = pairs.select("domain", at("a")).union(pairs.select("domain", at("b"))).distinct()
    return semantics.concepts(domain, imported)


def enrichment_targets(spark, sf_dir):
    return ranking.enrichment_targets(_graph(spark, sf_dir).nodes, 12).select("id", "kind", "priority")


def manifest_entries(spark, sf_dir):
    skills = scan.front_matter(code_files(spark, sf_dir).filter("path like 'docs/skills/%'")).withColumn("is_skill", F.lit(True)).select("path", "name", "domains", "always_apply", "is_skill")
    more = spark.createDataFrame([("docs/skills/ctx.md", "ctx-packages-app", [], False, True), ("docs/rules/r.md", "ctx-packages-app", [], False, False), ("docs/skills/other.md", "domain-none", [], False, True)], "path string, name string, domains array<string>, always_apply boolean, is_skill boolean")
    packed = spark.createDataFrame([("packages/app/src/app.ts",), ("src/users/users.service.ts",)], "path string")
    return rollups.manifest(skills.union(more), packed)


def health_report(spark, sf_dir):
    rows = [("scan", 1_000_000, True, "a", "b", None, None), ("graph", 4_000_000, True, "a", "a", None, 0), ("pack", None, True, None, None, None, None), ("plan", 0, False, None, None, 9051, 10_000), ("old", 0, True, None, None, 9, 30)]
    return rollups.health(spark.createDataFrame(rows, "name string, mtime_ms long, watched boolean, graph_hash string, scan_hash string, tokens long, budget long"), 5_000_000)


def skill_coverage(spark, sf_dir):
    domains = spark.createDataFrame([("packages/core",), ("packages/app",), ("src",)], "domain string")
    return rollups.skill_coverage(domains, spark.createDataFrame([(" Core",), ("SRC",), ("",)], "tag string"))


def shortstat(spark, sf_dir):
    rows = [(1, " 3 files changed, 10 insertions(+), 2 deletions(-)"), (2, " 1 file changed, 1 insertion(+)"), (3, "")]
    return spark.createDataFrame(rows, "id int, text string").select("id", shortstat_delta(F.col("text")).alias("delta"))


def scaffold_lint(spark, sf_dir):
    rows = [("proposal.md", "## Intent\n"), ("tasks.md", "- do it\n"), ("specs/core/spec.md", "### Requirement: a\n"), ("specs/app/spec.md", "## ADDED Requirements\n### Requirement: a\n#### Scenario: b\n"), ("specs/old/spec.md", "## ADDED Requirements\n- The system MUST\n")]
    return guardrails.lint_scaffold(spark.createDataFrame(rows, "name string, content string"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", None) == __name__ and not k.startswith("_")}
