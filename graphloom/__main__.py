"""Command line over one project: python -m graphloom VERB [options]."""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import structural_domain
from .operators import building, changes, exporting, guardrails, packing, ranking, rendering, rollups, semantics, subgraph, validation, viewing
from .plans.session import local_session, settle
from .sources import scan


class Project:
    """A project's stored tables: scan, nodes, edges and pack, as Parquet below a folder."""

    def __init__(self, spark: SparkSession, root: str, store: str | None = None):
        self.spark, self.root = spark, os.path.abspath(root)
        self.store = store or os.path.join(self.root, ".graphloom")

    def path(self, name: str) -> str:
        return f"{self.store}/{name}"

    def _fs(self, name: str):
        """The file system of a stored table, and a maker of its paths; any that Spark can open."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        found = at(self.path(name))
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def read(self, name: str, needed: bool = True) -> DataFrame | None:
        """A stored table; None if it may be missing and is."""
        fs, at = self._fs(name)
        # a write that was cut short left the table under its old name
        for found in (self.path(name), self.path(name) + ".old"):
            if fs.exists(at(found)):
                return self.spark.read.parquet(found)
        if needed:
            raise FileNotFoundError(f"no {name} table yet: run the verb that makes it")
        return None

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Replace a table; it may be made from the one it replaces, and one of the two is there at any time."""
        new, now, old = self.path(name) + ".new", self.path(name), self.path(name) + ".old"
        df.write.mode("overwrite").parquet(new)
        fs, at = self._fs(name)
        if fs.exists(at(now)):
            fs.delete(at(old), True)
            fs.rename(at(now), at(old))
        fs.rename(at(new), at(now))
        fs.delete(at(old), True)
        return self.spark.read.parquet(now)

    def write_texts(self, texts: dict[str, str], below: str = ".") -> list[str]:
        """Texts by path below the project; what is there already stays."""
        made = []
        for name, text in texts.items():
            full = os.path.join(self.root, below, name)
            if not os.path.exists(full):
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "w", encoding="utf-8") as out:
                    out.write(text)
                made.append(os.path.relpath(full, self.root))
        return made

    def contents(self, paths: DataFrame | None = None) -> DataFrame:
        """(path, kind, size, hash, content) of scanned files, or of some paths."""
        listed = self.read("scan").select("path", "kind", "size", "hash")
        if paths is not None:
            listed = listed.join(paths.select("path").distinct(), "path", "left_semi")
        return scan.read_contents(listed, self.root).withColumn("content", F.decode("content", "utf-8"))

    def entries(self) -> DataFrame:
        """Skills and rules of the project, as manifests take them."""
        files = self.contents(self.read("scan").filter("path like 'agents/skills/%' or path like 'agents/rules/%'"))
        return scan.front_matter(files).select("path", "name", "domains", "always_apply", F.col("path").startswith("agents/skills/").alias("is_skill"))

    def scan(self) -> DataFrame:
        previous = self.read("scan", needed=False)
        found = self.write("scan", scan.scan_project(self.spark, self.root, previous).filter(~F.col("path").startswith(os.path.basename(self.store) + "/")))
        validation.validate_or_raise(found, "scan", "path")
        return found

    def graph(self, calls: bool = False, references: bool = False, semantic: bool = True, with_concepts: bool = False, force: bool = False) -> bool:
        """Build nodes and edges; False if the scan and the options are those of the last build."""
        scanned = self.read("scan")
        options = f"{calls},{references},{semantic},{with_concepts}"
        state = scanned.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "path", "hash"))), "\n"), 256).alias("scan_hash")).withColumn("options", F.lit(options))
        last = self.read("build", needed=False)
        if last is not None and not force and [tuple(r) for r in last.collect()] == [tuple(r) for r in state.collect()]:
            return False
        files = self.contents()
        config = os.path.join(self.root, "tsconfig.json")
        rules = scan.path_aliases(open(config, encoding="utf-8").read()) if os.path.isfile(config) else None
        before = self.read("fragments", needed=False)
        before = before if before is not None else self.spark.createDataFrame([], building.parse_fragments(files.limit(0)).schema)
        made = building.build_graph(files, calls, references, scan.workspace_aliases(files, files), rules, before)
        nodes, edges = made.nodes, made.edges
        if semantic or with_concepts:
            p = semantics.detect(files, made.imported)
            more = semantics.semantic_nodes(files, p.domain, p.layer, p.endpoints, p.flow).select("id", "type", "label", F.col("detail").alias("kind"))
            nodes = nodes.unionByName(more, allowMissingColumns=True)
            edges = edges.unionByName(semantics.semantic_edges(p.domain, p.layer, p.endpoints, p.flow, made.imported))
            if with_concepts:
                found = semantics.concepts(p.domain, made.imported)
                nodes = nodes.unionByName(found.select(F.col("concept_id").alias("id"), F.lit("concept").alias("type"), F.col("head").alias("label"), F.col("domain").alias("kind")), allowMissingColumns=True)
        self.write("nodes", nodes)
        self.write("edges", edges)
        self.write("fragments", made.fragments)
        self.write("build", state)
        return True

    def manifest(self, paths: DataFrame) -> DataFrame:
        return rollups.manifest(self.entries(), paths).join(self.entries().select("path", "is_skill"), "path")

    def spec(self, change_id: str, task: str, budget: int = 12000) -> list[str]:
        """Scaffold a change from the last pack: its documents, prompt and frozen subgraph."""
        nodes, edges, packed = self.read("nodes"), self.read("edges"), self.read("pack")
        spec = json.loads(rendering.spec_input(nodes, edges, packed, change_id, task, budget))
        kept = packed.filter("mode <> 'excluded'").select("path")
        quoted = packing.with_content(packed, self.contents(kept)).filter("mode = 'excerpt'").select("path", "shown").collect()
        texts = {**rendering.change_scaffold(spec), "spec-input.json": json.dumps(spec, indent=2) + "\n", "spec.md": rendering.spec_text(spec), "prompt.md": rendering.spec_prompt(spec, {r["path"]: r["shown"] for r in quoted})}
        made = self.write_texts(texts, f"changes/{change_id}")
        self.freeze(self.spark.createDataFrame([(change_id, [f["path"] for f in spec["affectedFiles"]], "compact")], "change_id string, focus array<string>, mode string"))
        return made

    def freeze(self, stored: DataFrame | None = None) -> DataFrame:
        """New subgraphs of the stored changes and of `stored`: (change_id, state)."""
        known = self.read("changes", needed=False)
        if known is not None:
            stored = known if stored is None else known.join(stored, "change_id", "left_anti").unionByName(stored)
        if stored is None:
            return self.spark.createDataFrame([], "change_id string, state string")
        stored = settle(stored)
        graphs, state = changes.refresh(stored, self.read("nodes"), self.read("edges"))
        self.write("change_nodes", graphs.nodes.select("change_id", "id", "type"))
        self.write("change_edges", graphs.edges)
        self.write("changes", stored)
        return state

    def context(self, task: str, budget: int, seeds: list[str]) -> DataFrame:
        scanned = self.read("scan")
        nodes = self.read("nodes").join(scanned.select(F.concat(F.lit("file:"), "path").alias("id"), "hash"), "id", "left")
        return self.write("pack", ranking.select_context(nodes, self.read("edges"), scanned.select("path", "size"), budget, seeds=seeds, task=task))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("--root", default=".")
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("scan", help="list and hash the files")
    g = verbs.add_parser("graph", help="build nodes and edges")
    for flag in ("--with-calls", "--with-refs", "--no-semantic", "--concepts", "--force"):
        g.add_argument(flag, action="store_true")
    c = verbs.add_parser("context", help="pack the best files for a task")
    c.add_argument("task")
    c.add_argument("--budget", type=int, default=12000)
    c.add_argument("--seed", action="append", default=[])
    c.add_argument("--content", action="store_true", help="show what the pack holds of each file")
    i = verbs.add_parser("init", help="scan, build and pack in one go")
    i.add_argument("task", nargs="?", default="get to know the project")
    b = verbs.add_parser("spec", help="scaffold a change from the last pack")
    b.add_argument("change")
    b.add_argument("--task", default="")
    m = verbs.add_parser("implement", help="the plan of the last pack, or of a change")
    m.add_argument("change", nargs="?")
    m.add_argument("--approve", action="store_true")
    verbs.add_parser("docs", help="scaffold a documentation tree")
    verbs.add_parser("manifest", help="which skills and rules the last pack needs").add_argument("change", nargs="?")
    verbs.add_parser("impact", help="ages, staleness and coverage of the stored tables")
    verbs.add_parser("status", help="what is stored, and the changes")
    verbs.add_parser("refresh", help="new subgraphs of all changes")
    verbs.add_parser("archive", help="drop a change, rebuild, and refresh the others").add_argument("change")
    verbs.add_parser("rebuild", help="scan and build for a hook: reports, and never fails")
    verbs.add_parser("viz", help="what a viewer loads, as JSON lines").add_argument("out")
    n = verbs.add_parser("neighbors", help="what is next to a file")
    n.add_argument("path")
    verbs.add_parser("domains", help="the map of domains")
    s = verbs.add_parser("subgraph", help="what lies around some files")
    s.add_argument("focus", nargs="+")
    s.add_argument("--depth", type=int, default=1)
    s.add_argument("--mode", choices=["compact", "full"], default="compact")
    k = verbs.add_parser("check", help="check changed files against the pack's plan")
    k.add_argument("--since", default="HEAD")
    k.add_argument("--forbid", action="append", default=[])
    e = verbs.add_parser("export", help="write the graph as a document")
    e.add_argument("out")
    verbs.add_parser("skills", help="describe each domain")
    y = verbs.add_parser("sync", help="what a change makes stale")
    y.add_argument("--since", default="HEAD")
    return p


def show(df: DataFrame) -> int:
    df.show(200, truncate=False)
    return 0


def _plan(p: Project, change: str | None) -> DataFrame:
    """The plan of the pack, within a change's focus if one is named."""
    focus = None
    if change is not None:
        focus = p.read("changes").filter(F.col("change_id") == changes.check_name(change)).select(F.explode("focus").alias("path"))
    return guardrails.derive_plan(p.read("pack"), focus)


def _stamps(p: Project) -> DataFrame:
    """(name, mtime_ms, counts, value) of the stored tables."""
    rows = []
    for name in ("scan", "nodes", "edges", "pack", "plan"):
        fs, at = p._fs(name)
        there = fs.exists(at(p.path(name)))
        rows.append((name, fs.getFileStatus(at(p.path(name))).getModificationTime() if there else None, {"rows": p.read(name).count()} if there else None, None))
    return p.spark.createDataFrame(rows, "name string, mtime_ms long, counts map<string,long>, value string")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a verb; 2 means that a check failed."""
    a = parser().parse_args(argv)
    p = Project(spark or local_session(), a.root)
    now = int(time.time() * 1000)
    if a.verb == "scan":
        return show(p.scan().groupBy("kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")))
    if a.verb == "graph":
        if not p.graph(a.with_calls, a.with_refs, not a.no_semantic, a.concepts, a.force):
            print("nothing changed since the last build")
        return show(p.read("edges").groupBy("type").count())
    if a.verb == "rebuild":
        try:
            p.scan()
            print("rebuilt" if p.graph() else "nothing changed")
        except Exception as problem:  # noqa: BLE001 - a hook must not stop what called it
            print(f"not rebuilt: {problem}")
        return 0
    if a.verb == "archive":
        known = p.read("changes").filter(F.col("change_id") != changes.check_name(a.change))
        p.write("changes", settle(known))
        p.scan()
        p.graph()
        return show(p.freeze())
    if a.verb == "init":
        p.scan()
        p.graph()
        return show(p.context(a.task, 12000, []).groupBy("mode").count())
    if a.verb == "context":
        packed = p.context(a.task, a.budget, a.seed)
        print(rendering.pack_document(packed, a.task, a.budget))
        if a.content:
            for r in packing.with_content(packed, p.contents(packed)).orderBy(F.desc("score"), "path").toLocalIterator():
                print(f"### {r['path']}\n{rendering.fenced(r['shown']) if r['shown'] is not None else 'could not be read'}\n")
        return show(packing.token_ledger(p.read("scan").filter("kind in ('code', 'test')"), packed))
    if a.verb == "status":
        show(changes.artifact_status(_stamps(p), now))
        stored = p.read("change_nodes", needed=False)
        return 0 if stored is None else show(changes.ChangeGraphs(stored, p.read("change_edges")).totals())
    if a.verb == "impact":
        stamps = _stamps(p).select("name", "mtime_ms", F.lit(True).alias("watched"), F.lit(None).cast("string").alias("graph_hash"), F.lit(None).cast("string").alias("scan_hash"))
        show(rollups.health(stamps, now))
        tags = p.entries().filter("is_skill").select(F.explode("domains").alias("tag"))
        return show(rollups.skill_coverage(rollups.file_domains(p.read("nodes")).select("domain").distinct(), tags))
    nodes, edges = p.read("nodes"), p.read("edges")
    if a.verb == "spec":
        print("\n".join(p.spec(changes.check_name(a.change), a.task or f"Change {a.change}")))
        return 0
    if a.verb == "refresh":
        return show(p.freeze())
    if a.verb == "implement":
        stored = p.read("plan", needed=False)
        if a.approve:
            status = guardrails.approve(p.read("plan").first()["status"])
            return show(p.write("plan", settle(stored).withColumn("status", F.lit(status))))
        plan = _plan(p, a.change).withColumn("status", F.lit("plan_only"))
        validation.validate_or_raise(plan, "plan", "path")
        return show(p.write("plan", settle(plan)))
    if a.verb == "viz":
        shown, kept = viewing.visible(nodes, edges, p.read("pack").filter("mode <> 'excluded'"))
        viewing.payload(shown, kept).select("line").write.mode("overwrite").text(a.out)
        return 0
    if a.verb == "docs":
        print("\n".join(p.write_texts(rendering.docs_scaffold(nodes, edges, os.path.basename(p.root)))))
        return 0
    if a.verb == "manifest":
        paths = p.read("pack").filter("mode <> 'excluded'") if a.change is None else p.read("changes").filter(F.col("change_id") == changes.check_name(a.change)).select(F.explode("focus").alias("path"))
        found = settle(p.manifest(paths))
        domains = [r[0] for r in paths.select(structural_domain(F.col("path"))).distinct().collect()]
        print("\n".join(p.write_texts(rendering.agent_files(found, a.change or "the last pack", domains))))
        return show(found)
    if a.verb == "neighbors":
        found = rollups.neighbors(nodes, edges, a.path).orderBy("section", "item")
        if found.isEmpty():
            print("no such file in the graph; similar ones:")
            found = rollups.similar_paths(nodes, a.path)
        return show(found)
    if a.verb == "domains":
        return show(rollups.domain_map(nodes, edges).orderBy("domain"))
    if a.verb == "subgraph":
        found = subgraph.change_subgraph(nodes, edges, a.focus, a.depth, a.mode)
        print(rendering.change_context(a.focus, found.stats(), "change"))
        return show(found.nodes.select("id", "type").orderBy("id"))
    if a.verb == "export":
        (exporting.write_graphml if a.out.endswith(".graphml") else exporting.write_dot)(nodes, edges, a.out)
        return 0
    if a.verb == "skills":
        print("\n".join(rendering.skill_texts(nodes, edges).values()))
        return 0
    changed = p.spark.createDataFrame([(x,) for x in scan.changed_files(p.root, a.since)], "path string")
    if a.verb == "sync":
        return show(rollups.sync_report(changed, p.read("pack"), None, None))
    plan = guardrails.derive_plan(p.read("pack")).collect()
    bad = guardrails.validate_guardrails(changed, scan.loc_delta(p.root, a.since), [r["path"] for r in plan], a.forbid, plan[0]["max_loc"] if plan else 1, plan[0]["max_files"] if plan else 2)
    show(bad)
    return 2 if bad.count() else 0


if __name__ == "__main__":
    raise SystemExit(main())
