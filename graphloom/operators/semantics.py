"""Domains, layers, flows and concepts of a code graph, and the nodes and edges they make."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import endpoint_slug, slugify
from ..functions.paths import ancestors, basename, dirname, segments
from ..plans.session import settle
from . import extraction
from .ranking import default_weight

# Folders that make no domain of their own, and files that mark an application.
SHARED = ["shared", "core", "common", "lib", "utils", "helpers", "internal", "vendor", "node_modules"]
APP_MARKERS = ["models.py", "router.py", "routers.py", "__init__.py"]

# Layer rules in order: (layer, kind, exact names, name suffixes, folders).
LAYERS = [
    ("controller", "backend", [], [".controller.ts", ".controller.js", ".controller.py"], ["controllers"]),
    ("service", "backend", [], [".service.ts", ".service.js", ".service.py"], ["services"]),
    ("repository", "backend", [], [".repository.ts", ".repository.js", ".repository.py", ".repo.ts", ".repo.js"], ["repositories", "repos"]),
    ("use-case", "backend", [], [".use-case.ts", ".usecase.ts", ".use_case.py"], ["use-cases", "usecases"]),
    ("model", "backend", [], [".model.ts", ".model.js", ".model.py", ".entity.ts"], ["models", "entities"]),
    ("dto", "backend", [], [".dto.ts", ".dto.js", ".dto.py"], ["dto", "dtos"]),
    ("guard", "backend", [], [".guard.ts", ".guard.js"], ["guards"]),
    ("middleware", "backend", [], [".middleware.ts", ".middleware.js", ".middleware.py"], ["middleware", "middlewares"]),
    ("module", "backend", [], [".module.ts", ".module.js"], []),
    ("route", "frontend", ["route.ts", "route.js"], [], []),
    ("page", "frontend", ["page.tsx", "page.jsx", "page.ts", "page.js"], [".page.tsx", ".page.jsx"], ["pages"]),
    ("layout", "frontend", ["layout.tsx", "layout.jsx", "layout.ts", "layout.js"], [], []),
    ("loading", "frontend", ["loading.tsx", "loading.jsx"], [], []),
    ("error", "frontend", ["error.tsx", "error.jsx", "global-error.tsx", "not-found.tsx"], [], []),
    ("template", "frontend", ["template.tsx", "template.jsx"], [], []),
    ("page", "frontend", [], [".astro"], []),
    ("component", "frontend", [], [".vue"], []),
    ("composable", "frontend", [], [], ["composables"]),
    ("component", "frontend", [], [".component.tsx", ".component.jsx", ".component.ts"], ["components"]),
    ("hook", "frontend", [], [".hook.ts", ".hook.tsx"], ["hooks"]),
    ("store", "frontend", [], [".store.ts", ".store.tsx"], ["stores"]),
    ("context", "frontend", [], [".context.tsx", ".context.ts"], ["contexts"]),
    ("reducer", "frontend", [], [".reducer.ts", ".slice.ts"], ["reducers", "slices"]),
    ("api-client", "frontend", [], [".client.ts", ".api.ts"], ["api-clients"]),
    ("middleware", "frontend", ["middleware.ts", "middleware.js"], [], []),
    ("util", "shared", [], [".util.ts", ".util.js", ".util.py", ".helper.ts"], ["utils", "helpers"]),
    ("schema", "shared", [], [".schema.ts", ".schema.js", ".schema.py", ".schema.json"], []),
    ("types", "shared", [], [".types.ts", ".type.ts", ".d.ts"], []),
]
NO_LAYER = ["service-worker.ts", "service-worker.js", "index.ts", "index.js", "main.ts", "main.js"]
TEST_NAME = r"\.(test|spec)\.(ts|tsx|js|jsx|py)$"
HOPS = 4


def _folder_domain(name: Column) -> Column:
    return F.when(name.isin(SHARED), "shared").otherwise(slugify(name))


def domains(files: DataFrame) -> DataFrame:
    """(path, domain) of code and test files (path, kind); the first rule that fits decides.

    Workspace package; nearest ancestor with a module file; python application
    folder; features/<name>; first folder below app that is no (group); leading
    folder.
    """
    code = files.filter("kind in ('code', 'test')").select("path").distinct()
    parts = segments(F.col("path"))
    at = lambda i: F.get(parts, F.lit(i))
    modules = files.filter(basename(F.col("path")).endswith(".module.ts")).select(dirname(F.col("path")).alias("folder")).distinct()
    near = code.select("path", F.explode(ancestors(F.col("path"))).alias("folder")).join(modules, "folder", "left_semi").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("module"))
    apps = files.filter((F.size(parts) >= 3) & at(0).isin("apps", "src") & basename(F.col("path")).isin(APP_MARKERS)).select(F.concat_ws("/", at(0), at(1)).alias("app")).distinct().withColumn("is_app", F.lit(True))
    x = code.withColumn("app", F.concat_ws("/", at(0), at(1))).join(near, "path", "left").join(apps, "app", "left")
    package = F.when((at(0) == "packages") & (F.size(parts) >= 2) & (at(1) != ""), slugify(at(1)))
    module = F.when(F.col("module").isNotNull(), _folder_domain(basename(F.col("module"))))
    python = F.when(F.col("is_app") & (F.size(parts) >= 2), _folder_domain(at(1)))
    f = F.array_position(parts, F.lit("features")).cast("int")
    feature = F.when(f > 0, F.get(parts, f))
    feature = F.when(feature.isNotNull() & ~feature.isin(SHARED), slugify(feature))
    a = F.array_position(parts, F.lit("app")).cast("int")
    below = F.filter(F.slice(parts, a + 1, F.greatest(F.lit(0), F.size(parts) - 1 - a)), lambda s: ~s.rlike(r"^\(.+\)$"))
    app = F.when(a > 0, F.get(below, F.lit(0)))
    app = F.when(app.isNotNull(), _folder_domain(app))
    plain = F.when((at(0) == "src") & (F.size(parts) >= 2) & (at(1) != ""), _folder_domain(at(1))).otherwise(_folder_domain(at(0)))
    filled = lambda c: F.nullif(c, F.lit(""))
    return x.select("path", F.coalesce(*map(filled, (package, module, python, feature, app)), plain).alias("domain"))


def layers(files: DataFrame) -> DataFrame:
    """(path, layer, layer_kind) of code files that a layer rule fits."""
    base, parts = basename(F.col("path")), segments(F.col("path"))
    found = None
    for layer, kind, exact, suffixes, folders in LAYERS:
        fits = F.lit(False)
        if exact:
            fits = fits | base.isin(exact)
        for s in suffixes:
            fits = fits | base.endswith(s)
        for s in folders:
            fits = fits | F.array_contains(parts, s)
        value = F.struct(F.lit(layer).alias("layer"), F.lit(kind).alias("layer_kind"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    named = files.filter((F.col("kind") == "code") & ~base.isin(NO_LAYER) & ~base.rlike(TEST_NAME))
    # exploded, so that the rules are tried once and not for each field
    return named.select("path", F.explode(F.array_compact(F.array(found))).alias("x")).select("path", "x.layer", "x.layer_kind")


def flows(endpoints: DataFrame, domain: DataFrame, layer: DataFrame, imported: DataFrame, hops: int = HOPS) -> DataFrame:
    """(flow_id, domain, label, entry, steps): for each endpoint its longest chain of imports.

    A chain stays in the endpoint's domain, changes layer at each hop and visits no
    file twice; among equally long ones the smallest by path wins; two steps are
    needed. Hops are joined one by one, filtered before each join.
    """
    placed = settle(layer.select("path", "layer").join(domain, "path"))
    start = endpoints.join(placed, "path").select("method", "url", "path", "framework", "domain", "layer", F.array("path").alias("files"), F.array("layer").alias("layers"))
    hop = imported.select("path", F.col("target").alias("next")).distinct().join(placed.select(F.col("path").alias("next"), F.col("domain").alias("next_domain"), F.col("layer").alias("next_layer")), "next")
    hop = settle(hop.join(placed.select("path", F.col("domain").alias("own"), F.col("layer").alias("own_layer")), "path").filter("own = next_domain and own_layer <> next_layer").select(F.col("path").alias("last"), "next", "next_layer"))
    level, every = settle(start), None
    keep = ["method", "url", "path", "framework", "domain", "files", "layers"]
    every = level.select(keep)
    level = every
    for _ in range(hops):
        level = level.withColumn("last", F.element_at("files", -1)).join(hop, "last").filter(~F.array_contains("files", F.col("next")))
        level = settle(level.withColumn("files", F.concat("files", F.array("next"))).withColumn("layers", F.concat("layers", F.array("next_layer"))).select(keep))
        every = every.union(level)
    key = ["method", "url", "path", "framework"]
    best = every.groupBy(*key, "domain").agg(F.max(F.size("files")).alias("n"))
    top = every.join(best.select(*key, "n"), key).filter(F.size("files") == F.col("n")).groupBy(*key, "domain").agg(F.min(F.struct("files", "layers")).alias("s")).filter(F.size("s.files") >= 2)
    base = F.concat(F.lit("flow:"), "domain", F.lit("/"), endpoint_slug(F.col("method"), F.col("url")))
    # endpoints whose ids coincide are numbered in their own order
    nth = F.row_number().over(Window.partitionBy("base").orderBy("method", "url", "path", "framework"))
    numbered = top.withColumn("base", base).withColumn("nth", nth)
    flow_id = F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("nth").cast("string")))
    return numbered.select(flow_id.alias("flow_id"), "domain", F.concat("method", F.lit(" "), "url").alias("label"), F.col("path").alias("entry"), F.arrays_zip(F.col("s.files").alias("file"), F.col("s.layers").alias("layer")).alias("steps"))


@dataclass
class Parts:
    """What the semantic passes find in some files, each settled once."""

    domain: DataFrame
    layer: DataFrame
    endpoints: DataFrame
    flow: DataFrame


def detect(files: DataFrame, imported: DataFrame) -> Parts:
    domain, layer, ends = settle(domains(files)), settle(layers(files)), settle(extraction.endpoints(files))
    return Parts(domain, layer, ends, settle(flows(ends, domain, layer, imported)))


# -- concepts ------------------------------------------------------------------

MIN_FILES, MIN_MODULARITY, MIN_MEMBERS = 8, 0.3, 3


def louvain(nodes: list[str], edges: list[tuple[str, str]]) -> tuple[dict[str, int], float]:
    """Communities and modularity of an undirected graph (Blondel et al. 2008), in sorted order."""
    index = {n: i for i, n in enumerate(sorted(nodes))}
    weight: list[dict[int, float]] = [{} for _ in index]
    for a, b in sorted({tuple(sorted((index[a], index[b]))) for a, b in edges if a != b}):
        weight[a][b] = weight[a].get(b, 0) + 1.0
        weight[b][a] = weight[b].get(a, 0) + 1.0
    m2 = sum(sum(w.values()) for w in weight)
    member = list(range(len(index)))
    if not m2:
        return {n: member[i] for n, i in index.items()}, 0.0
    graph, own = weight, [0.0] * len(index)
    groups = [[i] for i in range(len(index))]
    while True:
        degree = [sum(w.values()) + own[i] for i, w in enumerate(graph)]
        place, total = list(range(len(graph))), degree[:]
        improved = moved = True
        improved = False
        while moved:
            moved = False
            for i, w in enumerate(graph):
                to: dict[int, float] = {}
                for j, x in w.items():
                    to[place[j]] = to.get(place[j], 0) + x
                total[place[i]] -= degree[i]
                gain = {c: x - total[c] * degree[i] / m2 for c, x in to.items()}
                stay = gain.get(place[i], -total[place[i]] * degree[i] / m2)
                best = min(gain, key=lambda c: (-gain[c], c)) if gain else place[i]
                if gain and gain[best] > stay + 1e-12:
                    place[i], moved, improved = best, True, True
                total[place[i]] += degree[i]
        if not improved:
            break
        names = {c: k for k, c in enumerate(sorted(set(place)))}
        merged: list[list[int]] = [[] for _ in names]
        new: list[dict[int, float]] = [{} for _ in names]
        inner = [0.0] * len(names)
        for i, w in enumerate(graph):
            c = names[place[i]]
            merged[c] += groups[i]
            inner[c] += own[i]
            for j, x in w.items():
                d = names[place[j]]
                if c == d:
                    inner[c] += x
                else:
                    new[c][d] = new[c].get(d, 0) + x
        graph, own, groups = new, inner, merged
    for c, g in enumerate(groups):
        for i in g:
            member[i] = c
    q = 0.0
    for c, g in enumerate(groups):
        inside = sum(x for i in g for j, x in weight[i].items() if member[j] == c)
        q += inside / m2 - (sum(sum(weight[i].values()) for i in g) / m2) ** 2
    return {n: member[i] for n, i in index.items()}, q


def _concepts_of(pdf: pd.DataFrame) -> pd.DataFrame:
    files = sorted(pdf["path"].unique())
    edges = [(a, b) for a, b in zip(pdf["path"], pdf["target"], strict=True) if isinstance(b, str)]
    columns = ["domain", "head", "n_files", "modularity"]
    if len(files) < MIN_FILES or not edges:
        return pd.DataFrame([], columns=columns)
    community, q = louvain(files, edges)
    if q < MIN_MODULARITY:
        return pd.DataFrame([], columns=columns)
    into: dict[str, int] = {}
    for a, b in set(edges):
        if community[a] == community[b]:
            into[b] = into.get(b, 0) + 1
    groups: dict[int, list[str]] = {}
    for f in files:
        groups.setdefault(community[f], []).append(f)
    rows = [(pdf["domain"].iloc[0], min(g, key=lambda f: (-into.get(f, 0), f)), len(g), round(q, 4)) for g in groups.values() if len(g) >= MIN_MEMBERS]
    return pd.DataFrame(rows, columns=columns)


def concepts(domain: DataFrame, imported: DataFrame) -> DataFrame:
    """(concept_id, domain, head, n_files, modularity): communities of imports in each domain.

    A domain's import graph is clustered in one task; domains are folders of one
    project, whose files a reader can name.
    """
    target = domain.select(F.col("path").alias("target"), F.col("domain").alias("to_domain"))
    inner = imported.select("path", "target").distinct().join(target, "target").join(domain, "path").filter("domain = to_domain").select("domain", "path", "target")
    alone = domain.select("domain", "path", F.lit(None).cast("string").alias("target"))
    found = inner.union(alone).groupBy("domain").applyInPandas(_concepts_of, "domain string, head string, n_files long, modularity double")
    stem = slugify(F.regexp_replace(basename(F.col("head")), r"\.[^.]*$", ""))
    return found.select(F.concat(F.lit("concept:"), "domain", F.lit("/"), stem).alias("concept_id"), "domain", "head", "n_files", "modularity")


# -- nodes and edges -------------------------------------------------------------


def semantic_nodes(files: DataFrame, domain: DataFrame, layer: DataFrame, endpoints: DataFrame, flow: DataFrame) -> DataFrame:
    """(id, type, label, detail) of domains, layers, endpoints, flows and steps."""
    kinds = domain.join(files.select("path", "kind"), "path").groupBy("domain", "kind").agg(F.count("*").alias("n"))
    counts = F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit("="), F.col("n").cast("string")))), ",")
    d = kinds.groupBy("domain").agg(counts.alias("detail")).select(F.concat(F.lit("domain:"), "domain").alias("id"), F.lit("domain").alias("type"), F.col("domain").alias("label"), "detail")
    first = layer.groupBy("layer").agg(F.min_by("layer_kind", "path").alias("kind")).select(F.concat(F.lit("layer:"), "layer"), F.lit("layer"), "layer", "kind")
    e = endpoints.groupBy("method", "url").agg(F.min_by("framework", "path").alias("framework")).select(F.concat(F.lit("endpoint:"), "method", F.lit(":"), "url"), F.lit("endpoint"), F.concat("method", F.lit(" "), "url"), "framework")
    f = flow.select("flow_id", F.lit("flow"), "label", F.size("steps").cast("string"))
    s = flow.select("flow_id", F.posexplode("steps").alias("i", "s")).select(F.concat(F.lit("step:"), "flow_id", F.lit("#"), (F.col("i") + 1).cast("string")), F.lit("step"), F.concat((F.col("i") + 1).cast("string"), F.lit(". "), "s.file"), "s.layer")
    return d.union(first).union(e).union(f).union(s)


def semantic_edges(domain: DataFrame, layer: DataFrame, endpoints: DataFrame, flow: DataFrame, imported: DataFrame) -> DataFrame:
    """(src, dst, type, weight) of the five families that tie files to them."""
    file = lambda c: F.concat(F.lit("file:"), c)
    edge = lambda df, s, d, t: df.select(s.alias("src"), d.alias("dst"), F.lit(t).alias("type")).distinct().withColumn("weight", default_weight(F.lit(t)))
    steps = flow.select("flow_id", F.posexplode("steps").alias("i", "s"))
    out = edge(domain, file("path"), F.concat(F.lit("domain:"), "domain"), "belongs_to_domain")
    out = out.union(edge(layer, file("path"), F.concat(F.lit("layer:"), "layer"), "in_layer"))
    out = out.union(edge(endpoints, file("path"), F.concat(F.lit("endpoint:"), "method", F.lit(":"), "url"), "exposes_endpoint"))
    out = out.union(edge(steps, F.col("flow_id"), F.concat(F.lit("step:"), "flow_id", F.lit("#"), (F.col("i") + 1).cast("string")), "flow_step"))
    out = out.union(edge(steps, file("s.file"), F.col("flow_id"), "implements_flow"))
    to = domain.select(F.col("path").alias("target"), F.col("domain").alias("to_domain"))
    cross = imported.select("path", "target").distinct().join(domain, "path").join(to, "target").filter("domain <> to_domain").groupBy("domain", "to_domain").agg(F.count("*").cast("double").alias("weight"))
    return out.union(cross.select(F.concat(F.lit("domain:"), "domain"), F.concat(F.lit("domain:"), "to_domain"), F.lit("cross_domain"), "weight"))
