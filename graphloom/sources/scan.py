"""Project scan, its cache, and other small sources around a source tree."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import DEFAULT_IGNORES, extname, ignored, kind, rule_lines

SCAN_SCHEMA = "path string, ext string, size long, hash string, kind string"


def walk(root: str, rules: list[str], below: str = ".") -> Iterator[tuple[str, int, int, int]]:
    """(path, size, mtime, ctime in ms) of regular files below a folder of root; dotfiles too, links not."""
    for folder, names, files in os.walk(os.path.join(root, below)):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        inside = lambda n: n if rel == "." else f"{rel}/{n}"  # noqa: E731,B023
        names[:] = [n for n in names if not is_ignored(inside(n), rules) and not os.path.islink(os.path.join(folder, n))]
        for n in files:
            full = os.path.join(folder, n)
            if not os.path.islink(full) and os.path.isfile(full) and not is_ignored(inside(n), rules):
                at = os.stat(full)
                yield inside(n), at.st_size, at.st_mtime_ns // 1_000_000, at.st_ctime_ns // 1_000_000


def is_ignored(path: str, rules: list[str]) -> bool:
    """The ignore rule of functions.paths.ignored(), for one path."""
    parts = path.split("/")
    for rule in rules:
        if rule.endswith("*"):
            if path.startswith(rule[:-1]):
                return True
            continue
        rule = rule.rstrip("/")
        if path == rule or path.startswith(rule + "/") or ("/" not in rule and rule in parts):
            return True
    return False


def ignore_rules(root: str, name: str = ".scanignore") -> list[str]:
    path = os.path.join(root, name)
    own = rule_lines(open(path, encoding="utf-8").read()) if os.path.isfile(path) else []
    return [*DEFAULT_IGNORES, *own]


def list_project(spark: SparkSession, root: str, ignore_name: str = ".scanignore") -> DataFrame:
    """(path, size, mtime, ctime) of a tree; each folder at its top is listed by a task, which sees the tree too."""
    rules = ignore_rules(root, ignore_name)
    kinds = "path string, size long, mtime long, ctime long"
    tops = sorted(e.name for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and not is_ignored(e.name, rules))
    own = [(e.name, at.st_size, at.st_mtime_ns // 1_000_000, at.st_ctime_ns // 1_000_000) for e in os.scandir(root) if e.is_file(follow_symlinks=False) and not is_ignored(e.name, rules) for at in [e.stat()]]
    found = spark.createDataFrame(own, kinds)
    if not tops:
        return found

    def each(frames):
        for pdf in frames:
            for top in pdf["top"]:
                yield pd.DataFrame(list(walk(root, rules, top)), columns=["path", "size", "mtime", "ctime"])

    dealt = spark.createDataFrame([(t,) for t in tops], "top string").repartition(min(len(tops), 4 * spark.sparkContext.defaultParallelism), "top")
    return found.union(dealt.mapInPandas(each, kinds))


def read_contents(listing: DataFrame, root: str) -> DataFrame:
    """listing with each file's content, read where the listing's partitions are."""

    def each(frames):
        for pdf in frames:
            pdf["content"] = [open(os.path.join(root, p), "rb").read() for p in pdf["path"]]
            yield pdf

    return listing.repartition(F.col("path")).mapInPandas(each, f"{', '.join(f'{n} {t}' for n, t in listing.dtypes)}, content binary")


def classify(files: DataFrame) -> DataFrame:
    """The scan table of files (path, content)."""
    data = F.col("content").cast("binary")
    return files.select("path", extname(F.col("path")).alias("ext"), F.octet_length(data).cast("long").alias("size"), F.sha2(data, 256).alias("hash"), kind(F.col("path")).alias("kind"))


def scan_project(spark: SparkSession, root: str, previous: DataFrame | None = None, ignore_name: str = ".scanignore") -> DataFrame:
    """The scan of a tree; content is read only where the previous scan can't be reused."""
    listing = list_project(spark, root, ignore_name)
    if previous is None:
        return classify(read_contents(listing, root)).join(listing.select("path", "mtime", "ctime"), "path")
    fresh = merge_cache(listing, previous)
    todo = listing.join(fresh.filter("status = 'stale'").select("path"), "path", "left_semi")
    new = classify(read_contents(todo, root)).join(todo.select("path", "mtime", "ctime"), "path")
    kept = previous.join(fresh.filter("status = 'reused'").select("path"), "path", "left_semi").select("path", "ext", "size", "hash", "kind", "mtime", "ctime")
    return kept.union(new.select(kept.columns))


def merge_cache(listing: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, status): reused where size, mtime and ctime are as before, stale, or evicted if gone."""
    stamps = ("size", "mtime", "ctime")
    now, old = listing.select("path", *stamps), previous.select("path", *(F.col(c).alias(f"old_{c}") for c in stamps))
    both = now.join(old, "path", "full_outer")
    same = F.lit(True)
    for c in stamps:
        same = same & (F.col(c) == F.col(f"old_{c}"))
    status = F.when(F.col("size").isNull(), "evicted").when(same, "reused").otherwise("stale")
    return both.select("path", status.alias("status"))


def reuse_fragments(files: DataFrame, fragments: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(files with a fragment of this content and version, files to parse again)."""
    good = fragments.filter(F.col("version") == version).drop("version")
    return files.join(good, ["path", "hash"]), files.join(good, ["path", "hash"], "left_anti")


def changed_files(root: str, since: str = "HEAD") -> list[str]:
    """Paths that differ from a git revision."""
    got = subprocess.run(["git", "-C", root, "diff", "--name-only", since], capture_output=True, text=True, check=True)
    return [x for x in got.stdout.splitlines() if x]


def loc_delta(root: str, since: str = "HEAD") -> int:
    got = subprocess.run(["git", "-C", root, "diff", "--shortstat", since], capture_output=True, text=True, check=True)
    return sum(int(n) for n in re.findall(r"(\d+) (?:insertion|deletion)", got.stdout))


# -- front matter ------------------------------------------------------------


def front_matter(docs: DataFrame) -> DataFrame:
    """(path, name, description, domains, always_apply) of documents (path, content)."""
    head = F.regexp_extract("content", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    field = lambda k: F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*?)[ \t\r]*$", 1), "^[\"']|[\"']$", ""))
    listed = F.regexp_extract(head, r"(?m)^domains:[ \t]*\[(.*?)\]", 1)
    domains = F.filter(F.transform(F.split(listed, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    name = field("name")
    return docs.select("path", F.when(name != "", name).otherwise(stem).alias("name"), F.nullif(field("description"), F.lit("")).alias("description"), domains.alias("domains"), (field("alwaysApply") == "true").alias("always_apply"))


# -- configuration -----------------------------------------------------------


def strip_json_comments(text: str) -> str:
    """JSON with // and /* */ comments and trailing commas, as plain JSON."""
    kept = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m.group(1) or "", kept)


def path_aliases(text: str) -> list[dict]:
    """Alias rules of a compiler configuration: prefix, suffix, wildcard and targets, in order."""
    options = json.loads(strip_json_comments(text)).get("compilerOptions", {})
    out = []
    for pattern, targets in options.get("paths", {}).items():
        prefix, star, suffix = pattern.partition("*")
        out.append({"prefix": prefix, "suffix": suffix, "wildcard": bool(star), "targets": targets, "base": options.get("baseUrl", ".")})
    return out


INDEX_CANDIDATES = ("src/index.ts", "src/index.tsx", "index.ts", "index.js")


def workspace_aliases(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path): each workspace package's name and the first of its index files that exists.

    manifests: (path, content) of packages/*/package.json; files: (path).
    """
    named = manifests.filter(F.col("path").rlike(r"^packages/[^/]+/package\.json$")).select(F.from_json("content", "name string")["name"].alias("name"), F.regexp_replace("path", "/package.json$", "").alias("folder")).filter("name is not null")
    tried = named.select("name", F.posexplode(F.array(*(F.concat("folder", F.lit("/" + c)) for c in INDEX_CANDIDATES))).alias("ord", "path"))
    return tried.join(files.select("path").distinct(), "path", "left_semi").groupBy("name").agg(F.min_by("path", "ord").alias("path"))


#: Symbols that one request describes.
ENRICH_BATCH = 12
# What a description may say of a symbol's complexity.
COMPLEXITIES = ("low", "medium", "high")


def parse_reply(raw: str) -> dict[str, dict]:
    """Descriptions by id from a reply: a JSON object {"entries": [...]}, whatever text is around it; else nothing."""
    start, end = raw.find("{"), raw.rfind("}")
    try:
        entries = json.loads(raw[start : end + 1]).get("entries") if 0 <= start < end else None
    except (ValueError, AttributeError):
        return {}
    return {str(e["id"]): describe(e) for e in entries or [] if isinstance(e, dict) and e.get("id")}


def describe(entry: dict) -> dict:
    """An entry within bounds: a summary of 200 characters, three lower-case tags, a known complexity."""
    tags = entry.get("tags")
    tags = [t.lower().strip() for t in tags if isinstance(t, str)] if isinstance(tags, list) else []
    complexity = entry.get("complexity")
    return {"summary": str(entry.get("summary") or "")[:200].strip(), "tags": [t for t in tags if t][:3], "complexity": complexity if complexity in COMPLEXITIES else COMPLEXITIES[0]}


def enrich(targets: DataFrame, ask: Callable[[str], str], batch: int = ENRICH_BATCH) -> DataFrame:
    """targets with summary, tags and complexity from a callable that answers a JSON list of symbols with text.

    Requests are made where the targets' partitions are, `batch` symbols each; a
    reply that can't be read describes nothing.
    """
    sent = [c for c in ("id", "label", "kind", "lang", "exported", "path") if c in targets.columns]

    def each(frames):
        for pdf in frames:
            rows = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                asked = json.loads(part[sent].rename(columns={"label": "name"}).to_json(orient="records"))
                rows += [(i, d["summary"], d["tags"], d["complexity"]) for i, d in parse_reply(ask(json.dumps(asked))).items()]
            yield pd.DataFrame(rows, columns=["id", "summary", "tags", "complexity"])

    found = targets.mapInPandas(each, "id string, summary string, tags array<string>, complexity string").dropDuplicates(["id"])
    return targets.join(found, "id", "left")
