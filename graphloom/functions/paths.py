"""POSIX path functions as columns; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """All before the last slash; '.' without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def extname(path: Column) -> Column:
    """The last dot and what follows, unless the name begins with it."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def segments(path: Column) -> Column:
    return F.split(path, "/")


def ancestors(path: Column) -> Column:
    """Every proper folder prefix of a path, outermost first."""
    parts = segments(path)
    n = F.size(parts) - 1
    made = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(n >= 1, made).otherwise(F.array().cast("array<string>"))


def normalize(path: Column) -> Column:
    """Resolve '.' and '..' segments of a relative path."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when((part == ".") | (part == ""), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(segments(to_posix(path)), F.array().cast("array<string>"), step), "/")


# Extensions of each language and kind.
LANGUAGES = {".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java"}
CODE = [".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java"]
CONFIG = [".json", ".yaml", ".yml", ".toml", ".ini", ".env"]
DOC = [".md", ".mdx", ".txt", ".rst"]
ASSET = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".pdf"]
DEFAULT_IGNORES = [".git", "node_modules", "dist", "coverage"]


def language(path: Column) -> Column:
    ext = F.lower(extname(path))
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), ext)


def kind(path: Column) -> Column:
    """test, code, schema, config, doc, asset or unknown; the first that fits."""
    ext = F.lower(extname(path))
    return (
        F.when(path.contains(".test.") | path.contains(".spec."), "test")
        .when(ext.isin(CODE), "code")
        .when(path.endswith(".schema.json"), "schema")
        .when(ext.isin(CONFIG), "config")
        .when(ext.isin(DOC), "doc")
        .when(ext.isin(ASSET), "asset")
        .otherwise("unknown")
    )


def structural_domain(path: Column) -> Column:
    """packages/<x> for workspace files, else the first segment."""
    parts = segments(path)
    return F.when((F.get(parts, F.lit(0)) == "packages") & (F.size(parts) > 1), F.concat(F.lit("packages/"), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))


def sub_folder(path: Column, domain: Column) -> Column:
    """The folders of a path below its domain; null for a file right in it."""
    rest = F.substr(path, F.length(domain) + 2)
    return F.when(rest.contains("/"), F.regexp_replace(rest, r"/[^/]*$", ""))


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether an ignore rule covers a path.

    A trailing * is a prefix; other rules cover themselves and what is below them;
    without a slash they also cover any segment.
    """
    out = F.lit(False)
    for rule in rules:
        if rule.endswith("*"):
            out = out | path.startswith(rule[:-1])
            continue
        rule = rule.rstrip("/")
        out = out | (path == rule) | path.startswith(rule + "/")
        if "/" not in rule:
            out = out | F.array_contains(segments(path), rule)
    return out


def rule_lines(text: str) -> list[str]:
    """Ignore rules of a file: trimmed lines, no blanks or comments."""
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]
