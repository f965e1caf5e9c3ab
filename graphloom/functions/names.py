"""Slugs, titles, escapes and other text shapes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a task.
STOP_WORDS = "the and for with from fix bug add new use this that into out feature implement implementing remove update refactor test tests".split()


def slugify(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def skill_slug(domain: Column) -> Column:
    return F.replace(domain, F.lit("/"), F.lit("-"))


def domain_of_slug(slug: Column) -> Column:
    """A skill slug as a domain again; names with hyphens of their own are lost."""
    return F.replace(slug, F.lit("-"), F.lit("/"))


# Fill and border of the eight colours that domains have.
DOMAIN_COLOURS = [("#0c2d6b", "#1f6feb"), ("#0a3622", "#238636"), ("#3d1f8c", "#6e40c9"), ("#3d2e00", "#9e6a03"), ("#2d1500", "#b94900"), ("#1a2d1a", "#2ea043"), ("#1c1c3d", "#6b7de0"), ("#2d1a2d", "#a371f7")]


def domain_colour(name: Column) -> Column:
    """struct(fill, border) of a domain, by a hash of its name's characters in 32 bits."""
    codes = F.transform(F.split(name, ""), lambda c: F.ascii(c).cast("long"))
    wrap = lambda x: F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: wrap(a * 31 + c))
    palette = F.array(*(F.struct(F.lit(a).alias("fill"), F.lit(b).alias("border")) for a, b in DOMAIN_COLOURS))
    return F.get(palette, (F.abs(h) % len(DOMAIN_COLOURS)).cast("int"))


def camel_to_kebab(value: Column) -> Column:
    x = F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1-$2")
    x = F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", "$1-$2")
    return F.lower(F.regexp_replace(x, r"[_\s]+", "-"))


def purpose(path: Column) -> Column:
    """What a file is for, from its name; index files take their folder's."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?i)\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|java)$", "")
    return camel_to_kebab(F.when((stem == "index") & (F.size(parts) >= 2), F.try_element_at(parts, F.lit(-2))).otherwise(stem))


def title_case(value: Column) -> Column:
    words = F.filter(F.split(value, r"[-_\s]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def keywords(task: Column) -> Column:
    """Words of three letters or more that are no stop words."""
    return F.filter(F.split(F.lower(task), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))


def endpoint_slug(method: Column, path: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(path, "[:{}*]", ""), "^/+|/+$", "")
    verb = F.when(method == "CLI", "cli").otherwise(F.lower(method))
    return slugify(F.concat(verb, F.lit("-"), F.when(base == "", "root").otherwise(base)))


def type_counts(counts: Column, none: str = "(none)") -> Column:
    """A map of counts as 'a=1, b=2'."""
    entries = F.array_sort(F.map_entries(counts))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    return F.when(F.size(entries) > 0, text).otherwise(F.lit(none))


def escape_dot(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def escape_xml(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def escape_html(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def shortstat_delta(text: Column) -> Column:
    """Insertions plus deletions of a diff summary."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+) (?:insertion|deletion)"), F.lit(1))
    return F.aggregate(F.transform(found, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def glob_to_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: **/ any folders, ** anything, * and ? within a segment."""
    import re

    shapes = {"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", pattern.replace("\\", "/"))
    return "^" + "".join(shapes[p] if p in shapes else re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", p) for p in parts) + "$"


def matches_glob(path: Column, pattern: str) -> Column:
    return (path == pattern) | path.rlike(glob_to_regex(pattern))
