"""What source text says, line by line: declarations, heritage, imports, calls, references, endpoints.

Every rule is a regular expression on one line; the first rule of a language that
fits decides. All of it runs in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename, extname, language, segments

JS = ("typescript", "tsx", "javascript", "jsx")


@dataclass(frozen=True)
class Declaration:
    """A declaration: its pattern, the group of its name, and when it counts as exported."""

    languages: tuple[str, ...]
    kind: str
    pattern: str
    name: int
    exported: str  # "group" (the first is present), "public", "plain" (no underscore), "capital"
    extends: int = 0
    implements: int = 0
    extends_many: bool = False


# Declaration patterns, in the order in which they are tried.
DECLARATIONS = [
    Declaration(JS, "function_declaration", r"^\s*(export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*[(<]", 2, "group"),
    Declaration(JS, "class_declaration", r"^\s*(export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)(?:\s*<[^>]*>)?(?:\s+extends\s+([A-Za-z_$][\w$.]*(?:\s*<[^>]*>)?))?(?:\s+implements\s+([A-Za-z_$][\w$.,\s<>]*?))?\s*\{", 2, "group", 3, 4),
    Declaration(JS, "interface_declaration", r"^\s*(export\s+)?interface\s+([A-Za-z_$][\w$]*)(?:\s*<[^>]*>)?(?:\s+extends\s+([A-Za-z_$][\w$.,\s<>]*?))?\s*\{", 2, "group", 3, 0, True),
    Declaration(JS, "type_alias_declaration", r"^\s*(export\s+)?type\s+([A-Za-z_$][\w$]*)\s*[<=]", 2, "group"),
    Declaration(JS, "variable_declaration", r"^\s*(export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*[=:]", 2, "group"),
    Declaration(JS, "enum_declaration", r"^\s*(export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)\s*\{", 2, "group"),
    Declaration(("python",), "class_definition", r"^\s*class\s+([A-Za-z_][\w]*)\s*(?:\(([^)]*)\))?\s*:", 1, "plain", 2, 0, True),
    Declaration(("python",), "function_definition", r"^\s*def\s+([A-Za-z_][\w]*)\s*\(", 1, "plain"),
    Declaration(("go",), "function_declaration", r"^\s*func\s+(?:\([^)]+\)\s+)?([A-Za-z_][\w]*)\s*\(", 1, "capital"),
    Declaration(("go",), "type_declaration", r"^\s*type\s+([A-Za-z_][\w]*)\s+(?:struct|interface)\b", 1, "capital"),
    Declaration(("rust",), "function_item", r"^\s*(pub\s+)?(?:async\s+)?fn\s+([A-Za-z_][\w]*)\s*[<(]", 2, "group"),
    Declaration(("rust",), "struct_item", r"^\s*(pub\s+)?(?:struct|enum)\s+([A-Za-z_][\w]*)\b", 2, "group"),
    Declaration(("java",), "class_declaration", r"^\s*(public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+)?class\s+([A-Za-z_][\w]*)(?:\s*<[^>]*>)?(?:\s+extends\s+([A-Za-z_][\w.]*(?:\s*<[^>]*>)?))?(?:\s+implements\s+([A-Za-z_][\w.,\s<>]*?))?\s*\{?", 2, "public", 3, 4),
    Declaration(("java",), "method_declaration", r"^\s*(public|private|protected)\s+(?:static\s+)?(?:\w+\s+)+([A-Za-z_][\w]*)\s*\(", 2, "public"),
]
# Names before a parenthesis that are no calls, and keywords that make a definition.
RESERVED = "if for while switch catch return typeof in of throw new await yield delete void case do else function class import from as with instanceof".split()
DEFINES = "function class def interface enum type".split()
# Import and skip patterns.
JS_IMPORT = r"""^\s*import\s+(?:type\s+)?([^'"]*?)\s+from\s+['"]([^'"]+)['"]"""
JS_SIDE_EFFECT = r"""^\s*import\s+['"]([^'"]+)['"]"""
JS_IMPORT_END = r"""^\s*\}?\s*from\s+['"]([^'"]+)['"]"""
PY_FROM, PY_IMPORT = r"^\s*from\s+([\w.]+)\s+import\b", r"^\s*import\s+([\w.]+)"
GO_OPEN, GO_CLOSE = r"^\s*import\s+\(", r"^\s*\)"
GO_BLOCK, GO_SINGLE = r"""^\s*(?:[\w]+\s+)?["']([^"']+)["']""", r"""^\s*import\s+["']([^"']+)["']"""
NO_REFERENCES = [r"^\s*import\b", r"^\s*export\s+(?:type\s+)?\{", r"""^\s*\}?\s*from\s+['"]""", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|type|enum|function)\s+[A-Za-z_$][\w$]*"]
#: Strings of three quotes and comments; what is left of a line is code.
LITERALS = r"""'(?:\\.|[^'\\]|\\$)*(?:'|$)|"(?:\\.|[^"\\]|\\$)*(?:"|$)|`(?:\\.|[^`\\]|\\$)*(?:`|$)|//.*$|/\*.*?\*/|/\*.*$"""
SEPARATORS = r"[\s(){};,=:<>+\-*/%!|&^?]"


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """(path, language, line_no, line) of files (path, content) in a known language, with the columns named in keep."""
    known = files.select("path", "content", *keep, language(F.col("path")).alias("language")).filter("language is not null")
    return known.select("path", *keep, "language", F.posexplode(F.split("content", r"\r?\n")).alias("i", "line")).select("path", *keep, "language", (F.col("i") + 1).cast("long").alias("line_no"), "line")


def _fits(d: Declaration) -> Column:
    return F.col("language").isin(list(d.languages)) & F.col("line").rlike(d.pattern)


def _first(values: list[tuple[Column, Column]]) -> Column:
    out = None
    for when, value in values:
        out = F.when(when, value) if out is None else out.when(when, value)
    return out


def _exported(d: Declaration) -> Column:
    name = F.regexp_extract("line", d.pattern, d.name)
    group = F.regexp_extract("line", d.pattern, 1)
    return {"group": group != "", "public": F.trim(group) == "public", "plain": ~name.startswith("_"), "capital": name.rlike("^[A-Z]")}[d.exported]


def _ruled(source: DataFrame) -> DataFrame:
    """source with rule, the number of the declaration that a line is, so that the patterns are tried once."""
    return source.withColumn("rule", _first([(_fits(d), F.lit(i)) for i, d in enumerate(DECLARATIONS)]))


def _declared() -> Column:
    return _first([(F.col("rule") == i, F.struct(F.lit(d.kind).alias("kind"), F.regexp_extract("line", d.pattern, d.name).alias("name"), _exported(d).alias("exported"))) for i, d in enumerate(DECLARATIONS)])


def declarations(source: DataFrame) -> DataFrame:
    """(path, line_no, kind, name, exported) of lines()."""
    return _ruled(source).select("path", "line_no", F.explode(F.array_compact(F.array(_declared()))).alias("d")).select("path", "line_no", "d.kind", "d.name", "d.exported")


def heritage_list(raw: Column) -> Column:
    """The names of a comma-separated list, without type arguments."""
    parts = F.transform(F.split(raw, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), "<.*$", "")))
    return F.filter(parts, lambda x: x.rlike(r"^[A-Za-z_$][\w$.]*$"))


def _relation(kind: str, child: Column):
    return lambda parent: F.struct(F.lit(kind).alias("kind"), child.alias("child"), parent.alias("parent"))


def _kin() -> Column:
    def of(d: Declaration) -> Column:
        child = F.regexp_extract("line", d.pattern, d.name)
        made = []
        for kind, g, many in (("extends", d.extends, d.extends_many), ("implements", d.implements, True)):
            if g:
                raw = F.regexp_extract("line", d.pattern, g)
                names = heritage_list(raw) if many else F.filter(F.array(F.trim(F.regexp_replace(raw, "<.*$", ""))), lambda x: x != "")
                made.append(F.transform(names, _relation(kind, child)))
        return F.concat(*made)

    return _first([(F.col("rule") == i, of(d)) for i, d in enumerate(DECLARATIONS) if d.extends or d.implements])


def heritage(source: DataFrame) -> DataFrame:
    """(path, line_no, ord, kind, child, parent): extends and implements, in order."""
    return _ruled(source).select("path", "line_no", F.posexplode(_kin()).alias("ord", "h")).select("path", "line_no", "ord", "h.kind", "h.child", "h.parent")


def specifiers(clause: Column) -> Column:
    """What an import clause names: array of (kind, name, imported)."""
    one = "array<struct<kind:string,name:string,imported:string>>"
    text = F.trim(F.regexp_replace(clause, r"^\s*type\s+", ""))
    spec = lambda kind, name, imported=None: F.struct(F.lit(kind).alias("kind"), name.alias("name"), (F.lit(None).cast("string") if imported is None else imported).alias("imported"))
    ns = F.regexp_extract(text, r"^\*\s+as\s+([\w$]+)$", 1)
    head = F.trim(F.regexp_replace(F.regexp_extract(text, r"^([^{]*)", 1), r",\s*$", ""))
    default = F.when(head.rlike(r"^[\w$]+$"), F.array(spec("default", head))).otherwise(F.array().cast(one))
    pieces = F.transform(F.split(F.regexp_extract(text, r"\{([^}]*)", 1), ","), lambda x: F.trim(F.regexp_replace(x, r"^\s*type\s+", "")))
    alias = r"^([\w$]+)\s+as\s+([\w$]+)$"
    named = F.transform(F.filter(pieces, lambda x: x.rlike(r"^[\w$]+$") | x.rlike(alias)), lambda x: F.when(x.rlike(alias), spec("named", F.regexp_extract(x, alias, 2), F.regexp_extract(x, alias, 1))).otherwise(spec("named", x)))
    return F.when(ns != "", F.array(spec("namespace", ns))).otherwise(F.concat(default, named))


def _named() -> Column:
    """What a line of a language without import blocks imports, or null."""
    line = F.col("line")
    got = lambda rx, g=1: F.regexp_extract("line", rx, g)
    js = F.when(line.rlike(JS_IMPORT), _pair(got(JS_IMPORT, 2), specifiers(got(JS_IMPORT)))).when(line.rlike(JS_SIDE_EFFECT), _pair(got(JS_SIDE_EFFECT))).when(line.rlike(JS_IMPORT_END), _pair(got(JS_IMPORT_END)))
    py = F.when(line.rlike(PY_FROM), _pair(got(PY_FROM))).when(line.rlike(PY_IMPORT), _pair(got(PY_IMPORT)))
    return F.when(F.col("language") == "python", py).when(F.col("language").isin(*JS), js)


def _pair(source: Column, specs: Column | None = None) -> Column:
    none = F.array().cast("array<struct<kind:string,name:string,imported:string>>")
    return F.struct(source.alias("source"), (none if specs is None else specs).alias("specifiers"))


def go_imports(source: DataFrame) -> DataFrame:
    """imports() of the lines in Go."""
    line, lang = F.col("line"), F.col("language")
    # a Go import block is open from its first line to the next closing parenthesis
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(line.rlike(GO_OPEN), True).when(line.rlike(GO_CLOSE), False)
    # no other line opens, closes or is an import: the rest isn't shuffled
    go = source.filter((lang == "go") & (line.rlike(GO_OPEN) | line.rlike(GO_CLOSE) | line.rlike(GO_BLOCK) | line.rlike(GO_SINGLE))).withColumn("open", F.coalesce(F.last(mark, ignorenulls=True).over(order), F.lit(False)))
    got = lambda rx: F.regexp_extract("line", rx, 1)
    i = F.when(line.rlike(GO_OPEN) | (~F.col("open") & line.rlike(GO_CLOSE)), None).when(F.col("open") & line.rlike(GO_BLOCK), _pair(got(GO_BLOCK))).when(~F.col("open") & line.rlike(GO_SINGLE), _pair(got(GO_SINGLE)))
    return go.select(*[c for c in source.columns if c not in ("language", "line")], i.alias("i")).filter("i is not null").select("*", "i.source", "i.specifiers").drop("i")


def imports(source: DataFrame) -> DataFrame:
    """(path, line_no, source, specifiers) of lines()."""
    rest = source.filter(F.col("language").isin(*JS, "python")).select("path", "line_no", F.explode(F.array_compact(F.array(_named()))).alias("i")).select("path", "line_no", "i.source", "i.specifiers")
    return rest.union(go_imports(source.select("path", "language", "line_no", "line")))


def code_only(line: Column) -> Column:
    """A line without its string literals and comments."""
    return F.regexp_replace(line, LITERALS, " ")


#: A name before a parenthesis, with the keyword that makes it a definition, and one without.
_CALL = rf"(?:(?<=^|{SEPARATORS})(?:{'|'.join(DEFINES)}){SEPARATORS}+)?\b[A-Za-z_$][\w$]*\s*\("
_BARE_CALL = r"^([A-Za-z_$][\w$]*)\s*\($"
_REFERENCE = r"\b([A-Z][\w$]*)\b(?!\s*\()"


def _called(code: Column) -> Column:
    """Names that are called in code; a match is a keyword and a name, or just a name."""
    names = F.transform(F.regexp_extract_all(code, F.lit(_CALL), F.lit(0)), lambda x: F.regexp_extract(x, _BARE_CALL, 1))
    return F.when(code.contains("("), F.filter(names, lambda x: (x != "") & ~x.isin(RESERVED)))


def _mentioned(code: Column) -> Column:
    """Capitalised names in code that aren't called, imported or defined there."""
    skip = F.lit(False)
    for rx in NO_REFERENCES:
        skip = skip | F.col("line").rlike(rx)
    return F.when(code.rlike("[A-Z]") & ~skip, F.regexp_extract_all(code, F.lit(_REFERENCE), F.lit(1)))


def calls(source: DataFrame) -> DataFrame:
    """(path, line_no, name) for each call site name( that isn't reserved or a definition."""
    masked = source.filter(F.col("language").isin(*JS, "python")).select("path", "line_no", code_only(F.col("line")).alias("code"))
    return masked.select("path", "line_no", F.explode(_called(F.col("code"))).alias("name"))


def references(source: DataFrame) -> DataFrame:
    """(path, line_no, name) for each capitalised name that isn't called, imported or defined there."""
    masked = source.filter(F.col("language").isin(*JS, "python")).select("path", "line_no", "line", code_only(F.col("line")).alias("code"))
    return masked.select("path", "line_no", F.explode(_mentioned(F.col("code"))).alias("name"))


#: A row of everything(): its part says which of the other fields it has.
_FOUND = "part string, kind string, name string, exported boolean, source string, specifiers array<struct<kind:string,name:string,imported:string>>, ord int, child string, parent string"


def everything(source: DataFrame, names: bool = True) -> DataFrame:
    """Declarations, imports, heritage and, with `names`, calls and references of lines() in one pass.

    Further columns of source stay; part is symbol, import, heritage, call or reference.
    """
    fields = [f.split(" ")[0] for f in _FOUND.split(", ")]
    typed = "array<struct<" + ",".join(f.replace(" ", ":", 1) for f in _FOUND.split(", ")) + ">>"
    none = F.array().cast(typed)
    kinds = dict(f.split(" ", 1) for f in _FOUND.split(", "))
    row = lambda part, **c: F.struct(*((F.lit(part) if k == "part" else c.get(k, F.lit(None))).cast(t).alias(k) for k, t in kinds.items()))
    each = lambda rows, made: F.coalesce(F.transform(rows, made), none)
    of = lambda x, *names: {n: x[n] for n in names}
    found = [
        each(F.array_compact(F.array(_declared())), lambda x: row("symbol", **of(x, "kind", "name", "exported"))),
        each(F.array_compact(F.array(_named())), lambda x: row("import", **of(x, "source", "specifiers"))),
        each(F.transform(_kin(), lambda x, i: F.struct(x["kind"].alias("kind"), x["child"].alias("child"), x["parent"].alias("parent"), i.alias("ord"))), lambda x: row("heritage", **of(x, "ord", "kind", "child", "parent"))),
    ]
    kept = [c for c in source.columns if c not in ("language", "line")]
    held = _ruled(source)
    if names:
        code = F.when(F.col("language").isin(*JS, "python"), code_only(F.col("line")))
        held = held.withColumn("code", code)
        found += [each(_called(F.col("code")), lambda x: row("call", name=x)), each(_mentioned(F.col("code")), lambda x: row("reference", name=x))]
    out = held.select(*kept, F.explode(F.concat(*found)).alias("x")).select(*kept, *(f"x.{f}" for f in fields))
    return out.unionByName(go_imports(source).withColumn("part", F.lit("import")), allowMissingColumns=True)


# -- parser engines ---------------------------------------------------------------


class Engine(Protocol):
    """A parser that can take the place of the line patterns; it is sent to the tasks."""

    def load_grammar(self, language: str) -> None: ...

    def parse(self, source: str, language: str) -> object: ...

    def capture(self, tree: object, language: str) -> list[tuple[str, str, int, bool]]: ...


_CAPTURES = "array<struct<kind:string,name:string,line_no:long,exported:boolean>>"


def parse_files(files: DataFrame, engine: Engine | None = None) -> DataFrame:
    """(path, ok, language, engine, reason, captures) of files (path, content), by an engine or the line patterns.

    reason says why a file has no captures: unsupported_language, grammar_unavailable
    or parse_failed (its content can't be read, or the engine fails on it). With an
    engine only captures are found.
    """
    named = files.select("path", "content", language(F.col("path")).alias("language"))
    known = named.filter("language is not null and content is not null")
    if engine is None:
        found = declarations(lines(known.select("path", "content"))).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "kind", "name", "exported"))).alias("found"))
        captures = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["name"].alias("name"), x["line_no"].alias("line_no"), x["exported"].alias("exported")))
        parsed = known.select("path").join(found, "path", "left").select("path", F.lit(None).cast("string").alias("failed"), captures.alias("captures"))
    else:

        def each(frames):
            loaded: dict[str, bool] = {}
            for pdf in frames:
                rows = []
                for path, content, lang in zip(pdf["path"], pdf["content"], pdf["language"], strict=True):
                    if lang not in loaded:
                        try:
                            engine.load_grammar(lang)
                            loaded[lang] = True
                        except Exception:  # noqa: BLE001 - whatever an engine raises is its reason to fall back
                            loaded[lang] = False
                    if not loaded[lang]:
                        rows.append((path, "grammar_unavailable", []))
                        continue
                    try:
                        got = engine.capture(engine.parse(content, lang), lang)
                        rows.append((path, None, [dict(zip(("kind", "name", "line_no", "exported"), c, strict=True)) for c in got]))
                    except Exception:  # noqa: BLE001
                        rows.append((path, "parse_failed", []))
                yield pd.DataFrame(rows, columns=["path", "failed", "captures"])

        parsed = known.mapInPandas(each, f"path string, failed string, captures {_CAPTURES}")
    reason = F.when(F.col("language").isNull(), "unsupported_language").when(F.col("content").isNull(), "parse_failed").otherwise(F.col("failed"))
    none = F.array().cast(_CAPTURES)
    out = named.join(parsed, "path", "left").withColumn("reason", reason)
    used = F.when(F.col("reason").isNull(), F.lit("lines" if engine is None else type(engine).__name__)).otherwise("none")
    return out.select("path", F.col("reason").isNull().alias("ok"), "language", used.alias("engine"), "reason", F.coalesce("captures", none).alias("captures"))


# -- endpoints ----------------------------------------------------------------

# HTTP methods and endpoint patterns.
METHODS = "get post put delete patch head options".split()
NEST_CONTROLLER = r"""^\s*@Controller\(\s*(?:['"]([^'"]*)['"])?\s*\)"""
NEST_METHOD = rf"""^\s*@({"|".join(m.capitalize() for m in METHODS)})\(\s*(?:['"]([^'"]*)['"])?\s*\)"""
EXPRESS = rf"""(?:app|router|api)\.({"|".join(METHODS)})\(\s*['"]([^'"]+)['"]"""
FASTAPI = rf"""^\s*@(?:app|router)\.({"|".join(METHODS)})\(\s*['"]([^'"]+)['"]"""
NEXT_ROUTE = rf"""^\s*export\s+(?:async\s+function|const|function)\s+({"|".join(m.upper() for m in METHODS)})\b"""
COMMAND = r"""\.command\(\s*['"]([a-zA-Z][a-zA-Z0-9\-_:.]*)"""
SCRIPTS = (".ts", ".js", ".tsx", ".jsx")


def likely_endpoint(path: Column) -> Column:
    """Whether a file's place or name suggests endpoints."""
    base, parts = basename(path), segments(path)
    has = lambda s: F.array_contains(parts, s)
    named = base.rlike(r"\.(controller|router|routes)\.(ts|js)$") | base.rlike(r"^(routes|router|app|main)\.py$")
    return named | has("routes") | has("controllers") | has("commands") | has("pages") | (has("app") & base.rlike(r"^(page|route)\.(t|j)sx?$"))


def _after(path: Column, folder: str) -> Column:
    parts = segments(path)
    return F.slice(parts, F.array_position(parts, F.lit(folder)).cast("int") + 1, F.size(parts))


def app_route(path: Column) -> Column:
    """The URL of an app-router file: folders below app, without (groups)."""
    folders = _after(path, "app")
    kept = F.filter(F.slice(folders, F.lit(1), F.size(folders) - 1), lambda s: ~s.rlike(r"^\(.+\)$"))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def page_route(path: Column, extension: str) -> Column:
    """The URL of a file below pages: its path without extension, index being its folder."""
    tail = _after(path, "pages")
    last = F.regexp_replace(F.element_at(tail, -1), extension, "")
    kept = F.concat(F.slice(tail, F.lit(1), F.size(tail) - 1), F.filter(F.array(last), lambda x: (x != "index") & (x != "")))
    return F.concat(F.lit("/"), F.array_join(F.filter(kept, lambda x: x != ""), "/"))


def endpoints(files: DataFrame) -> DataFrame:
    """(method, url, path, framework): what the code files (path, kind, content) expose."""
    code = files.filter((F.col("kind") == "code") & likely_endpoint(F.col("path"))).select("path", "content", extname(F.col("path")).alias("ext"))
    rows = code.select("path", "ext", F.posexplode(F.split("content", r"\r?\n")).alias("i", "line")).filter(~F.col("line").rlike(r"^\s*(//|\*|/\*|#)"))
    line, parts, base = F.col("line"), segments(F.col("path")), basename(F.col("path"))
    script = F.col("ext").isin(*SCRIPTS)
    bare = lambda c: F.regexp_replace(c, "^/|/$", "")
    order = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    prefix = F.last(F.when(line.rlike(NEST_CONTROLLER), bare(F.regexp_extract("line", NEST_CONTROLLER, 1))), ignorenulls=True).over(order)
    # no other line sets a prefix or is a method: the rest isn't shuffled
    nest = rows.filter(script & (line.rlike(NEST_CONTROLLER) | line.rlike(NEST_METHOD))).withColumn("prefix", F.coalesce(prefix, F.lit(""))).filter(line.rlike(NEST_METHOD))
    joined = F.concat(F.lit("/"), F.array_join(F.filter(F.array("prefix", bare(F.regexp_extract("line", NEST_METHOD, 2))), lambda x: x != ""), "/"))
    many = lambda rx, g: F.regexp_extract_all("line", F.lit(rx), F.lit(g))
    made = lambda m, u, f: F.struct(m.alias("method"), u.alias("url"), F.lit(f).alias("framework"))
    none = F.array().cast("array<struct<method:string,url:string,framework:string>>")
    if_ = lambda fits, found: F.when(fits, found).otherwise(none)
    one = lambda fits, m, u, f: if_(fits, F.array(made(m, u, f)))
    in_app, in_pages = F.array_contains(parts, "app"), F.array_contains(parts, "pages")
    first_page = F.get(_after(F.col("path"), "pages"), F.lit(0))
    # all rules of a line at once, and all rules of a file's place at once
    by_line = F.concat(
        if_(script & line.rlike(EXPRESS), F.transform(F.arrays_zip(many(EXPRESS, 1).alias("m"), many(EXPRESS, 2).alias("u")), lambda x: made(F.upper(x["m"]), x["u"], "express"))),
        one((F.col("ext") == ".py") & line.rlike(FASTAPI), F.upper(F.regexp_extract("line", FASTAPI, 1)), F.regexp_extract("line", FASTAPI, 2), "fastapi"),
        one(script & in_app & base.rlike(r"^route\.(t|j)sx?$") & line.rlike(NEXT_ROUTE), F.regexp_extract("line", NEXT_ROUTE, 1), app_route(F.col("path")), "next-route"),
        if_(script & line.rlike(COMMAND), F.transform(many(COMMAND, 1), lambda x: made(F.lit("CLI"), x, "commander"))),
    )
    hidden = (first_page != "api") & base.rlike(r"^_(app|document|error)\.(t|j)sx?$")
    by_place = F.concat(
        one(script & in_app & base.rlike(r"^page\.(t|j)sx?$"), F.lit("PAGE"), app_route(F.col("path")), "next-page"),
        one(script & in_pages & ~hidden, F.when(first_page == "api", "ANY").otherwise("PAGE"), page_route(F.col("path"), r"\.(tsx?|jsx?)$"), "next-pages"),
        one(F.col("ext") == ".astro", F.lit("PAGE"), page_route(F.col("path"), r"\.astro$"), "astro"),
        one((F.col("ext") == ".vue") & in_pages, F.lit("PAGE"), page_route(F.col("path"), r"\.vue$"), "nuxt"),
    )
    nested = nest.select("path", made(F.upper(F.regexp_extract("line", NEST_METHOD, 1)), joined, "nest").alias("x"))
    found = nested.union(rows.select("path", F.explode(by_line))).union(code.select("path", F.explode(by_place)))
    return found.select("x.method", "x.url", "path", "x.framework").distinct()
