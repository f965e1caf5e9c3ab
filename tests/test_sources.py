import os

from pyspark.sql import functions as F

from graphloom.functions import names, paths
from graphloom.operators import exporting, semantics
from graphloom.plans.session import settle
from graphloom.sources import scan


def test_scan_lists_dotfiles_and_reuses_what_is_unchanged(spark, tmp_path):
    for name, text in {"src/a.ts": "a", ".env": "", "node_modules/x.js": "x", "docs/b.md": "b", "skip/me.txt": "s", ".scanignore": "# no\nskip\n"}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    found = settle(scan.scan_project(spark, str(tmp_path)))
    assert {(r["path"], r["kind"], r["ext"]) for r in found.collect()} == {("src/a.ts", "code", ".ts"), (".env", "unknown", ""), ("docs/b.md", "doc", ".md"), (".scanignore", "unknown", "")}
    (tmp_path / "src/a.ts").write_text("longer")
    os.remove(tmp_path / "docs/b.md")
    again = scan.scan_project(spark, str(tmp_path), found)
    sizes = {r["path"]: r["size"] for r in again.collect()}
    assert sizes == {"src/a.ts": 6, ".env": 0, ".scanignore": 10}


def test_configuration_with_comments():
    text = '{ // x\n "compilerOptions": {"baseUrl": "src", "paths": {"@a/*": ["a/*", "b/*"], "u": ["http://x"], /* y */ } } }'
    assert scan.path_aliases(text)[0] == {"prefix": "@a/", "suffix": "", "wildcard": True, "targets": ["a/*", "b/*"], "base": "src"}
    assert scan.path_aliases(text)[1]["targets"] == ["http://x"]


def test_globs():
    import re

    hit = lambda p, g: re.match(names.glob_to_regex(g), p) is not None
    assert hit("a/b/c.ts", "**/*.ts") and hit("c.ts", "**/*.ts") and not hit("a/c.ts", "*.ts")
    assert hit("a/x.ts", "a/?.ts") and not hit("a/xy.ts", "a/?.ts") and hit("a+b(c)", "a+b(c)") and hit("src/a/b", "src/**")


def test_path_functions(spark):
    p = F.col("p")
    row = spark.createDataFrame([("a/../b/./c.test.ts",)], "p string").select(paths.normalize(p), paths.basename(p), paths.dirname(p), paths.extname(p), paths.kind(p)).first()
    assert tuple(row) == ("b/c.test.ts", "c.test.ts", "a/../b/.", ".ts", "test")
    up = spark.createDataFrame([("../../x",), ("a/../../x",)], "p string").select(paths.normalize(p).alias("n")).collect()
    assert [r["n"] for r in up] == ["../../x", "../x"]


def test_louvain_is_stable_and_finds_two_cliques():
    edges = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0")]
    nodes = [f"{g}{i}" for g in "ab" for i in range(4)]
    found, q = semantics.louvain(nodes, edges)
    again, _ = semantics.louvain(nodes[::-1], edges[::-1])
    assert q >= 0.3 and len({found[f"a{i}"] for i in range(4)}) == 1 and found["a0"] != found["b0"] and found == again


def test_exports_write_whole_documents(spark, tmp_path):
    import xml.etree.ElementTree as xml

    nodes = spark.createDataFrame([("file:a", "file", 'q"<&', "a", "code", None, None)], "id string, type string, label string, path string, kind string, lang string, exported boolean")
    edges = spark.createDataFrame([("file:a", "file:a", "imports", 0.8)], "src string, dst string, type string, weight double")
    exporting.write_dot(nodes, edges, str(tmp_path / "g.dot"))
    exporting.write_graphml(nodes, edges, str(tmp_path / "g.graphml"))
    assert 'label="q\\"<&"' in (tmp_path / "g.dot").read_text() and "penwidth=0.8" in (tmp_path / "g.dot").read_text()
    assert len(list(xml.parse(tmp_path / "g.graphml").getroot().iter())) > 8


def test_a_touched_file_is_read_again(spark):
    now = spark.createDataFrame([("a", 1, 5, 5), ("b", 1, 5, 9), ("c", 1, 5, 5)], "path string, size long, mtime long, ctime long")
    before = spark.createDataFrame([("a", 1, 5, 5), ("b", 1, 5, 5), ("d", 1, 5, 5)], "path string, size long, mtime long, ctime long")
    assert dict(map(tuple, scan.merge_cache(now, before).collect())) == {"a": "reused", "b": "stale", "c": "stale", "d": "evicted"}


def test_documents_have_the_order_of_ids(spark, tmp_path):
    nodes = spark.createDataFrame([(f"file:{k}", "file", f"{k}", f"{k}", "code", None, None) for k in range(12)], "id string, type string, label string, path string, kind string, lang string, exported boolean")
    edges = spark.createDataFrame([("file:0", f"file:{k}", "imports", 0.8) for k in range(12)], "src string, dst string, type string, weight double")
    exporting.write_graphml(nodes.repartition(3), edges.repartition(3), str(tmp_path / "g.graphml"))
    import re

    found = re.findall(r'<edge id="e(\d+)" source="file:0" target="file:(\d+)"', (tmp_path / "g.graphml").read_text())
    assert [int(k) for k, _ in found] == list(range(12)) and [t for _, t in found] == sorted(map(str, range(12)))


def test_numbering_by_ranges_equals_sorting(spark):
    from graphloom.operators.ordering import number_rows

    rows = [(k * 7919 % 1000, "x") for k in range(1000)]
    got = number_rows(spark.createDataFrame(rows, "a long, b string").repartition(5), ["a", "b"]).collect()
    assert {r["a"]: r["k"] for r in got} == {a: a for a, _ in rows}


def test_parser_engines_and_their_reasons(spark):
    from graphloom.operators import extraction

    class Upper:
        """An engine that finds upper-case words."""

        def load_grammar(self, language):
            if language == "go":
                raise ValueError(language)

        def parse(self, source, language):
            if "broken" in source:
                raise ValueError(source)
            return source.split()

        def capture(self, tree, language):
            return [("word", w, k + 1, True) for k, w in enumerate(tree) if w.isupper()]

    files = spark.createDataFrame([("a.ts", "x FOO y BAR"), ("b.go", "FOO"), ("c.ts", "broken"), ("d.ts", None), ("e.txt", "FOO"), ("f.py", "class A:\n  pass")], "path string, content string")
    got = {r["path"]: (r["ok"], r["engine"], r["reason"], [c["name"] for c in r["captures"]]) for r in extraction.parse_files(files, Upper()).collect()}
    assert got["a.ts"] == (True, "Upper", None, ["FOO", "BAR"]) and got["f.py"] == (True, "Upper", None, ["A:"])
    assert [got[k][2] for k in ("b.go", "c.ts", "d.ts", "e.txt")] == ["grammar_unavailable", "parse_failed", "parse_failed", "unsupported_language"]
    plain = {r["path"]: (r["engine"], [c["name"] for c in r["captures"]]) for r in extraction.parse_files(files).collect()}
    assert plain["f.py"] == ("lines", ["A"]) and plain["d.ts"] == ("none", [])


def test_descriptions_are_asked_for_in_batches_and_kept_within_bounds(spark):
    import json

    targets = spark.createDataFrame([(f"symbol:{k}", f"n{k}", "class") for k in range(25)], "id string, label string, kind string").coalesce(1)

    def ask(payload):
        asked = json.loads(payload)
        if any(x["id"] == "symbol:24" for x in asked):
            return "no idea"
        entries = [{"id": x["id"], "summary": f" {len(asked)} {x['name']} " + "s" * 300, "tags": [" A ", 3, "", "b", "c", "d"], "complexity": "vast"} for x in asked] + [{"summary": "without id"}]
        return "Here: " + json.dumps({"entries": entries}) + " done"

    got = {r["id"]: r for r in scan.enrich(targets, ask).collect()}
    assert len(got) == 25 and got["symbol:24"]["summary"] is None
    assert got["symbol:3"]["summary"].startswith("12 n3") and len(got["symbol:3"]["summary"]) <= 200 and got["symbol:3"]["tags"] == ["a", "b", "c"] and got["symbol:3"]["complexity"] == "low"
    assert scan.parse_reply("}{") == {} == scan.parse_reply('{"entries": []}') == scan.parse_reply("[1]")


def test_many_changes_equal_one_by_one(spark):
    from graphloom.operators import changes, subgraph

    nodes = spark.createDataFrame([(f"file:f{k}.ts", "file", f"f{k}.ts", None) for k in range(8)] + [(f"symbol:f{k}.ts#S", "symbol", f"f{k}.ts", k % 2 == 0) for k in range(8)], "id string, type string, path string, exported boolean")
    edges = spark.createDataFrame([(f"file:f{k}.ts", f"file:f{k + 1}.ts", "imports") for k in range(7)], "src string, dst string, type string")
    focus = [("a", "f0.ts", "compact"), ("a", "f4.ts", "compact"), ("b", "f3.ts", "full"), ("gone", "none.ts", "compact")]
    many = changes.change_subgraphs(nodes, edges, spark.createDataFrame(focus, "change_id string, path string, mode string"), 2)
    for change in ("a", "b", "gone"):
        mode = next(m for c, _, m in focus if c == change)
        one = subgraph.change_subgraph(nodes, edges, [f for c, f, _ in focus if c == change], 2, mode)
        of = lambda df, c: sorted(tuple(r[k] for k in c) for r in df.filter(F.col("change_id") == change).collect())
        plain = lambda df, c: sorted(tuple(r[k] for k in c) for r in df.collect())
        assert of(many.nodes, ["id"]) == plain(one.nodes, ["id"]) and of(many.edges, ["src", "dst"]) == plain(one.edges, ["src", "dst"])


def test_unchanged_files_are_not_parsed_again(spark):
    from graphloom.operators import building
    from graphloom.plans.fixtures import code_files

    files = code_files(spark)
    first = building.build_graph(files, True, True)
    again = building.build_graph(files, True, True, fragments=building.build_graph(files, True, True).fragments)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert dict(map(tuple, again.cached.collect()))["reparsed"] == 0 and rows(first.edges) == rows(again.edges) and rows(first.nodes) == rows(again.nodes)
    other = building.build_graph(files, True, True, fragments=first.fragments.withColumn("version", F.lit("0")))
    assert dict(map(tuple, other.cached.collect()))["reused"] == 0
