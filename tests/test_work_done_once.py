"""What the queries over the source tree compute, and how often."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import extraction
from graphloom.plans import code_queries, fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture
def made(spark, monkeypatch):
    """How many times a file of the tree was made so far."""
    seen = spark.sparkContext.accumulator(0)
    plain = fixtures.code_files

    def counted(session, sf_dir=None):
        def count(path):
            seen.add(1)
            return path

        return plain(session, sf_dir).withColumn("path", F.udf(count, "string").asNondeterministic()("path"))

    monkeypatch.setattr(code_queries, "code_files", counted)
    return seen


@pytest.mark.parametrize("name", ["semantic_map", "architecture", "semantic_edges", "semantic_nodes", "semantic_flows"])
def test_semantic_queries_make_each_file_once_and_look_for_imports_alone(spark, made, monkeypatch, name):
    for unneeded in ("declarations", "heritage", "calls", "references"):
        monkeypatch.setattr(extraction, unneeded, lambda source, unneeded=unneeded: pytest.fail(unneeded))
    code_queries.QUERIES[name](spark, SF).collect()
    assert made.value == fixtures.code_files(spark, SF).count()


def test_copies_of_the_tree_are_those_of_the_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = sorted((r["path"], r["content"]) for r in fixtures.code_files(spark, SF).collect())
    assert got == sorted(con.sql(f"select path, content from {fixtures.sql_values()}").fetchall())


def test_lines_that_do_not_matter_stay_out_of_windows(spark):
    go = 'package a\nimport (\n  "one"\n// ) no\n  x "two"\n)\nvar a = "three"\nimport "four"\n'
    found = extraction.imports(extraction.lines(spark.createDataFrame([("a.go", go)], "path string, content string")))
    assert sorted((r["line_no"], r["source"]) for r in found.collect()) == [(3, "one"), (5, "two"), (8, "four")]
    ts = "@Get('lost')\n@Controller('a')\nclass A {\n @Get('b')\n /* @Post('c') */\n}\n\t// @Controller('z')\n@Put()\n@Controller()\n@Delete('d')\n"
    files = spark.createDataFrame([("x.controller.ts", "code", ts)], "path string, kind string, content string")
    ends = extraction.endpoints(files)
    assert sorted((r["method"], r["url"]) for r in ends.collect()) == [("DELETE", "/d"), ("GET", "/a/b"), ("GET", "/lost"), ("PUT", "/a")]
    plan = ends._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Filter", plan.index("Window")) :]
    assert "@Controller" in below[: below.index("Generate")]


@pytest.mark.parametrize("name", ["build_stats", "fragment_reuse"])
def test_files_are_made_once_and_read_in_one_pass(spark, made, monkeypatch, name):
    for apart in ("declarations", "heritage", "imports", "calls", "references"):
        monkeypatch.setattr(extraction, apart, lambda source, apart=apart: pytest.fail(apart))
    code_queries.QUERIES[name](spark, SF).collect()
    assert made.value == fixtures.code_files(spark, SF).count()


def test_one_pass_finds_what_the_extractors_find(spark):
    more = [("a.py", "class A(B, C):\n  def f(self): return A.g(function (x))\nfrom .b import c\n"), ("a.go", 'import (\n "x"\n)\nfunc F() {}\n'), ("a.java", "public class A extends B implements C, D {\n public int f() {\n"), ("a.ts", "class X extends Y { } ; new Foo(bar (1)) ; class (a)\nfunction foo (x) { if (Y) { } }\nclass class_ (B)\n"), ("a.md", "class X {}")]
    files = fixtures.code_files(spark).select("path", "content").union(spark.createDataFrame(more, "path string, content string"))
    lines = extraction.lines(files)
    found = extraction.everything(lines)
    apart = {"symbol": extraction.declarations, "import": extraction.imports, "heritage": extraction.heritage, "call": extraction.calls, "reference": extraction.references}
    for part, of in apart.items():
        want = of(lines)
        rows = lambda df: sorted(map(str, df.select(want.columns).collect()))  # noqa: B023, E731
        assert rows(want) and rows(found.filter(f"part = '{part}'")) == rows(want)


def test_fragments_given_to_a_build_are_worked_out_once(spark):
    from graphloom.operators import building

    files = fixtures.code_files(spark).withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
    known = building.parse_fragments(files.filter("kind in ('code', 'test')")).localCheckpoint()
    seen = spark.sparkContext.accumulator(0)

    def count(path):
        seen.add(1)
        return path

    graph = building.build_graph(files, True, True, fragments=known.withColumn("path", F.udf(count, "string").asNondeterministic()("path")))
    edges = sorted(map(str, graph.edges.collect()))
    assert edges == sorted(map(str, building.build_graph(files, True, True).edges.collect()))
    assert {r["status"]: r["n"] for r in graph.cached.collect()} == {"reused": known.filter("part = 'file'").count(), "reparsed": 0}
    assert seen.value == known.count()
