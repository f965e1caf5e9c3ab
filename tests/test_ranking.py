import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import packing, ranking, subgraph

FILES = "id string, type string, label string, path string, kind string, hash string, exported boolean"


def graph(spark, ids, pairs):
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    edges = spark.createDataFrame(pairs, "src string, dst string")
    return nodes, edges


def ranks(df):
    return {r["id"]: r["rank"] for r in df.collect()}


@pytest.mark.parametrize("local_limit", [0, 1000])
def test_pagerank_from_a_seed(spark, local_limit):
    n, e = graph(spark, ["a", "b", "isolated"], [("a", "b")])
    r = ranks(ranking.pagerank(n, e, ["a"], local_limit=local_limit))
    assert r == pytest.approx({"a": 0.337662, "b": 0.474675, "isolated": 0.187662}, abs=2e-6)


def test_pagerank_of_a_hub_and_a_chain(spark):
    n, e = graph(spark, ["a", "b", "c", "hub"], [("a", "hub"), ("b", "hub"), ("c", "hub"), ("hub", "a")])
    r = ranks(ranking.pagerank(n, e))
    assert r == pytest.approx({"hub": 0.479662, "a": 0.445338, "b": 0.0375, "c": 0.0375}, abs=1e-3)
    n, e = graph(spark, ["x", "y", "z"], [("x", "y"), ("y", "z")])
    assert sum(ranks(ranking.pagerank(n, e)).values()) == pytest.approx(1)


def test_pagerank_of_nothing(spark):
    n, e = graph(spark, [], [])
    assert ranking.pagerank(n, e).count() == 0


def test_bfs_stops_at_cycles_and_drops_unknown_seeds(spark):
    n, e = graph(spark, ["a", "b"], [("a", "b"), ("b", "a")])
    seeds = spark.createDataFrame([("a",), ("gone",)], "id string")
    assert {tuple(r) for r in ranking.bfs(n, e, seeds, 3).collect()} == {("a", 0), ("b", 1)}


def greedy(rows, budget):
    """The packer, step by step."""
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    mode, total = {p: "full" for p, _, _ in rows}, sum(t for _, _, t in rows)
    for have, to, saved in (("full", "excerpt", lambda t: t - 200), ("excerpt", "summary", lambda t: 150), ("summary", "excluded", lambda t: 50)):
        for p, _, t in reversed(rows):
            if total <= budget:
                return mode
            if mode[p] == have:
                mode[p] = to
                total -= saved(t)
        if total <= budget:
            return mode
    return mode


def test_packer_equals_the_greedy_loop(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for k in range(40):
        own = [(f"f{i}", float(rnd.randint(0, 6)), rnd.choice([20, 60, 199, 200, 250, 900, 5000])) for i in range(rnd.randint(1, 12))]
        budget = rnd.choice([0, 100, 400, 1000, 3000, 20000])
        rows += [(k, p, s, t, False, "", budget) for p, s, t in own]
        want |= {(k, p): m for p, m in greedy(own, budget).items()}
    df = spark.createDataFrame(rows, "pack_id int, path string, score double, tokens long, is_seed boolean, hash string, budget int")
    got = {(r["pack_id"], r["path"]): r["mode"] for r in packing.pack(df, F.col("budget")).collect()}
    assert got == want


def test_change_subgraph_compact_and_full(spark):
    rows = [(f"file:src/{x}.ts", "file", x, f"src/{x}.ts", "code", None, None) for x in "abcd"]
    rows += [(f"symbol:src/{f}.ts#{s}", "symbol", s, f"src/{f}.ts", "class", None, True) for f, s in (("a", "Foo"), ("b", "Bar"), ("c", "Baz"))]
    nodes = spark.createDataFrame(rows, FILES)
    edges = spark.createDataFrame([(f"file:src/{a}.ts", f"file:src/{b}.ts", "imports") for a, b in ("ab", "bc", "cd")], "src string, dst string, type string")
    short = lambda g: {r["label"] for r in g.nodes.collect()}
    assert short(subgraph.change_subgraph(nodes, edges, ["src/a.ts"], 1)) == {"a", "b", "Foo"}
    assert short(subgraph.change_subgraph(nodes, edges, ["src/a.ts"], 1, "full")) == {"a", "b", "Foo", "Bar"}
    assert short(subgraph.change_subgraph(nodes, edges, ["src/a.ts"], 2)) == {"a", "b", "c", "Foo"}
    assert short(subgraph.change_subgraph(nodes, edges, ["src/none.ts"], 2)) == set()


def test_boost_and_stop_words(spark):
    rows = [(f"file:packages/{d}/x.ts", "file", "x.ts", f"packages/{d}/x.ts", "code", None, None) for d in ("auth", "billing", "orders")]
    rows += [(f"domain:{d}", "domain", d, None, None, None, None) for d in ("auth", "billing", "orders")]
    nodes = spark.createDataFrame(rows, FILES)
    edges = spark.createDataFrame([(f"file:packages/{d}/x.ts", f"domain:{d}", "belongs_to_domain", 1.0) for d in ("auth", "billing", "orders")], "src string, dst string, type string, weight double")
    assert [r[0] for r in ranking.matched_domains(nodes, "fix billing invoice rounding bug").collect()] == ["domain:billing"]
    assert ranking.matched_domains(nodes, "fix the bug").count() == 0
    sizes = spark.createDataFrame([("packages/billing/x.ts", 100)], "path string, size long")
    first = ranking.score_files(nodes, edges, sizes, task="fix billing").first()
    assert first["path"] == "packages/billing/x.ts"
