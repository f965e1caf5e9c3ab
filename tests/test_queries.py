"""Every registered query against its SQL on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import code_oracles, code_queries, star_oracles, star_queries

SF = "/root/testdata/sf0.001"
OWN = {**star_queries.QUERIES, **code_queries.QUERIES}
SQL = {**star_oracles.SQL, **code_oracles.SQL}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else None if v is None else str(v)
    return sorted((tuple(tidy(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = OWN[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_scored_files_keep_the_whole_top_k_of_a_large_graph(spark):
    # ranks sum to 1, so no fixed score may decide
    got = [tuple(r) for r in star_queries.scored_files(spark, "/root/testdata/sf0.1").collect()]
    assert len(got) == 200 and max(s for _, s, _ in got) < 0.0015 and got == sorted(got, key=lambda r: -r[1])


def test_no_alias_or_tag_is_lost_beyond_what_is_broadcast(spark):
    from graphloom.operators import building, rollups

    aliases = spark.range(150_000).selectExpr("concat('@w/', id) as name", "concat('packages/', id, '/index.ts') as path")
    paths, imports = aliases.select("path"), aliases.selectExpr("'a.ts' as path", "name as source")
    assert building.resolve_imports(paths, imports, aliases).filter("target is null").count() == 0
    tags = spark.range(150_000).selectExpr("concat(' D', id) as tag")
    domains = spark.range(200).selectExpr("concat(if(id % 2 = 0, 'packages/', ''), 'd', id * 700) as domain").union(spark.createDataFrame([("none",)], "domain string"))
    assert [r["domain"] for r in rollups.skill_coverage(domains, tags).filter("not covered").collect()] == ["none"]
    everything = tags.union(spark.createDataFrame([("all",)], "tag string"))
    assert rollups.skill_coverage(domains, everything).filter("not covered").count() == 0


def test_all_are_registered():
    assert set(OWN) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
