import json

from graphloom.streaming import incremental


def test_changes_are_merged_once(spark, tmp_path):
    src, table, ck = (str(tmp_path / x) for x in ("in", "table", "ck"))
    (tmp_path / "in").mkdir()

    def send(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("path", "content", "version"), r, strict=True))) for r in rows))
        incremental.follow(spark, src, table, ck).awaitTermination(120)
        return {r["path"]: r["content"] for r in incremental.read(spark, table).collect()}

    assert send("1.json", [("a.ts", "export const x = 1;", 1), ("b.ts", "let y = 2;", 1)]) == {"a.ts": "export const x = 1;", "b.ts": "let y = 2;"}
    now = send("2.json", [("a.ts", "class A {", 2), ("b.ts", None, 3), ("a.ts", "old", 1)])
    assert now == {"a.ts": "class A {"}
    scan, found = incremental.tables(incremental.read(spark, table))
    assert [(r["path"], r["kind"]) for r in scan.collect()] == [("a.ts", "code")] and [r["name"] for r in found.collect()] == ["A"]
    # a batch leaves the buckets that it does not touch where they are
    many = {f"f{k}.ts": f"let a = {k};" for k in range(200)}
    assert send("3.json", [(p, c, 5) for p, c in many.items()]) == {"a.ts": "class A {", **many}
    assert send("4.json", [("f7.ts", "new", 6)]) == {"a.ts": "class A {", **many, "f7.ts": "new"}
    written = {v: len(list((tmp_path / "table" / v).glob("bucket=*"))) for v in ("v=2", "v=3")}
    assert written["v=2"] > 30 and written["v=3"] == 1
    assert {r["path"]: r["content"] for r in incremental.read(spark, table, before=3).collect()} == {"a.ts": "class A {", **many}
