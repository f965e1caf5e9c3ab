"""DuckDB SQL for star_queries, from the same views as common table expressions."""

from __future__ import annotations

from ..functions.names import DOMAIN_COLOURS, STOP_WORDS, glob_to_regex
from ..functions.paths import ASSET, CODE, CONFIG, DOC, LANGUAGES
from ..operators.exporting import EDGE_STYLE, NODE_FILL, NODE_SHAPE, OTHER_FILL, OTHER_SHAPE, OTHER_STYLE
from ..operators.ranking import EDGE_WEIGHTS
from ..operators.validation import SCHEMAS
from .star_queries import DOMAIN, FOCUS_DOCS, IGNORE, ITERATIONS, SEED_DOCS, TASK


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(table: dict, column: str, other: str | None = None, text: bool = True) -> str:
    q = (lambda v: f"'{v}'") if text else (lambda v: f"cast({v} as double)")
    return f"case {column} " + " ".join(f"when '{k}' then {q(v)}" for k, v in table.items()) + (f" else {q(other)}" if other is not None else "") + " end"


def extname(p: str) -> str:
    return f"regexp_extract(regexp_extract({p}, '[^/]*$'), '^.+?(\\.[^.]*)$', 1)"


KIND = f"""case when contains(path, '.test.') or contains(path, '.spec.') then 'test' when lower({extname("path")}) in ({_list(CODE)}) then 'code' when path like '%.schema.json' then 'schema'
  when lower({extname("path")}) in ({_list(CONFIG)}) then 'config' when lower({extname("path")}) in ({_list(DOC)}) then 'doc' when lower({extname("path")}) in ({_list(ASSET)}) then 'asset' else 'unknown' end"""
DOMAIN_OF = "case when split_part({0}, '/', 1) = 'packages' and contains({0}, '/') then 'packages/' || split_part({0}, '/', 2) else split_part({0}, '/', 1) end"

VIEWS = f"""
f0 as (select doc_id, source, n_chars as size, sha256(text) as hash, 'packages/' || source || '/' || lang || '/doc_' || doc_id
  || case doc_id % 7 when 0 then '.test.ts' when 1 then '.py' when 2 then '.md' when 3 then '.json' else '.ts' end as path from documents),
files as (select *, {extname("path")} as ext, {KIND} as kind, {_case(LANGUAGES, "lower(" + extname("path") + ")")} as lang, 'file:' || path as id, {DOMAIN_OF.format("path")} as domain from f0),
nn as (select count(*) as n from documents),
pairs as (
  select distinct a, b, 'imports' as type from (
    select l_orderkey % n as a, l_partkey % n as b from lineitem, nn where l_linenumber = 1 and l_returnflag = 'R'
    union all select doc_id, doc_id + 20 from documents, nn where doc_id + 20 < n) where a <> b
  union all select doc_id, doc_id + 1, 'tests' from documents, nn where doc_id % 7 = 0 and doc_id + 1 < n),
fe as (select x.id as src, y.id as dst, type from pairs join files x on x.doc_id = a join files y on y.doc_id = b),
e0 as (select * from fe union all select id, 'domain:' || source, 'belongs_to_domain' from files),
edges as (select *, {_case(EDGE_WEIGHTS, "type", text=False)} as weight from e0),
nodes as (
  select id, 'file' as type, regexp_extract(path, '[^/]*$') as label, path, kind, lang, hash from files
  union all select distinct 'domain:' || source, 'domain', source, null, null, null, null from files),
urls as (select page_id, regexp_extract(coalesce(url, ''), '^[^:]*://[^/?#]*/([^?#]*)', 1) as path from pages)
"""


def _with(body: str, *more: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{', '.join([VIEWS.strip(), *more])}\n{body}"


def _ignored() -> str:
    tests = []
    for rule in IGNORE:
        if rule.endswith("*"):
            tests.append(f"starts_with(path, '{rule[:-1]}')")
        else:
            tests.append(f"(path = '{rule}' or starts_with(path, '{rule}/')" + (f" or list_contains(string_split(path, '/'), '{rule}'))" if "/" not in rule else ")"))
    return " or ".join(tests)


def _rank_steps(k: int, p: str) -> list[str]:
    steps = [
        "rn as (select id from nodes where type = 'file' and kind in ('code', 'test'))",
        "re as (select src, dst, weight from edges where type <> 'belongs_to_domain' and src in (select id from rn) and dst in (select id from rn))",
        "rw as (select src, sum(weight) as total from re group by src)",
        f"rp as (select id, {p} as p, (select count(*) from rn) as n, id not in (select src from rw) as dangling from rn)",
        "r0 as (select id, p, n, dangling, cast(1 as double) / n as r from rp)",
    ]
    for i in range(1, k + 1):
        j = i - 1
        steps.append(f"g{i} as (select dst, sum(r * weight / total) as got from re join rw using (src) join r{j} on r{j}.id = src group by dst)")
        steps.append(f"r{i} as materialized (select id, p, n, dangling, 0.15::double * p + 0.85::double * ((select coalesce(sum(r) filter (dangling), 0) from r{j}) / n + coalesce(got, 0)) as r from r{j} left join g{i} on dst = id)")
    return steps


def _keywords(text: str) -> list[str]:
    import re

    return [w for w in re.split("[^a-z0-9]+", text.lower()) if len(w) >= 3 and w not in STOP_WORDS]


UNIFORM = "cast(1 as double) / (select count(*) from rn)"
SEEDS = ", ".join(map(str, SEED_DOCS))
SEEDED = f"case when id in (select id from files where doc_id in ({SEEDS})) then cast(1 as double) / (select count(*) from rn where id in (select id from files where doc_id in ({SEEDS}))) else 0 end"
MATCHED = "select id from nodes where type = 'domain' and (" + " or ".join(f"contains(lower(label), '{w}') or contains('{w}', lower(label))" for w in _keywords(TASK)) + ")"
SCORED = f"""scored as (
  select path, kind, hash, round(r * case when id in (select src from edges where type = 'belongs_to_domain' and dst in ({MATCHED})) then 1.5 else 1 end, 12) as score,
    cast(greatest(20, ceil(coalesce(size, 500) / 4)) as bigint) as tokens, false as is_seed from r{ITERATIONS} join files using (id))"""


def _pack(source: str, budget: str) -> list[str]:
    """CTEs that pack (pack_id, path, score, tokens, is_seed), by the windows of the closed form."""
    return [
        f"p1 as (select *, {budget} as lim, row_number() over u as pos, sum(tokens) over (partition by pack_id) as total, coalesce(sum(tokens - 200) over (partition by pack_id order by score, path desc rows between unbounded preceding and 1 preceding), 0) as saved from {source} window u as (partition by pack_id order by score, path desc))",
        "p2 as (select *, min(total - saved) over (partition by pack_id order by score, path desc rows between unbounded preceding and current row) > lim as ex from p1)",
        "p3 as (select *, total - coalesce(sum(case when ex then tokens - 200 end) over (partition by pack_id), 0) as t1 from p2)",
        "p4 as (select *, ex and t1 - 150 * (pos - 1) > lim as su from p3)",
        "p5 as (select *, t1 - 150 * sum(cast(su as int)) over (partition by pack_id) as t2 from p4)",
        "p6 as (select *, su and t2 - 50 * (pos - 1) > lim as dr from p5)",
        """packed as (select pack_id, path, score, tokens, hash, case when dr then 'excluded' when su then 'summary' when ex then 'excerpt' else 'full' end as mode,
          case when dr then null when is_seed then 'seed' when row_number() over (partition by pack_id order by score desc, path) = 1 then 'direct_import' else 'transitive_dep' end as reason,
          cast(greatest(0, t2 - 50 * sum(cast(dr as int)) over (partition by pack_id)) as bigint) as estimated from p6)""",
    ]


MANY = "many as (select source as pack_id, path, cast((doc_id * 7919) % 1009 as double) as score, cast(greatest(20, ceil(coalesce(size, 500) / 4)) as bigint) as tokens, doc_id % 31 = 0 as is_seed, hash from files)"
CONTEXT = [*_rank_steps(ITERATIONS, UNIFORM), SCORED, "best as (select 0 as pack_id, * from scored order by score desc, path limit 50)", *_pack("best", "8000")]
ENTRIES = """entries as (select * from (values ('s/a.md', 'a', ['packages/src1', 'packages/src2'], false, true, ''), ('s/b.md', 'domain-packages-src3', [], false, true, 'packages/src3'), ('s/c.md', 'always', [], true, true, ''),
  ('r/d.md', 'd', ['packages/src2', 'packages/src0', 'other'], false, false, ''), ('r/e.md', 'ctx-packages-src1', [], false, false, '')) t(path, name, domains, always, is_skill, spelled))"""
FOCUS = "focus as (select 'change-' || split_part(path, '/', 3) as change_id, path, id, domain, case when split_part(path, '/', 3) in ('de', 'fr') then 'full' else 'compact' end as mode from files where doc_id % 40 = 1)"


def _manifest(touched: str, keys: str = "", globs: bool = False) -> str:
    """Entries beside touched (keys, touched)."""
    hit = "list_filter(domains, lambda d: list_contains(touched, d))[1]"
    explicit = "case when len(domains) = 0 and is_skill and spelled <> '' and list_contains(touched, spelled) then spelled end"
    match = f"case when always then 'alwaysApply' when {hit} is not null then 'domain' when {explicit} is not null then 'explicit' end"
    return f"""select {keys}path, name, {match} is not null as matched, {match} as match_type,
      case when always then 'skill marked alwaysApply' when coalesce({hit}, {explicit}) is not null then 'task touches ' || coalesce({hit}, {explicit}) else 'domain not touched' end as reason
      {f", case when not always and {hit} is not null and not is_skill then array_to_string(list_sort(list_transform(list_filter(domains, lambda d: list_contains(touched, d)), lambda d: d || '/**')), ',') end as globs" if globs else ""}
      from entries, {touched}"""


def _change_reach(edges: str) -> list[str]:
    return [BOTH.format(edges), "c0 as (select distinct change_id, id from focus)", "c1 as (select * from c0 union select change_id, y from c0 join sym on x = id)"]


BOTH = "sym as (select src as x, dst as y from {0} union select dst, src from {0})"


def _reach(edges: str, depth: int) -> list[str]:
    ids = ", ".join(map(str, FOCUS_DOCS))
    out = [BOTH.format(edges), f"h0 as (select id from files where doc_id in ({ids}))"]
    for k in range(1, depth + 1):
        out.append(f"h{k} as (select id from h{k - 1} union select y from sym where x in (select id from h{k - 1}))")
    return out


def _constraints(source: str, rules, key: str, columns: dict[str, str]) -> str:
    out = []
    for r in rules:
        c = columns.get(r.column, r.column)
        tests = []
        if r.required:
            tests.append(("required", f"{c} is null"))
        if r.pattern is not None:
            tests.append(("pattern", f"not regexp_matches({c}, '{r.pattern}')"))
        if r.one_of:
            tests.append(("enum", f"{c} not in ({_list(r.one_of)})"))
        if r.at_least is not None:
            tests.append(("minimum", f"{c} < {r.at_least}"))
        if r.at_most is not None:
            tests.append(("maximum", f"{c} > {r.at_most}"))
        out += [f"select {key} as key, '{r.column}' as \"column\", '{name}' as problem from {source} where {t}" for name, t in tests]
    return " union all ".join(out)


def _xml(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = f"replace({c}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return c


def _dot(c: str) -> str:
    return f"replace(replace({c}, '\\', '\\\\'), '\"', '\\\"')"


def _data(key: str, c: str) -> str:
    return f"coalesce('      <data key=\"{key}\">' || {_xml(c)} || '</data>' || chr(10), '')"


def _glob_any(patterns) -> str:
    return " or ".join(f"path = '{p}' or regexp_matches(path, '{glob_to_regex(p)}')" for p in patterns)


def _normal(c: str) -> str:
    return f"""list_aggregate(list_reduce(list_prepend([''], list_transform(list_filter(string_split(replace({c}, '\\', '/'), '/'), lambda p: p not in ('', '.')), lambda p: [p])),
      lambda a, b: case when b[1] = '..' and len(a) > 1 and a[-1] <> '..' then a[:len(a) - 1] else list_concat(a, b) end)[2:], 'string_agg', '/')"""


SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
KEBAB = r"lower(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1-\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1-\2', 'g'), '[_\s]+', '-', 'g'))"

SQL: dict[str, str] = {
    "scan_files": _with("select path, ext, size, hash, kind, lang from files"),
    "ignored_paths": _with(f"select page_id, path, {_ignored()} as ignored from urls"),
    "scan_cache": _with("""select coalesce(a.path, b.path) as path, case when a.path is null then 'evicted' when a.size = b.size and a.m = b.m and a.c = b.c then 'reused' else 'stale' end as status
      from (select path, size, doc_id * 10 as m, doc_id * 10 as c from files where doc_id % 5 <> 0) a full join (select path, size, doc_id * 10 + case when doc_id % 4 = 0 then 1 else 0 end as m, doc_id * 10 + case when doc_id % 7 = 0 then 1 else 0 end as c from files where doc_id % 3 <> 0) b on a.path = b.path"""),
    "graph_cache": _with("select case when doc_id % 3 = 0 and doc_id % 2 = 0 then 'reused' else 'reparsed' end as status, kind, count(*) as n from files group by all"),
    "constraint_violations": _with(_constraints("x", SCHEMAS["scan"], "doc_id", {}), "x as (select doc_id, case when doc_id % 11 <> 0 then path end as path, case when doc_id % 13 = 0 then -1 else size end as size, case when doc_id % 17 = 0 then hash[1:10] else hash end as hash, case when doc_id % 19 = 0 then 'other' else kind end as kind from files)"),
    "event_constraints": """with x as (select event_id, cast(json_extract_string(props, '$.k') as double) as k, value from events)
      select "column", problem, count(*) as n from (select 'k' as "column", 'required' as problem from x where k is null union all select 'k', 'minimum' from x where k < 10
      union all select 'k', 'maximum' from x where k > 90 union all select 'value', 'required' from x where value is null union all select 'value', 'minimum' from x where value < 0) group by all""",
    "folder_nodes": _with("select distinct 'folder:' || array_to_string(s[1:i], '/') as id, array_to_string(s[1:i], '/') as path from (select string_split(path, '/') as s, unnest(range(1, len(string_split(path, '/')))) as i from files)"),
    "folder_contains": _with("""select distinct 'folder:' || array_to_string(s[1:i - 1], '/') as src, case when i = len(s) then 'file:' else 'folder:' end || array_to_string(s[1:i], '/') as dst
      from (select string_split(path, '/') as s, unnest(range(2, len(string_split(path, '/')) + 1)) as i from urls where path <> '')"""),
    "test_edges": _with("select id as src, replace(id, '.test.ts', '.ts') as dst, 'tests' as type from files where path like '%.test.ts'"),
    "edge_stats": _with("select type, count(*) as n, round(sum(weight), 6) as weight from edges group by type"),
    "domain_kinds": _with("select domain, kind, count(*) as n_files from files group by all"),
    "domain_relations": _with("select x.domain as from_domain, y.domain as to_domain, count(*) filter (type = 'imports') as imports, count(*) filter (type = 'tests') as tests from fe join files x on x.id = src join files y on y.id = dst where x.domain <> y.domain group by all"),
    "domain_skills": _with("""select domain, section, place, path, degree from (
      select domain, path, degree, case when kind = 'test' then 'tests' else 'code' end as section, count(*) over (partition by domain) as n,
        row_number() over (partition by domain, case when kind = 'test' then 'tests' else 'code' end order by degree desc, path) as place
      from (select f.domain, f.path, f.kind, coalesce(d.n, 0) as degree from files f left join (select id, count(*) as n from (select src as id from edges union all select dst from edges) group by id) d using (id)))
      where n >= 2 and place <= case section when 'tests' then 5 else 8 end"""),
    "skill_index": _with("select domain, replace(domain, '/', '-') as slug, count(*) as n_files, count(*) < 50 as skipped, case when count(*) < 50 then 'only ' || count(*) || case when count(*) = 1 then ' file' else ' files' end || ' (< 50)' end as reason from files group by domain"),
    "top_domain": _with("select domain, n from (select domain, count(*) as n, min(doc_id) as o from files group by domain order by n desc, o limit 1)"),
    "cross_domain_deps": _with(f"""select case when x.domain = '{DOMAIN}' then 'depends_on' else 'used_by' end as direction, case when x.domain = '{DOMAIN}' then y.domain else x.domain end as other, count(*) as n
      from fe join files x on x.id = src join files y on y.id = dst where type = 'imports' and x.domain <> y.domain and '{DOMAIN}' in (x.domain, y.domain) group by all"""),
    "degrees": _with("select id, count(*) as degree from (select src as id from edges union all select dst from edges) group by id"),
    "pagerank": _with(f"select id, round(r, 6) as rank from r{ITERATIONS}", *_rank_steps(ITERATIONS, UNIFORM)),
    "personalized_pagerank": _with(f"select id, round(r, 6) as rank from r{ITERATIONS}", *_rank_steps(ITERATIONS, SEEDED)),
    "pagerank_by_joins": _with("select id, round(r, 6) as rank from r3", *_rank_steps(3, UNIFORM)),
    "bfs_distances": _with("select id, min(dist) as dist from (select id, 0 as dist from b0 union all select dst, 1 from b1 union all select dst, 2 from b2) group by id",
        f"b0 as (select id from files where doc_id in ({SEEDS}))", "b1 as (select dst from fe where src in (select id from b0))", "b2 as (select dst from fe where src in (select dst from b1))"),
    "keywords": f"""select doc_id, count(*) as n, count(distinct w) as n_distinct from (select doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) as w from documents)
      where length(w) >= 3 and w not in ({_list(STOP_WORDS)}) group by doc_id""",
    "matched_domains": _with(MATCHED),
    "scored_files": _with("select path, round(score, 6) as score, tokens from scored order by scored.score desc, path limit 200", *_rank_steps(ITERATIONS, UNIFORM), SCORED),
    "context_pack": _with("select path, round(score, 6) as score, mode, reason, tokens, estimated from packed", *_rank_steps(ITERATIONS, UNIFORM), SCORED, "best as (select 0 as pack_id, * from scored order by score desc, path limit 50)", *_pack("best", "8000")),
    "packer": _with("select pack_id, path, mode, reason, estimated from packed", MANY, *_pack("many", "cast('0x' || md5(pack_id)[1:4] as bigint) % 12000")),
    "token_ledger": _with("""select *, baseline - packed as saved, round((baseline - packed) * 100 / baseline, 2) as percent, round(baseline / packed, 2) as ratio from
      (select cast(sum(greatest(20, ceil(coalesce(size, 500) / 4))) as bigint) as baseline, count(*) as baseline_files from files),
      (select coalesce(max(estimated), 0) as packed, count(*) as packed_files, count(*) filter (mode = 'full') as n_full, count(*) filter (mode = 'excerpt') as n_excerpt, count(*) filter (mode = 'summary') as n_summary from packed where mode <> 'excluded')""",
        *CONTEXT),
    "context_content": _with("""select p.path, mode, length(shown) as n_chars, sha256(shown) as shown_sha256 from (
        select path, mode, case when text is null then null when mode = 'full' then text when mode = 'excerpt' then array_to_string(string_split(text, chr(10))[1:50], chr(10)) || chr(10) || '// ... (excerpt)' else '// Summary: ' || path || ' - ' || reason end as shown
        from packed join files using (path) join documents using (doc_id) where mode <> 'excluded') p""", *CONTEXT),
    "type_counts": _with("""select source, coalesce(counts, '(none)') as counts from (select distinct source from files) left join (
        select source, string_agg(kind || '=' || n, ', ' order by kind) as counts from (select source, kind, count(*) as n from files group by all having count(*) > 1) group by source) using (source)"""),
    "spec_parts": _with("""select 'domain' as part, 'name' as key, (select domain from top) as value union all select 'budget', 'most', '8000' union all select 'budget', 'used', cast(coalesce(max(estimated), 0) as varchar) from kept
      union all select 'file', path, reason || '|' || mode || '|' || """ + KEBAB.format("regexp_replace(regexp_extract(path, '[^/]*$'), '\\.(ts|py)$', '')") + """ from kept
      union all select case when x.domain = (select domain from top) then 'depends_on' else 'used_by' end, case when x.domain = (select domain from top) then y.domain else x.domain end, cast(count(*) as varchar)
        from fe join files x on x.id = src join files y on y.id = dst where type = 'imports' and x.domain <> y.domain and (select domain from top) in (x.domain, y.domain) group by all
      union all select distinct 'touches domain', 'domain:' || source, source from kept join files using (path)""",
        *CONTEXT, "kept as (select * from packed where mode <> 'excluded')", "top as (select domain from (select domain, count(*) as n, min(path) as o from kept join files using (path) group by domain order by n desc, o limit 1))"),
    "select_agent_context": _with(_manifest("t"), *CONTEXT, ENTRIES, "t as (select list(distinct domain) as touched from packed join files using (path) where mode <> 'excluded')"),
    "change_manifests": _with(_manifest("t", "change_id, ", True), ENTRIES, FOCUS, "t as (select change_id, list(distinct domain) as touched from focus group by change_id)"),
    "change_graph_stats": _with("""select change_id, 'node' as part, type, count(*) as n from nodes join c1 using (id) group by change_id, type
      union all select a.change_id, 'edge', type, count(*) from edges join c1 a on a.id = src join c1 b on b.id = dst and b.change_id = a.change_id group by a.change_id, type""", FOCUS, *_change_reach("edges")),
    "change_refresh": _with("""select change_id, 'refreshed' as state, (select count(*) from c1 join nodes using (id) where c1.change_id = f.change_id) as n_nodes,
        (select count(*) from fe join c1 a on a.id = src join c1 b on b.id = dst where a.change_id = f.change_id and b.change_id = f.change_id) as n_edges from (select distinct change_id from focus) f
      union all values ('empty', 'skipped', null, null), ('none', 'skipped', null, null)""", FOCUS, *_change_reach("fe")),
    "artifact_status": _with("""select 'scan' as name, true as present, cast(67 as bigint) as age_minutes, count(*) || ' files' as detail from files
      union all select 'graph', true, 17, (select count(*) from edges) || ' edges, ' || (select count(*) from nodes) || ' nodes' union all select 'plan', true, 2, 'status: plan_only' union all select 'pack', false, null, 'not found'"""),
    "visible_nodes": _with("""select n.id, n.type, n.label, n.path, f.doc_id is not null and f.doc_id % 9 = 0 as in_pack, case when f.doc_id % 9 = 0 then 'seed' end as reason, case when f.doc_id % 9 = 0 then 'full' end as mode,
      case when f.id is not null then 'grp:' || f.domain || coalesce('/' || nullif(regexp_replace(f.path[length(f.domain) + 2:], '/?[^/]*$', ''), ''), '') end as parent from nodes n left join files f using (id)"""),
    "visible_edges": _with("select src, dst, type, weight from edges where src in (select id from v) and dst in (select id from v)", "v as (select id from nodes where type <> 'file' union select id from files where doc_id % 9 = 0)"),
    "legend_counts": _with("""select 'kind' as legend, kind as entry, count(*) as n from nodes where kind is not null group by kind union all select 'node', 'in pack', count(*) from files where doc_id % 9 = 0 having count(*) > 0
      union all select 'edge', type, count(*) from edges group by type"""),
    "closed_neighbourhood": _with("select 'domain:src2' as id union select src from edges where dst = 'domain:src2' union select dst from edges where src = 'domain:src2'"),
    "file_summaries": _with("""select id, cast(0 as bigint) as defines, (select count(*) from fe where src = id and type = 'imports') as imports, (select count(*) from fe where dst = id and type = 'imports') as imported_by,
      (select count(*) from fe where dst = id and type = 'tests') as tested_by from files"""),
    "group_leaves": _with("""select 'grp:' || domain as "group", cast(null as varchar) as parent, count(*) as n_leaves from files group by domain
      union all select 'grp:' || domain || '/' || split_part(path, '/', 3), 'grp:' || domain, count(*) from files group by domain, split_part(path, '/', 3)"""),
    "viewer_payload": _with("""select 'node' as part, '{"id":"' || id || '","type":"' || type || '"}' as line from nodes union all select 'edge', '{"src":"' || src || '","dst":"' || dst || '","type":"' || type || '"}' from edges"""),
    "artifact_constraints": _with("""select artifact, "column", problem, count(*) as n from (
      select 'plan' as artifact, 'task' as "column", 'minimum' as problem from files where doc_id % 5 = 0 union all select 'plan', 'path', 'required' from files where doc_id % 7 = 0 union all select 'plan', 'max_loc', 'minimum' from files where doc_id % 3 = 0
      union all select 'plan', 'status', 'enum' from files where doc_id % 11 = 0 union all select 'spec', 'change_id', 'pattern' from files where doc_id % 13 = 0 union all select 'spec', 'mode', 'enum' from files where doc_id % 17 = 0
      union all select 'spec', 'domain', 'pattern' from files) group by all"""),
    "change_nodes": _with("select id, type from nodes where id in (select id from h2)", *_reach("fe", 2)),
    "change_edges": _with("select * from edges where type <> 'belongs_to_domain' and src in (select id from h1) and dst in (select id from h1)", *_reach("fe", 1)),
    "change_stats": _with("select 'node' as part, type, count(*) as n from nodes where id in (select id from h1) group by type union all select 'edge', type, count(*) from edges where src in (select id from h1) and dst in (select id from h1) group by type", *_reach("edges", 1)),
    "topological_tiers": """select 'r' || r_regionkey as id, 0 as tier from region union all select 'n' || n_nationkey, 1 from nation
      union all select distinct 's' || s_suppkey, 2 from supplier union all select unnest(['x', 'y', 'z']), 3""",
    "guardrail_violations": _with(f"""select case when {_glob_any(["**/*.html", "en/9*"])} then 'forbiddenPath' else 'outsideAllowedFiles' end as rule, path, cast(null as varchar) as detail from u
      where ({_glob_any(["**/*.html", "en/9*"])}) or not ({_glob_any(["en/**", "fr/?*", "de/1*"])})
      union all select 'maxLocDelta', null, '1200 > 1000' union all select 'maxFilesChanged', null, count(*) || ' > 50' from u having count(*) > 50""", "u as (select distinct path from urls where path <> '')"),
    "plan_tasks": _with("select row_number() over (order by path) as task, path, greatest(1, least(1000, 50 * count(*) over ())) as max_loc, count(*) over () + 2 as max_files from packed where mode in ('full', 'excerpt') and path in (select path from files where doc_id % 2 = 0)",
        *CONTEXT),
    "neighbors": _with("""select distinct * from (
        select case type when 'imports' then 'imports' else 'tests' end as section, dst[6:] as item from fe where src = (select id from me)
        union all select case type when 'imports' then 'imported_by' else 'tested_by' end, src[6:] from fe where dst = (select id from me)
        union all select 'same_domain', path from files where source = (select source from me) and id <> (select id from me))""", "me as (select * from files where doc_id = 20)"),
    "domain_map": _with("""select domain, count(*) as n_files, count(*) filter (kind = 'code') as n_code, count(*) filter (kind = 'test') as n_tests, coalesce(any_value(o.n), 0) as imports_out, coalesce(any_value(i.n), 0) as imports_in
      from files left join (select x.domain, count(*) as n from fe join files x on x.id = src join files y on y.id = dst where type = 'imports' and x.domain <> y.domain group by x.domain) o using (domain)
      left join (select y.domain, count(*) as n from fe join files x on x.id = src join files y on y.id = dst where type = 'imports' and x.domain <> y.domain group by y.domain) i using (domain) group by domain"""),
    "flow_steps": "select 'step:flow:7#' || turn as step_id, turn as ord, 'turn ' || turn as file, role as layer from conversations where conv_id = 7",
    "edge_panel": _with("""select id, dir, count(*) as n, greatest(0, count(*) - 6) as more, string_agg(other, ',' order by k) filter (k <= 6) as first from (
      select *, row_number() over (partition by id, dir order by other, type) as k from (select src as id, 'out' as dir, dst as other, type from edges union all select dst, 'in', src, type from edges)) group by id, dir"""),
    "node_type_counts": _with("select id, type, cast(sum(o) as bigint) as n_out, cast(sum(i) as bigint) as n_in from (select src as id, type, 1 as o, 0 as i from edges union all select dst, type, 0, 1 from edges) group by id, type"),
    "sidebar": _with("select domain, coalesce(nullif(regexp_replace(path[length(domain) + 2:], '/?[^/]*$', ''), ''), '(root)') as folder, count(*) as n_files, count(*) filter (doc_id % 9 = 0) as n_packed from files group by all"),
    "search_nodes": _with("select id, label, path from nodes where contains(lower(label), 'doc_1') or contains(lower(path), 'doc_1')"),
    "sync_report": _with("""select (select string_agg(domain || '=' || n, ',' order by domain || '=' || n) from (select domain, count(*) as n from files where doc_id % 10 = 0 group by domain)) as domains,
      (select count(*) from files where doc_id % 10 = 0) as n_changed, true as pack_affected, true as graph_stale, 'rebuild graph,rebuild context' as advice"""),
    "dot_lines": _with(f"""select 0 as part, '  "' || {_dot("id")} || '" [label="' || {_dot("label")} || '",shape=' || {_case(NODE_SHAPE, "type", OTHER_SHAPE)} || ',style="filled",fillcolor="' || {_case(NODE_FILL, "type", OTHER_FILL)}
        || '",color="#30363d",tooltip="' || {_dot("coalesce(path, label)")} || '"];' as line from nodes
      union all select 1, '  "' || {_dot("src")} || '" -> "' || {_dot("dst")} || '" [label="' || type || '",color="' || {_case({k: v[0] for k, v in EDGE_STYLE.items()}, "type", OTHER_STYLE[0])} || '",style="'
        || {_case({k: v[1] for k, v in EDGE_STYLE.items()}, "type", OTHER_STYLE[1])} || '",penwidth=' || format('{{:.1f}}', weight) || '];' from edges"""),
    "graphml_lines": _with(f"""select 0 as part, '    <node id="' || {_xml("id")} || '">' || chr(10) || {_data("d_label", "label")} || {_data("d_type", "type")} || {_data("d_path", "path")} || {_data("d_kind", "kind")} || {_data("d_lang", "lang")} || '    </node>' as line from nodes
      union all select 1, '    <edge id="e' || (row_number() over (order by src, dst, type) - 1) || '" source="' || {_xml("src")} || '" target="' || {_xml("dst")} || '">' || chr(10) || {_data("d_etype", "type")}
        || '      <data key="d_weight">' || case when weight = floor(weight) then cast(cast(weight as bigint) as varchar) else cast(weight as varchar) end || '</data>' || chr(10) || '    </edge>' from edges"""),
    "file_list": _with("select path, '- ' || path || ' [score=' || format('{:.4f}', score / 1009) || ']' as line from many", MANY),
    "name_shapes": f"""select p_partkey, {SLUG.format("p_name || ' / ' || p_brand")} as slug, {KEBAB.format("replace(p_name, ' ', 'Xy') || '_' || p_brand")} as kebab,
      array_to_string(list_transform(list_filter(regexp_split_to_array(p_name || '-' || p_type, '[-_\\s]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') as title,
      {KEBAB.format("case when p_size % 2 = 0 then string_split(p_type, ' ')[-1] else 'SomeHTTPFile' end")} as purpose,
      {SLUG.format("case when p_size % 3 = 0 then 'cli' else 'get' end || '-' || lower(p_brand) || '/id/x'")} as endpoint,
      replace(replace(replace('<i>' || p_name || '&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as html, replace(replace(p_type || '/' || p_brand, '/', '-'), '-', '/') as domain,
      [{", ".join(f"'{b}'" for _, b in DOMAIN_COLOURS)}][abs(list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(p_name, ''), lambda c: cast(ascii(c) as bigint))),
        lambda a, c: (((a * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648)) % {len(DOMAIN_COLOURS)} + 1] as colour,
      {_xml("'<a b=''' || p_name || '''>&\"'")} as xml, {_dot("'a\"' || chr(92) || p_name")} as dot from part""",
    "url_shapes": _with(f"""select page_id, regexp_extract(path, '[^/]*$') as base, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end as dir, {extname("path")} as ext,
      {_normal("'a/./b/../' || path || '/../x'")} as normal, {DOMAIN_OF.format("path")} as domain, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') end as sub from urls"""),
}
