"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES
from .quality import RATES

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(translate({}, " + _AZ + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def jaccard_sql(n: int = 5, percent: int = 80) -> str:
    words = _SPACED.format(f"translate(coalesce(text, ''), {_AZ})")
    return f"""
with recursive w as (select doc_id, {words} as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < {n} then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) end as st
  from w),
n as (select doc_id, cast(len(st) as bigint) as k, md5(array_to_string(list_sort(st), chr(10))) as same from s),
e as (select s.doc_id, n.k, unnest(st) as g from s join n using (doc_id)),
p as (
  select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id < b.doc_id
  and 100 * least(a.k, b.k) >= {percent} * greatest(a.k, b.k)
  group by a.doc_id, b.doc_id, a.k, b.k having 100 * count(*) >= {percent} * (a.k + b.k - count(*))),
sym as (select x, y from p union all select y, x from p),
reach(x, y) as (select x, y from sym union select r.x, b.y from reach r join sym b on r.y = b.x),
c as (select x, min(y) as least from reach group by x),
links as (select x, count(*) as n_links from sym group by x),
copies as (select same, count(*) as n_copies from n where k > 0 group by same)
select n.doc_id, n.k as n_shingles, least(n.doc_id, coalesce(c.least, n.doc_id)) as component_id,
  cast(coalesce(copies.n_copies, 1) as bigint) as n_copies, cast(coalesce(links.n_links, 0) as bigint) as n_links
from n left join c on c.x = n.doc_id left join links on links.x = n.doc_id left join copies on copies.same = n.same and n.k > 0
"""


def decontamination_sql(window: int = 8, min_items: int = 2, near: int = 4) -> str:
    return f"""
with d as (select doc_id, {_ALNUM.format("coalesce(text, '')")} as ws from documents),
b as (select cast(item_id as varchar) as item, {_ALNUM.format("coalesce(text, '')")} as ws from benchmark),
bw as (
  select distinct item, least({window}, len(ws)) as k, array_to_string(ws[i:i + least({window}, len(ws)) - 1], ' ') as g
  from (select item, ws, unnest(range(1, greatest(1, len(ws) - {window - 1}) + 1)) as i from b where len(ws) > 0)),
sizes as (select distinct k from bw),
dw as (
  select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') as g
  from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from d, sizes where len(ws) >= k)),
hits as (select dw.doc_id, dw.i, dw.k, bw.item from dw join bw on bw.k = dw.k and bw.g = dw.g),
places as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + k)) as pos from hits) group by doc_id),
items as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as named from hits group by doc_id),
-- proximity: every word of a window within reach of its rarest one, then every span that starts at one of them
pos as (select doc_id, i, ws[i] as word from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from d)),
win as (select distinct g, k from bw),
need as (select g, k, word, count(*) as need from (select g, k, unnest(string_split(g, ' ')) as word from win) group by all),
often as (select word, count(*) as n from pos group by word),
rare as (select g, k, arg_min(word, n) as word, count(*) as words from (select need.*, coalesce(often.n, 0) as n from need left join often using (word)) group by g, k),
anchor as (select p.doc_id, p.i as mid, r.g, r.k, r.words from pos p join rare r using (word)),
around as (
  select a.doc_id, a.mid, a.g, a.k, a.words, n.need, p.i, p.word from anchor a join need n on n.g = a.g and n.k = a.k
  join pos p on p.doc_id = a.doc_id and p.word = n.word and p.i between a.mid - (a.k + {near} - 1) and a.mid + (a.k + {near} - 1)),
full_ as (select doc_id, mid, g, k from around group by doc_id, mid, g, k, words having count(distinct word) = words),
kept as (select around.* from around join full_ using (doc_id, mid, g, k)),
span as (
  select a.doc_id, a.mid, a.g, a.k, a.i as start, a.words, b.word from (select distinct doc_id, mid, g, k, words, i from kept) a
  join kept b on b.doc_id = a.doc_id and b.mid = a.mid and b.g = a.g and b.k = a.k and b.i between a.i and a.i + a.k + {near} - 1
  group by a.doc_id, a.mid, a.g, a.k, a.i, a.words, b.word, b.need having count(*) >= b.need),
close as (select distinct doc_id, g, k from (select doc_id, mid, g, k, start from span group by doc_id, mid, g, k, start, words having count(*) = words)),
close_items as (
  select doc_id, count(distinct item) as n_near from close join bw using (g, k) where (doc_id, item) not in (select (doc_id, item) from hits where item is not null) group by doc_id)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(named, '')) as items_sha256, coalesce(n_items, 0) >= {min_items} as contaminated,
  cast(coalesce(n_near, 0) as bigint) as n_near_items
from d left join places using (doc_id) left join items using (doc_id) left join close_items using (doc_id)
"""


def warc_sql(min_bytes: int = 100) -> str:
    return f"""
with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {min_bytes} and page_id > first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {min_bytes} and page_id > first then first end as refers_to
from f
"""


def quality_sql(min_words: int = 50, max_repeat: int = 50, fence: int = 2, prior_rows: int = 200) -> str:
    long = " union all ".join(
        f"select doc_id, lang, source, '{r}' as rate, case when {base} = 0 then 0 else ({count} * {scale}) // {base} end as x, "
        f"case when {base} > 0 then ({count} - 2 * sqrt({count})) * {scale} / {base} else 0 end as sure from m"
        for r, (count, base, scale) in RATES.items()
    )
    upper = lambda keys, name: f"""{name} as (
  select {keys}rate, cast(q90 + {fence} * (q90 - q50) as double) as f, n from (
  select {keys}rate, min(case when upto * 2 >= total then bucket end) as q50, min(case when upto * 10 >= total * 9 then bucket end) as q90, max(total) as n
  from (select *, sum(n) over (partition by {keys}rate order by bucket) as upto, sum(n) over (partition by {keys}rate) as total
    from (select {keys}rate, bucket, count(*) as n from k group by all)) group by all))"""  # noqa: E731
    return f"""
with t as (select doc_id, lang, source, coalesce(text, '') as text, {_SPACED.format("coalesce(text, '')")} as ws from documents),
lines as (
  select doc_id, sum(n - 1) as n_dup_lines from (
    select doc_id, line, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from t)
    where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id, line) group by doc_id),
g as (
  select doc_id, i, array_to_string(ws[i:i + 2], ' ') as gram from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from t where len(ws) >= 3)),
rep as (select doc_id, count(distinct pos) as n_repeat_words from (
    select doc_id, unnest([i, i + 1, i + 2]) as pos from (select *, count(*) over (partition by doc_id, gram) as n from g) where n > 1) group by doc_id),
m as (
  select doc_id, lang, source, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from t left join lines using (doc_id) left join rep using (doc_id)),
long as ({long}),
k as (select *, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) as bucket from long),
{upper("lang, source, ", "own")},
{upper("lang, ", "by_lang")},
{upper("", "every")},
f as (
  select own.lang, own.source, own.rate,
    (own.n * own.f + {prior_rows} * ((by_lang.n * by_lang.f + {prior_rows} * every.f) / (by_lang.n + {prior_rows}))) / (own.n + {prior_rows}) as fence
  from own join by_lang on own.lang is not distinct from by_lang.lang and own.rate = by_lang.rate join every on own.rate = every.rate),
bad as (
  select doc_id from k join f on k.lang is not distinct from f.lang and k.source is not distinct from f.source and k.rate = f.rate where sure > fence group by doc_id)
select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {min_words} or 100 * n_repeat_words > {max_repeat} * n_words as base_failed,
  not (n_words < {min_words} or 100 * n_repeat_words > {max_repeat} * n_words) and bad.doc_id is null as kept
from m left join bad using (doc_id)
"""


def chat_sql() -> str:
    start, end = "<|im_start|>", "<|im_end|>"
    return f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{end}{start}assistant ok'), (-1, 1, 'assistant', '{end}{start}assistant ok')),
r as (
  select *, case when contains(text, '<|') or regexp_matches(text, '<\\\\+\\|') then regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') else text end as shown from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('{start}') + length(role) + 1 + length(shown) + length('{end}') + 1) as bigint) as formatted_chars
from r group by conv_id
"""


def license_sql(percent: int = 80, block_words: int = 64) -> str:
    step = block_words // 2
    words = lambda c: _ALNUM.format(c)
    stands = lambda p: " and ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(p.split()))
    places = " union all ".join(f"select doc_id, i, '{label}' as label from spot where {stands(p)}" for p, label in PHRASES.items())
    templates = ", ".join(f"({i}, '{label}', [{', '.join(repr(w) for w in sorted(set(text.split())))}])" for i, (label, text) in enumerate(TEMPLATES))
    return f"""
with d as (select doc_id, coalesce(text, '') as text, {words("coalesce(text, '')")} as ws from documents),
spot as (select doc_id, ws, unnest(range(0, len(ws))) as i from d),
base as ({places}),
lines as (
  select doc_id, k, {words("line")} as ws from (select doc_id, unnest(range(1, len(l) + 1)) as k, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from d))
  union all select doc_id, 0 as k, ws from d),
blocks as (select doc_id, k, j, list_distinct(ws[j + 1:j + {block_words}]) as held from (select *, unnest(range(0, greatest(0, len(ws) - {step} - 1) + 1, {step})) as j from lines where len(ws) > 0)),
t(t, label, words) as (values {templates}),
met as (
  select doc_id, k, j, label, list_intersect(held, words) as shared, cast(len(list_intersect(held, words)) as double) / len(words) as containment from blocks, t
  where len(list_intersect(held, words)) >= (len(words) * {percent} + 99) // 100),
found as (
  select * from met x where not exists (
    select 1 from met y where y.doc_id = x.doc_id and y.k = x.k and y.j = x.j and y.containment > x.containment and list_has_all(y.shared, x.shared))),
b as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by doc_id),
l as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from base union select doc_id, label from found) group by doc_id),
s as (select doc_id, max(containment) as best from met group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  case when n_base > 0 then cast(1 as double) else coalesce(best, cast(0 as double)) end as score
from d left join b using (doc_id) left join l using (doc_id) left join s using (doc_id)
"""


SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": jaccard_sql(),
    "op3_benchmark_decontamination": decontamination_sql(),
    "op6_warc": warc_sql(),
    "op7_quality_rules": quality_sql(),
    "op8_chat_formatting": chat_sql(),
    "op10_license_scans": license_sql(),
}
