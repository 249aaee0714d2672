"""DuckDB statements that give the rows of the queries SQL can express."""

from __future__ import annotations

# Exact: every pair of shingle sets that shares a shingle, then the smallest reachable doc_id.
NEAR_DEDUP_PARTS = """
words as materialized (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from {docs}),
shingles as materialized (
  select distinct doc_id, unnest(case when len(w) = 0 then []
    when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as s
  from words),
sizes as materialized (select doc_id, count(*) as n from shingles group by doc_id),
sets as materialized (
  select doc_id, md5(string_agg(s, '|' order by s)) as h from shingles group by doc_id),
heads as materialized (select h, min(doc_id) as head from sets group by h),
few as materialized (select s.doc_id, s.s from shingles s join heads on heads.head = s.doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as n_common
  from few a join few b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as materialized (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * n_common >= 75 * (x.n + y.n - n_common)),
both_ways as materialized (select a, b from links union all select b, a from links),
reach(node, seen) as (
  select distinct a, a from both_ways
  union
  select reach.node, both_ways.b from reach join both_ways on reach.seen = both_ways.a),
classes as (select node, min(seen) as component from reach group by node),
near as (
  select {docs}.doc_id, cast(coalesce(sizes.n, 0) as bigint) as n_shingles,
    coalesce(classes.component, heads.head, {docs}.doc_id) as component_id
  from {docs} left join sizes on sizes.doc_id = {docs}.doc_id
  left join sets on sets.doc_id = {docs}.doc_id
  left join heads on heads.h = sets.h
  left join classes on classes.node = heads.head)
"""

STATEMENTS: dict[str, str] = {
    "op4_near_dedup": "with recursive " + NEAR_DEDUP_PARTS.format(docs="documents")
    + " select doc_id, n_shingles, component_id, doc_id = component_id as kept from near",
    "op5_archives": """
with payloads as (
  select page_id, coalesce(html, '') as payload from pages),
measured as (
  select page_id, strlen(payload) as payload_bytes, sha256(payload) as payload_digest,
    case when strlen(payload) >= 100 then min(page_id) over (partition by payload) end as first
  from payloads)
select page_id, payload_bytes, payload_digest,
  case when page_id > first then 'revisit' else 'response' end as record_type,
  case when page_id > first then first end as refers_to
from measured""",
    "op11_infilling": """
with drawn as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
units as (
  select doc_id, text, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as u,
    ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
  from drawn),
placed as (
  select *, cast(len(u) as bigint) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as x,
    greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as y,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50
      then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from units),
parts as (
  select doc_id, text, n, form, array_to_string(u[1:x], '') as p, array_to_string(u[x + 1:y], '') as m,
    array_to_string(u[y + 1:], '') as s
  from placed)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars,
  case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts""",
}
