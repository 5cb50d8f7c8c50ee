"""DuckDB twins of the queries that SQL can express."""

ORACLES = {}

ORACLES["op4_chat"] = """
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  -- marks of a turn by role; each control string in a text has one more backslash
  sum(length(text) + 1
      + case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7 else 14 + length(role) end
      + len(regexp_extract_all(text, '<\\\\*/s>|<\\\\*s>|\\[\\\\*/INST\\]|\\[\\\\*INST\\]|<\\\\*</SYS>>|<\\\\*<SYS>>|\\[\\\\*/TURN\\]|\\[\\\\*TURN\\]'))
  )::bigint as formatted_chars
from rows_ group by conv_id
"""

ORACLES["op6_ego_join"] = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null
    and list_aggregate(list_transform(cast(embedding as double[]), lambda x: case when isfinite(x) then 0 else 1 end), 'sum') = 0
    and list_aggregate(list_transform(cast(embedding as double[]), lambda x: abs(x)), 'sum') > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (
  select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a)
select e.vec_id, (select count(*) from links where a = e.vec_id)::bigint as n_links,
  least(e.vec_id, coalesce((select min(b) from reach where a = e.vec_id), e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce((select min(b) from reach where a = e.vec_id), e.vec_id)) as kept
from embeddings e
"""

_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), " \
       "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op9_line_dedup"] = f"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (
  select doc_id, pos, lines[pos] as line from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as pos from split)),
keyed as (select doc_id, pos, line, {_KEY} as key from lines),
shared as (
  select key, max(doc_id) as last from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (
  select k.doc_id, k.pos, k.line, s.key is not null and k.doc_id <> s.last as gone
  from keyed k left join shared s on k.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

ORACLES["op10_warc"] = """
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as payload_bytes,
    sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""

ORACLES["op12_hard_negatives"] = """
with v as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(cast(embedding as double[]), lambda x: cast(floor(256 * x) as bigint)) as e
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(cast(embedding as double[]), lambda x: x is null or not isfinite(x))) = 0),
scored as materialized (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
    list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over w as integer) as rank, vec_id as negative_id, positive_score,
  score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not same
  and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, vec_id)
qualify row_number() over w <= 3
"""
