"""SQL twins of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

OP1 = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
forms as (
  select *, replace(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '/', '\/'), ':', '\c'), chr(10), '\n') as r,
    replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '###', '#\##') as t1,
    replace(replace(replace(text, '\', '\\'), '/', '\/'), '#', '\#') as t2
  from rows),
levels as (
  select *, case when not bool_or(regexp_matches(text, '</turn>|### [^\n:]{0,64}: ')) over c then 0
                 when not bool_or(regexp_matches(t1, '</turn>|### [^\n:]{0,64}: ')) over c then 1 else 2 end as level
  from forms window c as (partition by conv_id))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  (9 + sum(14 + length(r) + length(case level when 0 then text when 1 then t1 else t2 end)))::bigint as formatted_chars
from levels group by conv_id
"""


OP2 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
pairs as (
  select q.vec_id as query_id, d.vec_id, list_inner_product(q.v, d.v)::bigint as score
  from v q join v d on d.vec_id <> q.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) where rank <= 5
"""


OP7 = r"""
with texts as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents),
split as (
  select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from texts),
windows as (
  select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w
  from (select rid, words, unnest(range(1, len(words) - 1)) as i from split where len(words) >= 3)),
starts as (
  select rid, i, lead(i) over (partition by rid order by i) as following
  from (select *, count(*) over (partition by rid, w) as n from windows) where n > 1),
repeated as (select rid, sum(least(3, coalesce(following - i, 3)))::bigint as n from starts group by rid),
measured as (
  select s.rid, doc_id, lang, source, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines
  from split s left join repeated r on r.rid = s.rid),
judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    1000 * n_symbols // greatest(word_chars, 1) as symbols, 1000 * n_dup_lines // greatest(n_lines, 1) as dup_lines,
    1000 * n_repeat_words // greatest(n_words, 1) as repeats, least(100 * word_chars // greatest(n_words, 1), 10000) as word_length
  from measured),
entries as (
  select lang, source, 'symbols' as metric, symbols as bucket from judged where not base_failed
  union all select lang, source, 'dup_lines', dup_lines from judged where not base_failed
  union all select lang, source, 'repeats', repeats from judged where not base_failed
  union all select lang, source, 'word_length', word_length from judged where not base_failed),
sketch as (
  select 2 as level, lang, source, metric, bucket, count(*) as n from entries group by lang, source, metric, bucket
  union all select 1, lang, null, metric, bucket, count(*) from entries group by lang, metric, bucket
  union all select 0, null, null, metric, bucket, count(*) from entries group by metric, bucket),
ranked as (
  select *, sum(n) over (partition by level, lang, source, metric order by bucket) as upto, sum(n) over (partition by level, lang, source, metric) as total
  from sketch),
quartiles as (
  select level, lang, source, metric, max(total) as total, min(case when upto * 100 >= total * 25 then bucket end) as q25, min(case when upto * 100 >= total * 50 then bucket end) as q50,
    min(case when upto * 100 >= total * 75 then bucket end) as q75, min(case when upto * 100 >= total * 99 then bucket end) as q99
  from ranked group by level, lang, source, metric),
fences as (
  select level, lang, source, max(total) as total,
    max(case when metric = 'symbols' then q75 + case when q75 > q25 then 3 * (q75 - q25) else 30 end end) as h1,
    max(case when metric = 'dup_lines' then q99 + case when q99 > q50 then q99 - q50 else 500 end end) as h2,
    max(case when metric = 'repeats' then q99 + case when q99 > q50 then q99 - q50 else 250 end end) as h3,
    max(case when metric = 'word_length' then q75 + case when q75 > q25 then 4 * (q75 - q25) else 250 end end) as h4,
    max(case when metric = 'word_length' then q25 - case when q75 > q25 then 4 * (q75 - q25) else 250 end end) as l4
  from quartiles group by level, lang, source),
found as (
  select j.*, f.h1, f.h2, f.h3, f.h4, f.l4, row_number() over (partition by j.rid order by f.level desc) as place
  from judged j left join fences f on (f.total >= 100 or f.level = 0)
    and (f.level = 0 or (f.lang is not distinct from j.lang and (f.level = 1 or f.source is not distinct from j.source))))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(symbols <= h1 and dup_lines <= h2 and repeats <= h3 and word_length <= h4 and word_length >= l4, false) as kept
from found where place = 1
"""


OP13 = r"""
with docs as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
places as (select rid, lang, source, unnest(terms) as term from docs),
kept as (select lang, term from places group by lang, term having count(distinct rid) >= 3),
sizes as (select lang, count(*) as v from kept group by lang),
counts as (select lang, source, term, count(*) as n from places semi join kept using (lang, term) group by lang, source, term),
groups as (select distinct lang, source from docs),
sums as (select g.lang, g.source, coalesce(sum(n), 0) as n from groups g left join counts c on c.lang = g.lang and c.source = g.source group by all),
shares as (
  select s.lang, s.source, k.term, coalesce(c.n, 0) as n, (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (s.n + z.v))::bigint as p
  from sums s join kept k on k.lang = s.lang join sizes z on z.lang = s.lang
  left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term),
whole as (
  select k.lang, k.term, (1 + (1000000000::hugeint * (sum(c.n) + 1)) // (any_value(t.n) + any_value(z.v)))::bigint as q
  from kept k join counts c on c.lang = k.lang and c.term = k.term join (select lang, sum(n) as n from sums group by lang) t on t.lang = k.lang
  join sizes z on z.lang = k.lang group by all),
met as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(m.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join met m on m.lang = a.lang and m.source = a.source and m.item = b.source),
terms as (
  select s.lang, s.source, s.term as item, ((p - q) * (p - q) // q)::bigint as value
  from shares s join whole w on w.lang = s.lang and w.term = s.term where n > 0 and p > q),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select * from (select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) as rank from terms) where rank <= 200)
select lang, source, part, item, value, rank::int as rank from ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1, "op2_voronoi_knn": OP2, "op7_quality_rules": OP7, "op13_source_divergence": OP13}
