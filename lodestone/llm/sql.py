"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

_WORD = "[^\\x20\\x09-\\x0D]+"

OP1 = f"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
s as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) end) as s from w),
n as (select d.doc_id, count(s.s) as n from documents d left join s using (doc_id) group by 1),
links as (
    select a.doc_id as a, b.doc_id as b from s a join s b on a.s = b.s and a.doc_id < b.doc_id
    join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
    group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join both_ways l on r.b = l.a)
select n.doc_id, n.n as n_shingles, c.component_id, n.doc_id = c.component_id as kept
from n join (select a as doc_id, min(b) as component_id from reach group by 1) c using (doc_id)
"""

_ENTITIES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def _decoded(x: str) -> str:
    for name, char in _ENTITIES:
        x = f"replace({x}, '{name}', '{char}')"
    return x


OP5 = f"""
with a as (
    select page_id, url, regexp_replace(replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|<footer>|$)', 1), '<br>', ' '), '</?b>', '', 'g') as a from pages),
b as (select page_id, url, list_filter(list_transform(regexp_split_to_array(a, '</?(?:h1|p)>'), lambda x: trim(regexp_replace({_decoded('x')}, '\\s+', ' ', 'g'))), lambda x: x <> '') as b from a),
t as (select page_id, url, coalesce(array_to_string(b, chr(10) || chr(10)), '') as text from b)
select page_id, url, text, length(text) as n_chars from t
"""

OP8 = """
with one as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null
    qualify row_number() over (partition by conv_id, turn order by coalesce(role, ''), coalesce(text, '')) = 1),
num as (select *, row_number() over (partition by conv_id order by turn) as k from one),
pairs as (select distinct conv_id // 2 as pair_id, conv_id // 2 * 2 as chosen_id, conv_id // 2 * 2 + 1 as rejected_id from one),
turns as (
    select p.pair_id, c.k, 'c' as side, c.role, c.text from pairs p join num c on c.conv_id = p.chosen_id
    union all select p.pair_id, r.k, 'r', r.role, r.text from pairs p join num r on r.conv_id = p.rejected_id),
places as (
    select pair_id, k, count(*) = 2 and min(role) = max(role) and min(text) = max(text) as same from turns group by 1, 2),
prefix as (
    select pair_id, coalesce(min(k) filter (where not same) - 1, max(k)) as n from places group by 1),
shown as (select t.*, '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) as s, f.n from turns t join prefix f using (pair_id)),
placed as (
    select *, coalesce(sum(length(s)) over (partition by pair_id, side order by k rows between unbounded preceding and 1 preceding), 0)::bigint as begins from shown where k > n),
masks as (
    select pair_id, side, string_agg((begins + 13 + length(role)) || '-' || (begins + length(s)), ' ' order by k) as mask from placed where role = 'assistant' group by 1, 2)
select p.pair_id, p.chosen_id, p.rejected_id, any_value(s.n) as n_prompt_turns,
    coalesce(string_agg(s.s, '' order by s.k) filter (where s.side = 'c' and s.k <= s.n), '') as prompt,
    coalesce(string_agg(s.s, '' order by s.k) filter (where s.side = 'c' and s.k > s.n), '') as chosen,
    coalesce(any_value((select mask from masks m where m.pair_id = p.pair_id and m.side = 'c')), '') as chosen_mask,
    coalesce(string_agg(s.s, '' order by s.k) filter (where s.side = 'r' and s.k > s.n), '') as rejected,
    coalesce(any_value((select mask from masks m where m.pair_id = p.pair_id and m.side = 'r')), '') as rejected_mask
from pairs p join shown s using (pair_id) group by 1, 2, 3
"""

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
OP10 = f"""
with i as (select distinct item_id, {_TOKENS} as h from benchmark),
ii as (select item_id, h, row_number() over (order by item_id, h) as item from i where len(h) >= 8),
d as (select row_number() over (order by doc_id, text) as r, doc_id, {_TOKENS} as h from documents),
places(k, a, b, c) as (values (0, 0, 3, 6), (1, 0, 4, 9)),
si as (select item, k, o, [h[o + 1], h[o + 2], h[o + b + 1], h[o + b + 2], h[o + c + 1], h[o + c + 2]] as key from (select *, unnest(generate_series(0, len(h) - 2 - c)) as o from ii, places)),
sd as (select r, k, o, [h[o + 1], h[o + 2], h[o + b + 1], h[o + b + 2], h[o + c + 1], h[o + c + 2]] as key from (select *, unnest(generate_series(0, len(h) - 2 - c)) as o from d, places)),
hits as (select distinct sd.r, si.item, sd.o - si.o as shift from sd join si on sd.k = si.k and sd.key = si.key),
al as (
    select d.r, d.doc_id, ii.item_id, shift, greatest(-shift, 0) as first, least(len(ii.h), 20) as size, ii.h as ih, d.h as dh,
        least(len(ii.h) - greatest(-shift, 0), len(d.h) - greatest(shift, 0)) as n
    from hits join d using (r) join ii using (item)),
eq as (select *, list_transform(generate_series(1, n), lambda j: (ih[first + j] = dh[greatest(shift, 0) + j])::int) as e from al where n >= size),
short as (select item_id, h, len(h) as size from i where len(h) between 1 and 7),
whole as (select doc_id, item_id, size, o as doc_start, size as n_equal from (select d.doc_id, s.item_id, s.size, s.h as ih, d.h as dh, unnest(generate_series(0, len(d.h) - s.size)) as o from d, short s) where dh[o + 1 : o + size] = ih),
win as (select doc_id, item_id, size, greatest(shift, 0) + o as doc_start, list_sum(e[o + 1 : o + size])::bigint as n_equal from (select *, unnest(generate_series(0, n - size)) as o from eq)
    union all select * from whole)
select doc_id, item_id, n_equal, size::bigint as n_tokens, doc_start::bigint as doc_start from win where n_equal >= 0.8 * size
qualify row_number() over (partition by doc_id, item_id order by n_equal desc, size desc, doc_start) = 1
"""

ORACLES = {"op1_near_duplicates": OP1, "op5_html_extraction": OP5, "op8_preference_format": OP8, "op10_decontamination": OP10}
