"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({t}, '[ \t\n\v\f\r]+'), lambda w: w <> '')"

#: The same format: each text as it is, with escaped turn ends, or with all control strings escaped, whichever first
#: reads back as the text: the first turn end stands behind it, and one backslash taken away gives it again.
_OP1 = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), forms as (
  select *, [text, regexp_replace(text, '(\\*)(</turn>)', '\\\1\2', 'g'), regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g')] as bodies from rows
), made as (
  select *, '### ' || replace(replace(replace(role, '%', '%25'), chr(58), '%3A'), chr(10), '%0A') || chr(58) || chr(10)
    || coalesce(list_filter(bodies, lambda b: strpos(chr(10) || b || chr(10) || '</turn>' || chr(10), chr(10) || '</turn>' || chr(10)) = length(b) + 2
      and regexp_replace(b, '\\(\\*)(###|</turn>)', '\1\2', 'g') = text)[1], bodies[3]) || chr(10) || '</turn>' || chr(10) as formatted from forms
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(formatted))::bigint as formatted_chars, true as intact
from made group by conv_id
"""

_OP4 = (
    "with d as (select doc_id, " + _WORDS.format(t="coalesce(text, '')") + r""" as w from documents),
win as (
  select doc_id, p, hash(array_to_string(list_slice(w, p, p + 49), ' ')) as h, md5(array_to_string(list_slice(w, p, p + 49), ' ')) as m
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as p from d where len(w) >= 50)
), firsts as (select h, m, min(doc_id) as f from win group by h, m),
hit as (select win.doc_id, unnest(range(p, p + 50)) as pos from win join firsts using (h, m) where f < win.doc_id),
gone as (select distinct doc_id, pos from hit),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
kept as (
  select words.doc_id, count(*) filter (gone.pos is not null) as n_removed,
    coalesce(string_agg(word, ' ' order by words.pos) filter (gone.pos is null), '') as kept
  from words left join gone on gone.doc_id = words.doc_id and gone.pos = words.pos group by words.doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (doc_id)
"""
)

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"list_filter(regexp_split_to_array(" + _LOWER.format(t="coalesce(text, '')") + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

_OP8 = (
    "with d as (select doc_id, " + _ALNUM + " as w from documents), b as (select item_id, " + _ALNUM + r""" as w from benchmark),
win as (select distinct item_id, least(len(w), 10) as n, array_to_string(list_slice(w, p, p + 9), ' ') as t
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from b where len(w) > 0)),
sizes as (select distinct n from win),
runs as (select doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') as t
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
hit as (select runs.doc_id, runs.p, runs.n, item_id from runs join win on runs.t = win.t and runs.n = win.n),
pos as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(p, p + n)) as q from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as s from (select distinct doc_id, item_id::varchar as i from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""
)

_OP9 = (
    "with recursive d as (select doc_id, " + _WORDS.format(t=_LOWER.format(t="coalesce(text, '')")) + r""" as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, p, p + 2), ' ') as t
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 90 * (p.n + q.n - c)),
edge as (select x, y from link union all select y, x from link),
reach as (select doc_id as a, doc_id as b from d union select reach.a, edge.y from reach join edge on edge.x = reach.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(b) from reach where reach.a = d.doc_id) as component_id
from d left join n using (doc_id)
"""
)

SQL = {"op1_chat_format": _OP1, "op4_substring_dedup": _OP4, "op8_decontaminate": _OP8, "op9_jaccard_join": _OP9}
