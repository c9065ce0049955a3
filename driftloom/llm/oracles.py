"""The queries of this folder as SQL for an independent engine, where SQL can express them."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [
    ("assign", 0, _ASSIGN),
    ("access", 1, r"AKIA[A-Z0-9]+"),
    ("hex", 2, r"[0-9a-f]{24,}"),
    ("entropy_hex", 3, r"[0-9a-fA-F]{24,}"),
    ("entropy_base64", 4, r"[A-Za-z0-9+/_=-]{32,}"),
]
_FOUND = "\n  union all ".join(
    f"select rid, t, '{kind}' as kind, {rank} as rank, regexp_extract_all(t, '{regex}') as f, "
    f"regexp_extract_all(t, '{regex}', {2 if kind == 'assign' else 0}) as v, string_split_regex(t, '{regex}') as p from d"
    for kind, rank, regex in _KINDS
)
_KNOWN = "(?i)0123456789abcdef|abcdefghijklmnop|1234567890123456|example"
ORACLES["op1_secret_scan"] = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
found as ({_FOUND}),
each as (
  select rid, kind, rank, f, p, v, unnest(generate_series(1, len(f))) as i from found where len(f) > 0
),
placed as (
  select rid, kind, rank, f[i] as m, v[i] as v,
    sum(length(p[i])) over w + coalesce(sum(length(f[i])) over (w rows between unbounded preceding and 1 preceding), 0) as s
  from each window w as (partition by rid, kind order by i)
),
base as (
  select rid, kind, rank, s, s + length(m) as e from placed
  where (kind = 'assign' and length(v) >= 6) or (kind = 'access' and length(m) >= 20) or (kind = 'hex' and length(m) >= 24)
),
suspects as (
  select row_number() over () as c, rid, kind, rank, s, m, case kind when 'entropy_hex' then 24 else 32 end as w,
    case kind when 'entropy_hex' then 3.1 else 4.1 end as least
  from placed where ((kind = 'entropy_hex' and length(m) >= 24) or (kind = 'entropy_base64' and length(m) >= 32))
    and not regexp_matches(m, '^[A-Za-z+/_=-]*$') and not regexp_matches(m, '^[0-9+/_=-]+$')
    and not regexp_matches(m, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$')
),
known as (
  select c, f, p, unnest(generate_series(1, len(f))) as i from (select c, regexp_extract_all(m, '{_KNOWN}') as f, string_split_regex(m, '{_KNOWN}') as p from suspects)
),
quiet as (
  select c, b - length(f[i]) as a, b from (select *, sum(length(p[i]) + length(f[i])) over (partition by c order by i) as b from known)
),
windows as (
  select * from (select *, unnest(generate_series(0, length(m) - w)) as o from suspects) s
  where not exists (select 1 from quiet q where q.c = s.c and q.a < o + w and q.b > o)
),
characters as (select c, o, w, least, substr(m, o + k, 1) as ch from (select *, unnest(generate_series(1, w)) as k from windows)),
counted as (select c, o, w, least, ch, count(*) as n from characters group by all),
dense as (
  select c, o, w from counted group by c, o, w, least
  having sum(cast(round(n * log2(n) * 1000000) as bigint)) <= floor(w * (log2(w) - least) * 1000000)
),
marked as (select c, o, w, case when lag(o + w) over (partition by c order by o) > o then 0 else 1 end as fresh from dense),
parts as (select c, o, w, sum(fresh) over (partition by c order by o) as part from marked),
extra as (
  select rid, kind, rank, s + min(o) as s, s + max(o) + any_value(parts.w) as e
  from parts join suspects using (c) group by c, part, rid, kind, rank, s
),
spans as (select * from base union all select * from extra),
told as (
  select rid, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
    count(*) filter (where kind = 'hex') as n_hex,
    coalesce(string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, rank) filter (where rank < 3), '') as base,
    string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, rank) as spans
  from spans group by rid
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join told using (rid)
"""

ORACLES["op8_mix_sources"] = r"""
with best as (select doc_id, max(quality) as quality from labels where doc_id is not null group by doc_id),
sized as (
  select d.doc_id, d.source, cast(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    -ln((cast(cast('0x' || substr(md5(coalesce(cast(d.doc_id as varchar), '')), 1, 13) as bigint) as double) + 0.5) / 4503599627370496.0)
      / case b.quality when 0 then 0.25 when 1 then 1.0 else 0.5 end as k
  from documents d left join best b using (doc_id)
),
sources as (
  select source, cast(sum(size) as bigint) as source_size, cast([3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as weight
  from sized group by source
),
filling as (
  select source, source_size, weight, source_size * 2.0::double as cap, (select cast(sum(source_size) as double) from sources) * 1.5::double
      - coalesce(sum(source_size * 2.0::double) over (order by source_size * 2.0::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as remaining,
    sum(weight) over (order by source_size * 2.0::double / weight, source nulls last rows between current row and unbounded following) as open_weight
  from sources
),
level as (select arg_min(remaining / open_weight, cap / weight) as level from filling where remaining / open_weight * weight <= cap),
goals as (
  select source, source_size, case when (select level from level) is null then cap else least(cap, (select level from level) * weight) end as target
  from filling
),
epochs as (
  select *, cast(round(target) as bigint) as goal,
    case when source_size > 0 then cast(round(target) as bigint) // source_size else 0 end as epochs from goals
),
placed as (
  select s.doc_id, s.size, e.source_size, e.target, e.epochs, e.goal - e.epochs * e.source_size - coalesce(sum(s.size) over (
    partition by s.source order by s.k, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as room
  from sized s join epochs e on s.source is not distinct from e.source
)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, room)) as bigint) as taken from placed
"""

ORACLES["op2_near_duplicates"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
),
s as (
  select distinct doc_id, case when len(w) < 2 then w[1] else w[i] || ' ' || w[i + 1] end as s
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) as i from w where len(w) > 0)
),
ids as (select doc_id, list(s order by s) as l, count(*) as n from s group by doc_id),
classes as (select min(doc_id) as head, any_value(n) as n, l from ids group by l),
ranked as (select s.doc_id, s.s, c.n, row_number() over (partition by s.doc_id order by f.f, s.s) as p
  from s join classes c on c.head = s.doc_id join (select s, count(*) as f from s group by s) f on f.s = s.s),
prefix as (select doc_id, s, n from ranked where p <= n - ceil(0.8 * n) + 1),
pairs as (
  select distinct a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb from prefix a join prefix b on a.s = b.s and a.doc_id < b.doc_id
  where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
),
linked as (
  select a, b from pairs join s x on x.doc_id = a join s y on y.doc_id = b and y.s = x.s
  group by a, b, na, nb having 100 * count(*) >= 80 * (na + nb - count(*))
),
edges as (select a, b from linked union all select b, a from linked),
reach as (select a as node, a as cur from edges union select r.node, e.b from reach r join edges e on e.a = r.cur),
comps as (select node, min(cur) as comp from reach group by node),
named as (select d.doc_id, coalesce(i.n, 0) as n, coalesce(k.comp, c.head, d.doc_id) as component_id
  from documents d left join ids i on i.doc_id = d.doc_id left join classes c on c.l = i.l left join comps k on k.node = c.head)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from named
"""

ORACLES["op7_substring_dedup"] = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as k
  from (select rid, doc_id, w, unnest(generate_series(1, len(w) - 49)) as i from d where len(w) >= 50)
),
first as (select k, min(doc_id) as first from windows group by k having min(doc_id) < max(doc_id)),
hits as (select rid, i from windows join first using (k) where doc_id > first),
gone as (select distinct rid, i + j as i from hits, generate_series(0, 49) as g(j)),
tagged as (select d.rid, i, w[i] as word, gone.rid is not null as gone from (select rid, w, unnest(generate_series(1, len(w))) as i from d
    where rid in (select rid from hits)) d left join gone using (rid, i)),
kept as (select rid, count(*) filter (where gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (where not gone), '') as t from tagged group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed,
  sha256(case when k.rid is null then array_to_string(w, ' ') else k.t end) as kept_sha256
from d left join kept k using (rid)
"""

_VECTORS = """
v as (
  select vec_id, x from (select vec_id, cast(embedding as double[]) as x from embeddings)
  where vec_id is not null and len(x) > 0 and len(list_filter(x, lambda e: e is null or isnan(e) or isinf(e))) = 0 and len(list_filter(x, lambda e: e <> 0)) > 0
)"""
ORACLES["op4_nearest_neighbours"] = f"""
with {_VECTORS.strip()},
scored as (
  select q.vec_id as query_id, v.vec_id, list_reduce(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]), lambda a, b: a + b) as score
  from v q join v on q.vec_id % 20 = 0 and v.vec_id <> q.vec_id
),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored)
select query_id, cast(r as integer) as rank, vec_id, score from ranked where r <= 20
"""
ORACLES["op9_embedding_dedup"] = f"""
with recursive {_VECTORS.strip()},
edges as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
  where list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.95
),
reach as (select a as node, a as cur from edges union select r.node, e.b from reach r join edges e on e.a = r.cur),
comps as (select node, min(cur) as comp from reach group by node),
links as (select a, count(*) as n from edges group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(comp, vec_id) as component_id, coalesce(comp, vec_id) = vec_id as kept
from embeddings left join links on a = vec_id left join comps on node = vec_id
"""

# The given conversations hold no tool calls, so every message is plain content in the order of its turn;
# calls and their order are tested by hand-made conversations.
ORACLES["op10_chat_format"] = """
select conv_id, turn, turn as order_turn, cast(0 as bigint) as order_step,
  '{"content":' || cast(to_json(coalesce(text, '')) as varchar) || ',"role":' || coalesce(cast(to_json(role) as varchar), 'null') || '}' as json,
  cast(0 as bigint) as n_calls, cast(0 as bigint) as n_bad_calls, cast(0 as bigint) as n_unanswered, 'ok' as status
from conversations
"""

ORACLES["op13_exact_dedup"] = """
with owners as (
  select coalesce(text, '') as t, max(doc_id) as keep_id, count(*) as group_size from documents group by 1
)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(t) as text_sha256
from documents join owners on t = coalesce(text, '')
"""


# Costs and audits in one string (nine digits, then the letters), so that the least string is the cheapest edit.
_FAR = "'~'"


def _plus(key: str, cost: str, letters: str) -> str:
    return f"case when {key} = {_FAR} then {_FAR} else lpad(cast(cast(substr({key}, 1, 9) as int) + {cost} as varchar), 9, '0') || substr({key}, 10) || {letters} end"


def _if(condition: str, value: str) -> str:
    return f"case when {condition} then {value} else {_FAR} end"


_I = "2", "'I'"
# z: none, system, user, assistant as the last message; what inserts add to that.
_USER = f"least(z[3], {_plus('z[1]', *_I)}, {_plus('z[2]', *_I)}, {_plus('z[4]', *_I)})"
_WITH_INSERTS = f"lambda z: list_transform([{_USER}], lambda v: [z[1], z[2], v, least(z[4], {_plus('v', *_I)})])[1]"
_OPEN, _T = "e[2] = '0'", "cast(e[3] as int)"
_DROP = [_plus(f"a[{q}]", "3", "'D'") for q in (1, 2, 3, 4)]
_KEEP = {q: _plus(f"a[{q}]", _T, "'K'") for q in (1, 2, 3, 4)}
_TURN = {q: _plus(f"a[{q}]", f"2 + {_T}", "'R'") for q in (1, 2, 3, 4)}
_STEP = ", ".join([
    _DROP[0],
    f"least({_DROP[1]}, {_if(_OPEN + " and e[1] = 's'", _KEEP[1])})",
    f"least({_DROP[2]}, " + ", ".join(_if(_OPEN + " and e[1] = 'u'", _KEEP[q]) + ", " + _if(_OPEN, _TURN[q]) for q in (1, 2, 4)) + ")",
    f"least({_DROP[3]}, {_if(_OPEN + " and e[1] = 'a'", _KEEP[3])}, {_if(_OPEN, _TURN[3])})",
])
ORACLES["op11_repair_conversations"] = f"""
with bits as (
  select list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)),
    lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
),
kinds as (
  select conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], list_transform(string_split(
      coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda c: cast(ascii(c) as bigint))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind
  from conversations, bits
),
rows_left as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when kind = 3 then [1, 2] else [1] end) as copy
  from kinds where kind <> 0
),
ordered as (
  select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first, copy) as pos,
    rtrim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from rows_left
),
judged as (
  select *, coalesce(substr(role, 1, 1), '') as i, case when t = '' then 'blank'
    when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
    when right(t, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lead(coalesce(substr(role, 1, 1), '')) over (partition by conv_id order by pos) as next
  from ordered
),
told as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
    count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
    count(*) filter (where next is not null and i || next not in ('su', 'ua', 'au')) as illegal,
    list([i, case when fault in ('blank', 'duplicate') then '1' else '0' end, case when fault = 'truncated' then '1' else '0' end] order by pos) as line
  from judged group by conv_id
),
solved as (
  select * exclude (line, z), least(z[1], z[4]) as key from (
    select *, list_reduce(list_concat([list_transform([['000000000', {_FAR}, {_FAR}, {_FAR}]], {_WITH_INSERTS})[1]], line),
      lambda a, e: list_transform([[{_STEP}]], {_WITH_INSERTS})[1]) as z from told)
),
letters as (
  select conv_id, j, substr(key, 9 + j, 1) as letter from (select conv_id, key, unnest(generate_series(1, length(key) - 9)) as j from solved)
),
placed as (select *, sum(case when letter <> 'I' then 1 else 0 end) over (partition by conv_id order by j) as pos from letters),
sent as (
  select p.conv_id, j, letter, i, role, text, row_number() over (partition by p.conv_id order by j) as m
  from placed p left join judged r on r.conv_id is not distinct from p.conv_id and r.pos = p.pos and letter <> 'I' where letter <> 'D'
),
begun as (select conv_id, coalesce(max(case when m = 1 and letter = 'K' and i = 's' then 1 else 0 end), 0) as shift from sent group by conv_id),
named as (
  select s.conv_id, m, case when letter = 'K' then role when (m - shift) % 2 = 1 then 'user' else 'assistant' end as role,
    case when letter = 'I' then '' else text end as text
  from sent s join begun b on b.conv_id is not distinct from s.conv_id
),
mended as (select conv_id, string_agg(role || ':' || text, chr(10) order by m) as lines from named group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, cast(coalesce(cast(substr(key, 1, 9) as int), 0) as bigint) as cost, coalesce(substr(key, 10), '') as audit,
  sha256(coalesce(lines, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
  left join solved s on s.conv_id is not distinct from o.conv_id left join mended x on x.conv_id is not distinct from o.conv_id
"""

ORACLES["op12_hard_negatives"] = """
with v as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(x, lambda e: cast(floor(256 * e) as bigint)) as x
  from (select vec_id, label, cast(embedding as double[]) as x from embeddings)
  where vec_id is not null and label is not null and x is not null and len(list_filter(x, lambda e: e is null or isnan(e) or isinf(e))) = 0
),
scored as (
  select a.rid, a.vec_id as anchor_id, v.vec_id, a.label = v.label as same,
    coalesce(list_sum(list_transform(list_zip(a.x, v.x), lambda p: p[1] * p[2])), 0) as score
  from v a join v on a.vec_id % 50 = 0 and v.vec_id <> a.vec_id and len(a.x) = len(v.x)
),
near as (
  select rid, anchor_id, vec_id as positive_id, cast(score as bigint) as positive_score, row_number() over (partition by rid order by score desc, vec_id) as r
  from scored where same qualify r <= 5
)
select n.anchor_id, n.positive_id, cast(row_number() over (partition by n.rid, n.r order by s.score desc, s.vec_id) as integer) as rank,
  s.vec_id as negative_id, n.positive_score, cast(s.score as bigint) as negative_score
from near n join scored s on s.rid = n.rid and not s.same and 50 * n.positive_score <= 100 * s.score and 100 * s.score <= 95 * n.positive_score
qualify rank <= 3
"""
