"""DuckDB SQL for the opN queries that SQL can express. The others are tested against brute force."""

from __future__ import annotations

import math

from .license_scan import CONTAINED, PHRASES, TEMPLATES, window_of
from .secret_scan import BASE, MORE, OWNERS, REPOSITORIES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_str, items)) + "]"


def _license() -> str:
    at = " or ".join("(" + " and ".join(f"w[i + {k + 1}] = {_str(x)}" for k, x in enumerate(p.split())) + ")" for p, _ in PHRASES)
    base = ", ".join(f"case when contains(flat, {_str(f' {p} ')}) then {_str(label)} end" for p, label in PHRASES)
    held = []
    for label, text in TEMPLATES:
        own, w = sorted(set(text.split())), window_of(text, CONTAINED)
        need = math.ceil(CONTAINED * len(own) - 1e-9)
        held.append(f"select doc_id, {_str(label)} as label, n / {len(own)} as part from (select doc_id, len(list_intersect(list_distinct(b), {_list(own)})) as n from (select doc_id, unnest(list_transform(range(0, greatest(ceil(len(w) / {w})::bigint, 1)), lambda k: w[k * {w} + 1:k * {w} + {2 * w}])) as b from t)) where n >= {need}")
    return f"""
    with d as (select doc_id, {_LOWER} as low from documents),
    t as (select doc_id, low, regexp_extract_all(low, '{_WORD}') as w from d),
    s as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as flat, list_filter(range(0, len(w)), lambda i: coalesce({at}, false)) as starts from t),
    base as (select doc_id, len(w) as n_words, starts, list_filter([{base}], lambda x: x is not null) as found from s),
    held as ({" union all ".join(held)}),
    more as (select doc_id, list(distinct label) as labels, max(part) as part from held group by doc_id)
    select base.doc_id, n_words::bigint as n_words, len(starts)::bigint as n_base, list_min(starts)::bigint as first_word, list_max(starts)::bigint as last_word,
      array_to_string(list_sort(list_distinct(found)), ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(found, coalesce(labels, [])))), ',') as labels,
      case when len(starts) > 0 then 1.0 else coalesce(part, 0.0) end::double as score
    from base left join more on base.doc_id = more.doc_id"""


_MIXING = r"""
with recursive sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
cells as (select source, size, count(*) as n from sized group by all),
sources as (select source, sum(size * n)::bigint as source_size, sum(n) filter (size > 0)::bigint as docs from cells group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from sources),
lv as (select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (o rows between current row and unbounded following) as level from w window o as (order by source_size / weight, source nulls last)),
top as (select max(level) filter (level * weight <= 3 * source_size) as level from lv),
goal as (select source, source_size, source_size / docs as mean, least(weight * coalesce(top.level, 0), 3.0 * source_size) as target from lv, top),
c0 as (select c.source, size, n, source_size, target, size / mean as z from cells c join goal g on c.source is not distinct from g.source),
halves as (select source, target, -700.0::double as lo, 700.0::double as hi, 0 as i from goal where source_size > 0 and target < 3 * source_size * (1 - 1e-12)
  union all select h.source, h.target, case when sum(case when (lo + hi) / 2 * z >= ln(3) then 3.0 else exp((lo + hi) / 2 * z) end * size * n) < h.target then (lo + hi) / 2 else lo end,
    case when sum(case when (lo + hi) / 2 * z >= ln(3) then 3.0 else exp((lo + hi) / 2 * z) end * size * n) < h.target then hi else (lo + hi) / 2 end, i + 1
  from halves h join c0 on h.source is not distinct from c0.source where i < 90 group by h.source, h.target, lo, hi, i),
dual as (select source, (lo + hi) / 2 as x from halves where i = 90),
c1 as (select c0.source, size, n, source_size, c0.target, case when source_size = 0 or size = 0 then 0.0 when x is null or x * z >= ln(3) then 3.0 else exp(x * z) end as rate from c0 left join dual on c0.source is not distinct from dual.source),
c2 as (select *, floor(sum(rate * n) over (partition by source order by size desc) + 0.5) as upto from c1),
c3 as (select *, case when size > 0 then greatest(0, least(upto - coalesce(lag(upto) over (partition by source order by size desc), 0), 3 * n)) else 0 end::bigint as k from c2),
c4 as (select *, round(target - sum(k * size) over (partition by source))::bigint as lack from c3),
c5 as (select *, case when size = 0 then 0 when lack > 0 then 3 * n - k else k end as room from c4),
c6 as (select *, greatest(abs(lack) - (sum(room * size) over (partition by source order by size) - room * size), 0) as rest from c5),
c7 as (select *, k + sign(lack)::bigint * least(room, floor(rest / greatest(size, 1)))::bigint as copies from c6),
ranked as (select s.doc_id, s.size, c.source_size, c.target, c.n, c.copies, md5(s.doc_id::varchar) as h, greatest(ceil(c.n / 2000), 1)::bigint as parts, s.source
  from sized s join c7 c on s.source is not distinct from c.source and s.size = c.size),
r2 as (select *, row_number() over (partition by source, size order by ('0x' || h[1:8])::bigint % parts, h) - 1 as rank from ranked)
select doc_id, size, source_size, target::double as target, (size * (copies // n + case when rank < copies % n then 1 else 0 end))::bigint as taken from r2"""

_JACCARD = rf"""
with recursive t as (select doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from t),
n as (select doc_id, count(*) as n from g group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 180 * o >= 80 * (x.n + y.n)),
sym as (select a, b from links union select b, a from links),
reach(node, far) as (select a, b from sym union select reach.node, sym.b from reach join sym on reach.far = sym.a),
low as (select node, least(min(far), node) as c from reach group by node)
select t.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(low.c, t.doc_id)::bigint as component_id
from t left join n on n.doc_id = t.doc_id left join low on low.node = t.doc_id"""

_TOPK = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5"""


def _secrets() -> str:
    kinds = []
    for i, (kind, pattern, group, least, *having) in enumerate((*BASE, *MORE)):
        # a flag inside a pattern also holds for the split
        also = "".join(f" and regexp_matches(v, {_str(p)})" for p in (having[0] if having else ()))
        kinds.append(
            f"select doc_id, owner, repo, {i} as ord, {_str(kind)} as kind, list_sum(list_transform(p[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) as a, length(m[j]) as n, v from ("
            f"select doc_id, owner, repo, p, m, unnest(range(1, len(m) + 1)) as j, unnest(v) as v from (select doc_id, owner, repo, string_split_regex(text, {_str(pattern)}) as p, regexp_extract_all(text, {_str(pattern)}, 0) as m, regexp_extract_all(text, {_str(pattern)}, {group}) as v from d)) where length(v) >= {least}{also}"
        )
    first = len(BASE)
    return f"""
    with d as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as owner, coalesce(lang, '') as repo from documents),
    x as (select doc_id, owner, repo, ord, kind, a::bigint as a, (a + n)::bigint as e, sha256(v) as h from ({" union all ".join(kinds)})),
    base as (select * from x where ord < {first}),
    free as (select * from x where ord >= {first} and not exists (select 1 from base b where b.doc_id = x.doc_id and b.a < x.e and x.a < b.e)),
    cand as (select * from base union all select * from free),
    verdict as (select h, count(distinct owner) >= {OWNERS} or count(distinct owner) > 1 and count(distinct owner || chr(1) || repo) >= {REPOSITORIES} as example from cand group by h),
    told as (select cand.*, example from cand join verdict using (h)),
    agg as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
      string_agg(kind || ':' || a || ':' || e, ',' order by a, ord) filter (ord < {first}) as base, string_agg(kind || ':' || a || ':' || e, ',' order by a, ord) filter (ord < {first} or not example) as spans,
      count(*) filter (not example) as n_live, count(*) filter (example) as n_example from told group by doc_id)
    select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
      coalesce(n_live, 0)::bigint as n_live, coalesce(n_example, 0)::bigint as n_example from d left join agg on d.doc_id = agg.doc_id"""


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RANKED = rf"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
x as (select doc_id, w, len(w) as n, row_number() over () as r from d where len(w) > 0),
c as (select count(*) as docs, sum(n)::bigint as terms from x),
tf as (select r, t, count(*) as tf from (select r, unnest(w) as t from x) group by all),
q as (select qi, item_id, unnest(t) as t from (select row_number() over () as qi, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark)),
w as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from (select t, count(*) as df from tf where t in (select t from q) group by t), c),
p as (select tf.r, tf.t, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * x.n * c.docs) // c.terms))) as s from tf join w using (t) join x using (r), c),
s as (select qi, item_id, r, sum(s)::bigint as score from q join p using (t) group by all),
k as (select qi, item_id, x.doc_id, score, (row_number() over (partition by qi order by score desc, x.doc_id))::int as rank from s join x using (r) where score > 0)
select item_id, rank, doc_id, score from k where rank <= 50"""

#: CRC-32 of a decimal number, bit by bit.
_CRC = "xor(list_reduce([4294967295::bigint] || list_transform(string_split({c}::varchar, ''), lambda x: ascii(x)::bigint), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)), 4294967295)"
_TRIE = rf"""with t as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
n as (select c, row_number() over (partition by c order by turn nulls first, role, sha256(text)) as i, {{'role': role, 'text': text}} as turn from t),
ids as (select distinct c from t), k as (select c, c - c % 20 as base, {_CRC.format(c="c")} % 4 as h from ids),
b as (select k.c, n.i, n.turn from k join n on n.c = k.base where n.i <= h union all select k.c, n.i - h + 1000000, n.turn from k join n on n.c = k.c where n.i > h),
m as (select c, row_number() over (partition by c order by i) as d, turn from b),
a as (select c, list(turn order by d) as turns from m group by c),
f as (select ids.c, coalesce(turns, []) as turns from ids left join a using (c)),
x as (select c, len(turns) as total, unnest(range(0, len(turns) + 1)) as d, turns from f),
p as (select c, total, d, md5(turns[1:d]::json::varchar) as own, md5(turns[1:d - 1]::json::varchar) as above, case when d > 0 then len(regexp_extract_all(turns[d].text, '[^\x20\x09-\x0D]+')) else 0 end as words from x),
g as (select d, own, any_value(above) as above, min(c) as conv_id, count(*) as n_convs, any_value(words) as words, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (total = d), '')) as ends_sha256 from p group by d, own),
kids as (select d - 1 as d, above as own, count(*) as n_children from g where d > 0 group by all),
full_ as (select g.*, coalesce(n_children, 0) as n_children from g left join kids using (d, own)),
u as (select distinct p.d, p.own, q.d as e, q.own as below from p join p q on p.c = q.c and q.d >= p.d),
s as (select u.d, u.own, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * words)::bigint as saved_tokens from u join full_ on full_.d = u.e and full_.own = u.below group by all)
select x.conv_id, x.d::bigint as depth, y.conv_id as parent_conv_id, x.n_convs::bigint as n_convs, x.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens, x.ends_sha256
from full_ x join s on s.d = x.d and s.own = x.own left join g y on y.d = x.d - 1 and y.own = x.above"""

ORACLES = {"op1_license_scan": _license(), "op3_source_mixing": _MIXING, "op6_ngram_jaccard_join": _JACCARD, "op7_exact_topk": _TOPK, "op8_secret_scan": _secrets(), "op12_ranked_search": _RANKED, "op13_prefix_trie": _TRIE}
