"""Relational queries of the engine: one declarative plan each, rendered for Spark or for the checking engine.

Every plan is written once over table names; a dialect fills in what differs between engines. Catalyst picks the
physical plan: equi joins, windows keyed by entity, partial aggregation, and no hints, as sizes are known at run time.
"""

from __future__ import annotations

from collections.abc import Callable


class Spark:
    @staticmethod
    def days(start: str, end: str) -> str:
        return f"datediff(cast({end} as date), cast({start} as date))"

    @staticmethod
    def plus_days(day: str, n: int | str) -> str:
        return f"date_add(cast({day} as date), {n})"

    @staticmethod
    def count_if(c: str) -> str:
        return f"count_if({c})"

    @staticmethod
    def sorted_join(c: str) -> str:
        return f"array_join(array_sort(collect_set({c})), ',')"

    @staticmethod
    def ordered_text(order: str, text: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({order} as o, {text} as t))), x -> x.t), '\\n')"

    @staticmethod
    def number(json: str, key: str) -> str:
        return f"cast(get_json_object({json}, '$.{key}') as bigint)"

    @staticmethod
    def year(c: str) -> str:
        return f"cast(year({c}) as bigint)"

    @staticmethod
    def text(c: str) -> str:
        return f"cast({c} as string)"

    @staticmethod
    def sha(c: str) -> str:
        return f"sha2({c}, 256)"

    @staticmethod
    def replace_all(c: str, pattern: str, to: str) -> str:
        return f"regexp_replace({c}, '{pattern}', '{to}')"

    @staticmethod
    def lines(c: str) -> str:
        return f"posexplode(split({c}, '\\n', -1)) as (i, line)"

    lines_cross = ""


class Duck(Spark):
    @staticmethod
    def days(start: str, end: str) -> str:
        return f"date_diff('day', cast({start} as date), cast({end} as date))"

    @staticmethod
    def plus_days(day: str, n: int | str) -> str:
        return f"cast(cast({day} as date) + cast({n} as integer) as date)"

    @staticmethod
    def count_if(c: str) -> str:
        return f"cast(count(*) filter (where {c}) as bigint)"

    @staticmethod
    def sorted_join(c: str) -> str:
        return f"string_agg(distinct {c}, ',' order by {c})"

    @staticmethod
    def ordered_text(order: str, text: str) -> str:
        return f"string_agg({text}, chr(10) order by {order})"

    @staticmethod
    def number(json: str, key: str) -> str:
        return f"cast(json_extract_string({json}, '$.{key}') as bigint)"

    @staticmethod
    def text(c: str) -> str:
        return f"cast({c} as varchar)"

    @staticmethod
    def sha(c: str) -> str:
        return f"sha256({c})"

    @staticmethod
    def replace_all(c: str, pattern: str, to: str) -> str:
        return f"regexp_replace({c}, '{pattern}', '{to}', 'g')"


Plan = Callable[[type[Spark]], str]
PLANS: dict[str, Plan] = {}


def plan(f: Plan) -> Plan:
    PLANS[f.__name__] = f
    return f


STAGE = "case event_type when 'signup' then 1 when 'view' then 2 when 'click' then 3 when 'purchase' then 4 else 0 end"


# ------------------------------------------------------------------ filters, sorts, paging (2.3)
@plan
def list_filtered_page(d):
    """Optional conjuncts, three-key order, one page and the total."""
    return "select o_orderkey, o_orderstatus, o_orderpriority, n_total from orders cross join (select count(*) as n_total from orders where o_orderstatus = 'O' and o_totalprice >= 1000) c where o_orderstatus = 'O' and o_totalprice >= 1000 order by o_orderpriority, o_totalprice desc, o_orderkey limit 20 offset 40"


@plan
def list_latest_three_per_key(d):
    return f"select user_id, {d.ordered_text('rn', 'event_type')} as latest, count(*) as n from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) t where rn <= 3 group by user_id"


@plan
def slice_recent_and_pinned(d):
    return "select o_orderkey, o_orderdate from orders where o_orderkey in (1, 2, 3) union select o_orderkey, o_orderdate from (select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 50) t"


@plan
def feed_merge_capped(d):
    """Union of three item kinds, newest first, capped, with the count of each kind."""
    return """with f as (select 'event' as kind, event_id as id, cast(ts as date) as day from events where event_type = 'error' union all select 'order', o_orderkey, cast(o_orderdate as date) from orders where o_orderstatus = 'F'
    union all select 'line', l_orderkey * 10 + l_linenumber, cast(l_shipdate as date) from lineitem where l_returnflag = 'R')
    select t.kind, id, day, n_kind from (select * from f order by day desc, kind, id limit 100) t join (select kind, count(*) as n_kind from f group by kind) c on c.kind = t.kind"""


@plan
def topk_load_bearing(d):
    return "select l_partkey, count(distinct l_suppkey) as n_sources, count(*) as n_edges from lineitem group by l_partkey order by n_sources desc, l_partkey limit 40"


@plan
def limit_with_truncation_flag(d):
    return "select n_nationkey, n_name, n_found > 10 as truncated from (select * from nation order by n_name limit 10) t cross join (select count(*) as n_found from nation) c"


@plan
def rank_by_enum(d):
    return "select o_orderkey, case when o_orderpriority like '1%' then 0 when o_orderpriority like '2%' then 1 else 2 end as severity, o_totalprice from orders order by severity, o_totalprice desc, o_orderkey limit 60"


# ------------------------------------------------------------------ joins and aggregates (2.4)
@plan
def hydrate_left_join(d):
    return "select h.l_orderkey, h.l_linenumber, o.o_orderpriority, c.c_name from (select * from lineitem where l_quantity >= 49) h left join orders o on h.l_orderkey = o.o_orderkey left join customer c on o.o_custkey = c.c_custkey"


@plan
def anti_join_worklist(d):
    return "select o_orderkey, o_custkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)"


@plan
def anti_join_two_keys(d):
    return "select distinct l_partkey, l_suppkey from lineitem l where not exists (select 1 from lineitem r where r.l_partkey = l.l_partkey and r.l_suppkey = l.l_suppkey and r.l_returnflag = 'R')"


@plan
def inventory_metrics(d):
    """Counts with EXISTS and NOT EXISTS, one row for each metric."""
    return """select 'orders' as metric, count(*) as n from orders union all select 'orders_with_lines', count(*) from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)
    union all select 'customers_without_orders', count(*) from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)
    union all select 'parts_sold', count(*) from part p where exists (select 1 from lineitem l where l.l_partkey = p.p_partkey)
    union all select 'suppliers_idle', count(*) from supplier s where not exists (select 1 from lineitem l where l.l_suppkey = s.s_suppkey)"""


@plan
def group_distinct_concat(d):
    return f"select o_custkey, count(*) as n, {d.sorted_join('o_orderpriority')} as priorities from orders where o_orderstatus <> 'P' group by o_custkey"


@plan
def group_count_and_distinct(d):
    return "select l_partkey, count(*) as n_edges, count(distinct l_orderkey) as n_sources from lineitem where l_linestatus = 'F' group by l_partkey"


@plan
def duplicate_keys_excess(d):
    return "select cast(sum(n - 1) as bigint) as excess, count(*) as n_keys from (select user_id, event_type, cast(ts as date) as day, count(*) as n from events group by user_id, event_type, cast(ts as date) having count(*) > 1) t"


@plan
def issuer_type_rollup(d):
    return f"select n.n_name, count(*) as total, {d.count_if("o_orderstatus = 'O'")} as n_open, {d.count_if("o_orderstatus = 'F'")} as n_done, min({d.year('o_orderdate')}) as first_year, max({d.year('o_orderdate')}) as last_year from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey group by n.n_name order by total desc, n.n_name limit 60"


@plan
def latest_outcome(d):
    """Latest non-null result of each entity, then the counts."""
    return """with r as (select o_custkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders where o_orderstatus is not null)
    select coalesce(r.o_orderstatus, 'none') as outcome, count(*) as n from customer c left join (select * from r where rn = 1) r on c.c_custkey = r.o_custkey group by coalesce(r.o_orderstatus, 'none')"""


@plan
def group_league_table(d):
    return f"select c_mktsegment, count(distinct c_custkey) as members, count(o_orderkey) as signatures, {d.count_if("o_orderstatus = 'F'")} as adopted from customer left join orders on c_custkey = o_custkey group by c_mktsegment order by signatures desc, c_mktsegment"


@plan
def roll_call_pivot(d):
    return f"select user_id % 10 as grp, {d.count_if("event_type = 'view'")} as n_view, {d.count_if("event_type = 'click'")} as n_click, {d.count_if("event_type = 'error'")} as n_error, {d.count_if("event_type = 'purchase'")} as n_purchase, count(*) as n from events group by user_id % 10"


@plan
def null_safe_history(d):
    return "select a.conv_id, a.turn, b.role as previous_role from conversations a left join conversations b on a.conv_id = b.conv_id and a.turn - 1 is not distinct from b.turn"


@plan
def risk_matrix(d):
    """Signals of each nation, weighted score and level, with the total as one more row."""
    return f"""with s as (select c.c_nationkey as k, {d.count_if("o_orderstatus = 'P'")} as pending, {d.count_if('o_totalprice > 300000')} as large, count(*) as n from orders o join customer c on o.o_custkey = c.c_custkey group by c.c_nationkey),
    t as (select s_nationkey as k, {d.count_if('s_acctbal < 0')} as debts from supplier group by s_nationkey),
    m as (select n.n_name, coalesce(s.pending, 0) as pending, coalesce(s.large, 0) as large, coalesce(t.debts, 0) as debts from nation n left join s on n.n_nationkey = s.k left join t on n.n_nationkey = t.k),
    r as (select n_name, cast(sum(pending) as bigint) as pending, cast(sum(large) as bigint) as large, cast(sum(debts) as bigint) as debts from m group by rollup (n_name))
    select coalesce(n_name, 'total') as name, pending, large, debts, pending + 2 * large + 5 * debts as score, case when pending + 2 * large + 5 * debts >= 200 then 'high' when pending + 2 * large + 5 * debts >= 40 then 'medium' else 'low' end as level from r"""


@plan
def filter_bucket_counts(d):
    return f"select {d.count_if('l_quantity < 10')} as small, {d.count_if('l_quantity >= 40')} as large, {d.count_if('l_discount > 0.05')} as cheap, {d.count_if("l_returnflag = 'R'")} as returned, {d.count_if("l_linestatus = 'O'")} as open, count(*) as n from lineitem"


@plan
def family_state_counts(d):
    return "select source, lang, count(*) as n, max(n_chars) as longest from documents group by source, lang"


@plan
def ordered_text_concat(d):
    return f"select conv_id, {d.sha(d.ordered_text('turn', 'text'))} as text_sha, count(*) as n from conversations group by conv_id"


@plan
def json_conditional_sums(d):
    k = d.number("props", "k")
    return f"select event_type, cast(sum(case when {k} >= 50 then 1 else 0 end) as bigint) as high, cast(sum(coalesce({k}, 0)) as bigint) as total from events group by event_type"


@plan
def id_or_key_lookup(d):
    """An OR join as a union of two equi joins, the exact id preferred."""
    return """with w as (select o_orderkey as id, o_custkey as alt from orders),
    u as (select w.id, c.c_custkey, 0 as rank from w join customer c on w.id = c.c_custkey union all select w.id, c.c_custkey, 1 from w join customer c on w.alt = c.c_custkey)
    select id, c_custkey, rank from (select *, row_number() over (partition by id order by rank, c_custkey) as rn from u) t where rn = 1"""


@plan
def stage_histogram(d):
    return f"select {STAGE} as stage, count(*) as n, count(distinct user_id) as users from events group by {STAGE}"


@plan
def corpus_summary(d):
    return "select (select count(*) from documents) as n_documents, (select count(distinct source) from documents) as n_sources, (select count(*) from pages) as n_pages, (select count(*) from conversations) as n_turns, (select coalesce(max(n_chars), 0) from documents) as longest"


# ------------------------------------------------------------------ graph and locators (2.9)
PATHS = "select c_custkey, concat('r', {r}, '.n', {n}, '.c', {c}) as locator from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


@plan
def locator_containment(d):
    """How each path meets a target: exact, inside it, around it; the dot keeps r1.n1 from meeting r1.n10."""
    paths = PATHS.format(r=d.text("r_regionkey"), n=d.text("n_nationkey"), c=d.text("c_custkey"))
    return f"""with p as ({paths}), t as (select distinct concat('r', {d.text('n_regionkey')}, '.n', {d.text('n_nationkey')}) as target from nation)
    select t.target, case when p.locator = t.target then 'exact' when p.locator like concat(t.target, '.%') then 'inside' else 'around' end as grade, count(*) as n
    from p join t on split_part(p.locator, '.', 1) = split_part(t.target, '.', 1) and (p.locator = t.target or p.locator like concat(t.target, '.%') or t.target like concat(p.locator, '.%')) group by 1, 2"""


@plan
def who_cites(d):
    return "select l_partkey as target, o_custkey as citing, min(cast(o_orderdate as date)) as since, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by l_partkey, o_custkey"


@plan
def citation_counts(d):
    return f"select l_partkey, count(distinct o_custkey) as citing, count(distinct case when l_returnflag = 'R' then o_custkey end) as amending from lineitem join orders on l_orderkey = o_orderkey group by l_partkey"


@plan
def neighbours_first_edge(d):
    return """select node, neighbour, kind, day from (select *, row_number() over (partition by node, neighbour order by day, kind) as rn, dense_rank() over (partition by node order by neighbour) as k from (
    select l_suppkey as node, l_partkey as neighbour, 'out' as kind, cast(l_shipdate as date) as day from lineitem) e) t where rn = 1 and k <= 10"""


@plan
def amendment_timeline(d):
    return "select l_orderkey, l_linenumber, cast(l_shipdate as date) as day from lineitem order by coalesce(cast(l_shipdate as date), date '9999-12-31'), l_orderkey, l_linenumber"


@plan
def blast_radius(d):
    return f"""with s as (select l_suppkey, count(distinct l_orderkey) as citations, {d.count_if("l_returnflag = 'R'")} as repeals, {d.count_if("l_returnflag = 'A'")} as duties from lineitem group by l_suppkey)
    select l_suppkey, citations + 5 * repeals + 5 * duties as reach, case when citations + 5 * repeals + 5 * duties >= 200 then 'wide' when citations + 5 * repeals + 5 * duties >= 40 then 'some' else 'narrow' end as level from s"""


@plan
def selected_subgraph(d):
    return "select distinct l_orderkey, l_partkey from lineitem where l_partkey in (select p_partkey from part where p_size = 1) union select distinct l_orderkey, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority like '1%' and o_totalprice > 400000)"


# ------------------------------------------------------------------ absence reports (2.10)
@plan
def unmet_obligations(d):
    """Orders with nothing shipped from the order date on within 90 days; near candidates are counted, overdue days given."""
    return f"""with due as (select o_orderkey, cast(o_orderdate as date) as host, {d.plus_days('o_orderdate', 90)} as due from orders)
    select due.o_orderkey, {d.days('due.due', "date '2000-01-01'")} as overdue, coalesce(c.n, 0) as candidates, case when {d.days('due.due', "date '2000-01-01'")} > 365 then 'blocking' when {d.days('due.due', "date '2000-01-01'")} > 0 then 'material' else 'note' end as severity
    from due left join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) c on c.l_orderkey = due.o_orderkey
    where not exists (select 1 from lineitem l where l.l_orderkey = due.o_orderkey and cast(l.l_shipdate as date) >= due.host and cast(l.l_shipdate as date) <= due.due)"""


@plan
def unrepaired_strikes(d):
    return "select event_id, user_id from events e where event_type = 'error' and not exists (select 1 from events p where p.user_id = e.user_id and p.event_type = 'purchase' and p.ts > e.ts)"


@plan
def strike_summary(d):
    return f"select user_id, count(*) as n, min(cast(ts as date)) as earliest, max({d.days('ts', "date '2024-03-01'")}) as longest from events where event_type = 'error' group by user_id"


@plan
def authority_comparison(d):
    """Agreement of two lists of keys: both, only theirs, only ours."""
    return """with ours as (select distinct user_id as k from events where event_type = 'error'), theirs as (select distinct user_id as k from events where event_type = 'purchase')
    select coalesce(o.k, t.k) as k, case when o.k is null then 'only_theirs' when t.k is null then 'only_ours' else 'both' end as side from ours o full join theirs t on o.k = t.k"""


@plan
def missing_evidence(d):
    return f"select user_id, concat(case when {d.count_if("event_type = 'view'")} = 0 then 'view;' else '' end, case when {d.count_if("event_type = 'purchase'")} = 0 then 'purchase;' else '' end, case when {d.count_if("event_type = 'signup'")} = 0 then 'signup;' else '' end) as missing from events group by user_id"


# ------------------------------------------------------------------ time and versions (2.11)
@plan
def as_of_version(d):
    """Greatest version not after the date, else the first one."""
    return """with v as (select o_custkey, o_orderkey, cast(o_orderdate as date) as day from orders),
    b as (select *, row_number() over (partition by o_custkey order by case when day <= date '1995-06-17' then 0 else 1 end, case when day <= date '1995-06-17' then day end desc, day, case when day <= date '1995-06-17' then -o_orderkey else o_orderkey end) as rn from v)
    select o_custkey, o_orderkey, day, day <= date '1995-06-17' as in_force from b where rn = 1"""


@plan
def consolidation_replay(d):
    """Dated operations in order, up to a date: the last one that writes wins, a void one voids its entity."""
    return """select user_id, max(case when rn = 1 then event_type end) as state, count(*) as ops, max(case when event_type = 'error' then 1 else 0 end) as blocked from (
    select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where cast(ts as date) <= date '2024-01-20') t group by user_id"""


@plan
def deadline_attention(d):
    left = d.days("date '1998-01-01'", d.plus_days("o_orderdate", 45))
    return f"select o_orderkey, case when o_orderdate is null then 'unknown' when {left} < 0 then 'overdue' when {left} <= 14 then 'soon' else 'future' end as attention from orders"


@plan
def staleness(d):
    return f"select c_custkey, case when max(o_orderdate) is null then 'missing' when {d.days('max(o_orderdate)', "date '1998-08-01'")} > 365 then 'stale' else 'current' end as freshness from customer left join orders on c_custkey = o_custkey group by c_custkey"


@plan
def version_index(d):
    return "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version, coalesce(lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey), -1) as next_key from orders"


@plan
def unique_identity(d):
    """A free bare key for the first of its namesakes, the others qualified by their id; the order of rows plays no part."""
    return f"select event_id, case when row_number() over (partition by user_id, event_type order by ts, event_id) = 1 then concat({d.text('user_id')}, '-', event_type) else concat({d.text('user_id')}, '-', event_type, '-', {d.text('event_id')}) end as key from events"


@plan
def text_loss(d):
    return "select * from (select d.doc_id, d.n_chars, length(case when d.doc_id % 3 = 0 then substr(d.text, 1, cast(d.n_chars - d.doc_id % 40 as int)) else d.text end) as kept from documents d) x where kept < 0.98 * n_chars"


# ------------------------------------------------------------------ incremental state (2.13)
@plan
def upsert_latest(d):
    return "select user_id, event_type, day, event_id, value from (select *, cast(ts as date) as day, row_number() over (partition by user_id, event_type, cast(ts as date) order by ts desc, event_id desc) as rn from events) t where rn = 1"


@plan
def change_detection(d):
    return "select user_id, day, n, n - coalesce(lag(n) over (partition by user_id order by day), 0) as change, case when lag(h) over (partition by user_id order by day) is null then 'first' when lag(h) over (partition by user_id order by day) = h then 'unchanged' else 'changed' end as sync from (select user_id, cast(ts as date) as day, count(*) as n, max(event_type) as h from events group by user_id, cast(ts as date)) t"


@plan
def illegal_transitions(d):
    return """select prev, event_type, count(*) as n from (select event_type, lag(event_type) over (partition by user_id order by ts, event_id) as prev from events) t
    where prev is not null and not exists (select 1 from (select 'signup' as a, 'view' as b union all select 'view', 'click' union all select 'click', 'purchase' union all select 'view', 'view' union all select 'click', 'view') ok where ok.a = t.prev and ok.b = t.event_type) group by prev, event_type"""


@plan
def timeline_coverage(d):
    return f"select user_id, count(distinct event_type) as covered, max({STAGE}) as most_advanced, max(ts) as latest from events group by user_id"


@plan
def delta_pack(d):
    return "select o.o_orderkey, count(l.l_linenumber) as n_children from orders o left join lineitem l on o.o_orderkey = l.l_orderkey where cast(o.o_orderdate as date) > date '1998-06-01' group by o.o_orderkey"


@plan
def first_of_key(d):
    return "select user_id, event_type, min(event_id) as event_id from events group by user_id, event_type"


# ------------------------------------------------------------------ evaluation (2.14)
@plan
def precision_recall(d):
    """A rule against labels; empty denominators count as 1."""
    return f"""with j as (select l.quality = 1 as truth, d.n_chars > 1500 as said from labels l join documents d on l.doc_id = d.doc_id),
    c as (select {d.count_if('truth and said')} as tp, {d.count_if('said and not truth')} as fp, {d.count_if('truth and not said')} as fn from j)
    select tp, fp, fn, case when tp + fp = 0 then 1.0 else round(tp / cast(tp + fp as double), 6) end as prec, case when tp + fn = 0 then 1.0 else round(tp / cast(tp + fn as double), 6) end as recall from c"""


@plan
def hash_sample(d):
    return f"select doc_id from documents order by {d.sha(d.text('doc_id'))} limit 120"


@plan
def judged_precision(d):
    return f"select lang, round({d.count_if('quality = 1')} / cast(nullif(count(quality), 0) as double), 6) as prec from documents d left join labels l on d.doc_id = l.doc_id group by lang"


@plan
def storage_estimate(d):
    return "select source, cast(sum(cast(n_chars as decimal(18, 2)) / 1024) as decimal(18, 2)) as kb from documents group by source"


@plan
def quote_gate(d):
    """Whether an item is quoted in a document, with the first failing reason."""
    return """select item_id, case when length(text) = 0 then 'empty' when length(text) < 60 then 'short' when n = 0 then 'absent' when n > 1 then 'repeated' else 'ok' end as verdict from (
    select b.item_id, b.text, count(d.doc_id) as n from benchmark b left join documents d on contains(d.text, b.text) group by b.item_id, b.text) t"""


@plan
def speaker_carry_forward(d):
    return "select conv_id, turn, coalesce(case when role <> 'system' then role end, lag(role) over (partition by conv_id order by turn)) as speaker from conversations"


# ------------------------------------------------------------------ near-copy reports on keys (2.8)
@plan
def draft_conflicts(d):
    return "select l_orderkey, l_partkey, count(*) as n, case when max(case when l_returnflag = 'R' then 1 else 0 end) = 1 and max(case when l_returnflag <> 'R' then 1 else 0 end) = 1 then 'repeal_and_change' when max(l_returnflag) = 'R' then 'double_repeal' else 'double_change' end as conflict from lineitem group by l_orderkey, l_partkey having count(*) > 1"


@plan
def exact_duplicate_groups(d):
    return f"select {d.sha('text')} as text_sha, count(*) as n, min(doc_id) as first_id from documents group by {d.sha('text')} having count(*) > 1"


@plan
def version_comparison(d):
    """Articles of two versions by locator: added, removed, changed, same; white space doesn't count."""
    body = d.replace_all("text", " +", " ")
    return f"""with a as (select conv_id, {body} as t from conversations where turn = 1), b as (select conv_id, {body} as t from conversations where turn = 3)
    select coalesce(a.conv_id, b.conv_id) as conv_id, case when a.t is null then 'added' when b.t is null then 'removed' when a.t = b.t then 'same' else 'changed' end as change from a full join b on a.conv_id = b.conv_id"""
