"""Queries that apply the report, graph, status, state and evaluation operators to the driver's tables, with their SQL.

The SQL is written from what each query means, not from the operator's plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, graph, reports, state, status

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (lambda spark, sf_dir: days_as_text(f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))), sql)
        return f

    return add


def days_as_text(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in df.dtypes))


# ------------------------------------------------------------------ the tables as acts, edges, events
def edges(t) -> DataFrame:
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.col("l_linenumber")
    loc = F.when(n == 1, "").when(n > 4, F.concat(F.lit("art"), n.cast("string"), F.lit(".alin"), (F.col("l_quantity").cast("int") % 3).cast("string"))).otherwise(F.concat(F.lit("art"), n.cast("string")))
    kind = F.when(F.col("l_returnflag") == "R", "abroga").when(F.col("l_returnflag") == "A", "modifica").otherwise("refera")
    return x.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), loc.alias("locator"), kind.alias("kind"), F.col("l_shipdate").cast("date").alias("since"))


EDGES = """edges as (select 'c' || o_custkey as source, 'p' || l_partkey as target, case when l_linenumber = 1 then '' when l_linenumber > 4 then 'art' || l_linenumber || '.alin' || (cast(l_quantity as int) % 3) else 'art' || l_linenumber end as locator,
 case l_returnflag when 'R' then 'abroga' when 'A' then 'modifica' else 'refera' end as kind, cast(l_shipdate as date) as since from lineitem join orders on l_orderkey = o_orderkey)"""
CHANGE = "kind in ('modifica', 'abroga')"


def refs(t) -> DataFrame:
    return t("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("ref"), F.concat(F.lit("p"), F.col("o_orderkey") % 500 + 1).alias("act"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("art"), (F.col("o_orderkey") % 7).cast("string"))).alias("locator"))


REFS = "refs as (select 'o' || o_orderkey as ref, 'p' || (o_orderkey % 500 + 1) as act, case when o_orderkey % 4 = 0 then '' else 'art' || (o_orderkey % 7) end as locator from orders)"
COVERS = "({o} = '' or {o} = {i} or starts_with({i}, {o} || '.'))"


def kinds(t) -> DataFrame:
    k = lambda c: F.element_at(F.array(*map(F.lit, ("lege", "hg", "ordin"))), (c % 3 + 1).cast("int"))
    return t("part").select(F.concat(F.lit("p"), "p_partkey").alias("act"), k(F.col("p_size")).alias("kind")).unionAll(t("customer").select(F.concat(F.lit("c"), "c_custkey"), k(F.col("c_nationkey"))))


KINDS = "kinds as (select 'p' || p_partkey as act, ['lege', 'hg', 'ordin'][p_size % 3 + 1] as kind from part union all select 'c' || c_custkey, ['lege', 'hg', 'ordin'][c_nationkey % 3 + 1] from customer)"


def events(t) -> DataFrame:
    return t("events").select((F.col("user_id") % 300).alias("project"), F.col("event_id").alias("event"), F.col("ts").alias("at"), F.col("event_type").alias("stage"), F.concat(F.lit("f"), (F.col("event_id") % 4).cast("string")).alias("family"))


EVENTS = "ev as (select user_id % 300 as project, event_id as event, ts as at, event_type as stage, 'f' || (event_id % 4) as family from events)"


def signatures(t) -> DataFrame:
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select((F.col("o_custkey") % 200).alias("idm"), F.year("o_orderdate").alias("leg"), (F.col("c_nationkey") % 2).alias("camera"), F.concat(F.lit("Nume É"), (F.col("o_custkey") % 90).cast("string")).alias("name"), F.col("o_orderkey").alias("bill"))


SIGNATURES = "sig as (select o_custkey % 200 as idm, year(o_orderdate) as leg, c_nationkey % 2 as camera, 'Nume É' || (o_custkey % 90) as name, o_orderkey as bill from orders join customer on o_custkey = c_custkey)"


# ------------------------------------------------------------------ graph
@query(f"with {EDGES} select count(*) as edges, count(*) filter ({CHANGE}) as changes, count(distinct source) filter ({CHANGE}) as changing, count(distinct target) filter ({CHANGE}) as changed from edges")
def graph_edge_summary(t):
    return graph.graph_summary(edges(t))


@query(f"with {EDGES} select *  replace (cast(since as varchar) as since) from edges where target = 'p7' and {CHANGE}")
def graph_inbound_changes(t):
    return graph.inbound(edges(t), "p7", changes_only=True)


@query(f"with {EDGES} select * replace (cast(since as varchar) as since) from edges where source = 'c7'")
def graph_outbound(t):
    return graph.outbound(edges(t), "c7")


@query(f"""with {EDGES}, tg as (select 'p' || p_partkey as target, 'art' || (p_size % 7) as path from part),
 m as (select e.target, path, case when locator = path then 'exact' when starts_with(locator, path || '.') then 'inside' when locator = '' or starts_with(path, locator || '.') then 'around' end as grade from edges e join tg on e.target = tg.target)
 select target, path, grade, count(*) as n from m where grade is not null group by all""")
def graph_provision_citers(t):
    tg = t("part").select(F.concat(F.lit("p"), "p_partkey").alias("target"), F.concat(F.lit("art"), (F.col("p_size") % 7).cast("string")).alias("path"))
    return graph.who_cites(edges(t), tg, state.tasks_of(t("lineitem"))).groupBy("target", "path", "grade").agg(F.count("*").alias("n"))


@query(f"""with {EDGES}, b as (select source as node, target as neighbour, kind, since, 'out' as direction from edges union all select target, source, kind, since, 'in' from edges),
 f as (select *, row_number() over (partition by node, neighbour order by since, direction, kind) as r from b), g as (select *, row_number() over (partition by node order by neighbour) as k from f where r = 1)
 select node, neighbour, kind, cast(since as varchar) as since, direction from g where k <= 10""")
def graph_neighbours_both_ways(t):
    return graph.neighbours(edges(t))


@query(f"""with {EDGES}, p as (select 'p' || (o_orderkey % 500 + 1) as target, count(*) as pending from orders where o_orderstatus = 'P' group by 1),
 e as (select target, count(distinct source) as citing, count(distinct source) filter ({CHANGE}) as changing, max(since) filter ({CHANGE}) as last_change from edges group by target)
 select coalesce(e.target, p.target) as target, coalesce(citing, 0) as citing, coalesce(changing, 0) as changing, cast(last_change as varchar) as last_change, coalesce(pending, 0) as pending from e full join p on e.target = p.target""")
def graph_watch_state(t):
    return graph.watch_state(edges(t), t("orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("p"), F.col("o_orderkey") % 500 + 1).alias("target")))


@query(f"""with {EDGES}, {REFS}, p as (select 'p' || (o_orderkey % 500 + 1) as target, count(*) as pending from orders where o_orderstatus = 'P' group by 1),
 e as (select target, count(distinct source) as citing, count(distinct source) filter ({CHANGE}) as changing, max(since) filter ({CHANGE}) as last_change from edges group by target)
 select d.draft, d.target, coalesce(citing, 0) as citing, coalesce(changing, 0) as changing, cast(last_change as varchar) as last_change, coalesce(pending, 0) as pending from (select distinct ref as draft, act as target from refs) d left join e on d.target = e.target left join p on d.target = p.target""")
def graph_draft_target_facts(t):
    return graph.target_facts(refs(t).select(F.col("ref").alias("draft"), F.col("act").alias("target")), edges(t), t("orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("p"), F.col("o_orderkey") % 500 + 1).alias("target")))


@query(f"""with {EDGES}, u as (select 'p' || p_partkey as target, p_size % 5 as terms, p_size as term_uses, p_size * 20 as n_chars from part where p_size > 10),
 e as (select target, count(distinct source) as citing, count(*) filter (kind = 'abroga') as repeals from edges group by target),
 r as (select e.target, citing + coalesce(term_uses, 0) + 10 * coalesce(terms, 0) + 5 * repeals as reach, n_chars from e left join u on e.target = u.target)
 select target, reach, case when reach >= 200 then 'wide' when reach >= 40 then 'some' else 'narrow' end as level, coalesce(n_chars <= 400 and reach >= 40, false) as hidden from r""")
def graph_impact(t):
    u = t("part").where("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("target"), (F.col("p_size") % 5).alias("terms"), F.col("p_size").alias("term_uses"), (F.col("p_size") * 20).alias("n_chars"))
    return graph.impact(edges(t), u.select("target", "terms", "term_uses"), u.select("target", "n_chars"))


@query("""with s as (select conv_id as act, turn as ord, 'art' || turn as locator, coalesce(sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as start, length(text) as n from conversations)
 select act, ord, locator, start, (start + n)::bigint as "end" from s""")
def graph_spanned_text(t):
    return graph.spanned_text(t("conversations").select(F.col("conv_id").alias("act"), F.col("turn").alias("ord"), F.concat(F.lit("art"), "turn").alias("locator"), "text"))


@query("""with s as (select conv_id as act, 'art' || turn as locator, coalesce(sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as a, length(text) as n from conversations),
 p as (select distinct conv_id as act, 25 * k as "offset" from conversations, (values (0), (1), (2), (8)) v(k))
 select p.act, p."offset"::bigint as "offset", s.locator from p left join s on p.act = s.act and s.a <= p."offset" and p."offset" < s.a + s.n""")
def graph_offset_to_provision(t):
    c = t("conversations").select(F.col("conv_id").alias("act"), F.col("turn").alias("ord"), F.concat(F.lit("art"), "turn").alias("locator"), "text")
    points = c.select("act").distinct().select("act", F.explode(F.array(*(F.lit(25 * k).cast("long") for k in (0, 1, 2, 8)))).alias("offset"))
    return graph.at_offset(points, graph.spanned_text(c))


@query("""with h as (select case when l_linenumber > 3 then 'art1.alin' || l_linenumber else 'art' || l_linenumber end as unit, l_partkey as norm, count(*) as n from lineitem group by all)
 select unit, norm, n from h where not exists (select 1 from h d where d.norm = h.norm and starts_with(d.unit, h.unit || '.'))""")
def sim_tightest_unit(t):
    n = F.col("l_linenumber")
    h = t("lineitem").groupBy(F.when(n > 3, F.concat(F.lit("art1.alin"), n.cast("string"))).otherwise(F.concat(F.lit("art"), n.cast("string"))).alias("unit"), F.col("l_partkey").alias("norm")).agg(F.count("*").alias("n"))
    return graph.tightest(h)


# ------------------------------------------------------------------ what is in force
_DEAD = f"""dead as (select r.ref, r.act, r.locator, e.locator as gone, e.since, e.source as "by" from (select distinct * from refs) r join edges e on e.kind = 'abroga' and e.target = r.act and {COVERS.format(o="e.locator", i="r.locator")}),
 d1 as (select *, row_number() over (partition by ref, act, locator order by gone <> '', since, gone, "by") as k from dead)"""
_REPUBLISHED = "rep as (select 'p' || p_partkey as act, make_date(1995, 1, 1) + p_size * 10 as republished from part where p_size < 25)"


def republished(t) -> DataFrame:
    return t("part").where("p_size < 25").select(F.concat(F.lit("p"), "p_partkey").alias("act"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size") * 10).alias("republished"))


@query(f"""with {EDGES}, {REFS}, {_REPUBLISHED}, {_DEAD} select ref, d1.act, locator, "by", cast(since as varchar) as since, gone = '' as whole, case when gone <> '' and republished is not null and since < republished then 'material' else 'blocking' end as severity from d1 left join rep on d1.act = rep.act where k = 1""")
def status_dead_citations(t):
    return status.dead_citations(refs(t), edges(t), republished(t))


_QUALIFIED = "qedges as (select source, target, locator, since, case when kind = 'abroga' and source < 'c5' then 'abroga' when kind = 'abroga' then 'suspenda' when kind = 'modifica' then 'deroga' else kind end as kind from edges)"


@query(f"""with {EDGES}, {REFS}, {_QUALIFIED}, r as (select distinct * from refs), alive as (select * from r where not exists (select 1 from qedges e where e.kind = 'abroga' and e.target = r.act and {COVERS.format(o="e.locator", i="r.locator")}))
 select distinct ref, act, alive.locator, case kind when 'suspenda' then 'suspendat' else 'derogare' end as status, source as by, cast(since as varchar) as since from alive join qedges e on e.target = act and kind in ('suspenda', 'deroga') and {COVERS.format(o="e.locator", i="alive.locator")}""")
def status_qualified_citations(t):
    e = edges(t)
    kind = F.when((F.col("kind") == "abroga") & (F.col("source") < "c5"), "abroga").when(F.col("kind") == "abroga", "suspenda").when(F.col("kind") == "modifica", "deroga").otherwise(F.col("kind"))
    return status.qualified_citations(refs(t), e.withColumn("kind", kind))


_RANK = "case {c} when 'lege' then 1 when 'hg' then 3 when 'ordin' then 4 else 9 end"
_STRIKES = "strikes as (select event_id as strike, 'p' || (event_id % 2000 + 1) as act, case when event_id % 3 = 0 then '' else 'art' || (event_id % 5 + 1) end as locator, make_date(1994, 1, 1) + cast(event_id % 900 as int) as published, event_id % 2 = 0 as suspends from events where event_type = 'error')"
_REGISTER = f"""reg as (select strike, s.act, s.locator, published, case when suspends then published + 45 end as due, greatest(coalesce(date_diff('day', case when suspends then published + 45 end, date '1998-01-01'), 0), 0) as overdue from strikes s left join kinds k on k.act = s.act
 where not exists (select 1 from edges e left join kinds b on b.act = e.source where e.target = s.act and e.since > s.published and ({COVERS.format(o="e.locator", i="s.locator")} or {COVERS.format(o="s.locator", i="e.locator")})
 and (b.kind is null or k.kind is null or {_RANK.format(c="b.kind")} <= {_RANK.format(c="k.kind")})))"""


def register(t) -> DataFrame:
    i = F.col("event_id")
    s = t("events").where("event_type = 'error'").select(i.alias("strike"), F.concat(F.lit("p"), i % 2000 + 1).alias("act"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("art"), (i % 5 + 1).cast("string"))).alias("locator"), F.date_add(F.lit("1994-01-01").cast("date"), (i % 900).cast("int")).alias("published"), (i % 2 == 0).alias("suspends"))
    return status.struck_register(s, edges(t), kinds(t), F.lit("1998-01-01").cast("date"))


@query(f"with {EDGES}, {KINDS}, {_STRIKES}, {_REGISTER} select strike, act, locator, cast(published as varchar) as published, cast(due as varchar) as due, overdue::int as overdue from reg")
def status_struck_register(t):
    return register(t).withColumn("overdue", F.coalesce("overdue", F.lit(0)))


@query(f"with {EDGES}, {KINDS}, {_STRIKES}, {_REGISTER} select act, locator, count(*) as strikes, arg_min(strike, struct_pack(p := published, s := strike)) as first_strike, cast(min(published) as varchar) as first_published, max(overdue)::int as longest from reg group by act, locator")
def status_strike_summary(t):
    return status.strike_summary(register(t).withColumn("overdue", F.coalesce("overdue", F.lit(0))))


@query(f"""with {EDGES}, {KINDS}, {_STRIKES}, {_REGISTER}, {REFS}, s as (select act, locator as struck, arg_min(strike, struct_pack(p := published, s := strike)) as first_strike from reg group by all),
 h as (select distinct ref, r.act, r.locator, struck, first_strike, case when r.locator = struck then 1 when struck = '' then 4 when r.locator = '' then 5 when starts_with(r.locator, struck || '.') then 2 when starts_with(struck, r.locator || '.') then 3 end as g from refs r join s on r.act = s.act),
 k as (select *, row_number() over (partition by ref, act, locator order by g, first_strike, struck) as n from h where g is not null)
 select ref, act, locator, struck, first_strike, ['exact', 'sub', 'over', 'whole', 'act'][g] as grade from k where n = 1""")
def status_draft_collisions(t):
    return status.collisions(refs(t), register(t))


_DUTIES = "duties as (select o_orderkey as duty, 'p' || (o_orderkey % 1500 + 1) as host, ['hg', 'ordin', null][o_orderkey % 3 + 1] as expected, cast(o_orderdate as date) as published, case when o_orderkey % 5 > 0 then cast(o_orderdate as date) + 90 end as due from orders where o_orderstatus = 'F')"
_IMPL = "select distinct duty, source as by from duties d join edges e on e.target = d.host join acts a on a.act = e.source where ({x} or a.kind = d.expected) and (a.published is null or a.published >= d.published)"
_ACTS = "acts as (select 'c' || c_custkey as act, ['lege', 'hg', 'ordin'][c_nationkey % 3 + 1] as kind, case when c_custkey % 4 > 0 then make_date(1992 + cast(c_custkey % 6 as int), 1, 1) end as published from customer)"


def duties(t) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return t("orders").where("o_orderstatus = 'F'").select(k.alias("duty"), F.concat(F.lit("p"), k % 1500 + 1).alias("host"), F.when(k % 3 == 0, "hg").when(k % 3 == 1, "ordin").alias("expected"), day.alias("published"), F.when(k % 5 > 0, F.date_add(day, 90)).alias("due"))


def acts(t) -> DataFrame:
    return t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("act"), F.element_at(F.array(*map(F.lit, ("lege", "hg", "ordin"))), F.col("c_nationkey") % 3 + 1).alias("kind"), F.when(F.col("c_custkey") % 4 > 0, F.make_date((F.col("c_custkey") % 6 + 1992).cast("int"), F.lit(1), F.lit(1))).alias("published"))


@query(f"with {EDGES}, {_DUTIES}, {_ACTS}, i as ({_IMPL.format(x='d.expected is null')}) select duty, count(*) as n from i group by duty")
def status_implementations(t):
    return status.implementations(duties(t), edges(t), acts(t)).groupBy("duty").agg(F.count("*").alias("n"))


@query(f"""with {EDGES}, {_DUTIES}, {_ACTS}, i as ({_IMPL.format(x='d.expected is null')}), near as (select duty, count(*) as near from ({_IMPL.format(x='true')}) group by duty),
 o as (select d.*, coalesce(near, 0) as near, greatest(date_diff('day', due, date '1996-01-01'), 0) as overdue, coalesce(expected = 'hg', false) as complete from duties d left join near on near.duty = d.duty where d.duty not in (select duty from i))
 select duty, host, expected, overdue::int as overdue, near, case when not complete or due is null then 'note' when overdue > 365 then 'blocking' when overdue > 0 then 'material' else 'note' end as severity,
 concat_ws(',', case when not complete then 'type_incomplete' end, case when due is null then 'no_due_date' end, case when near > 0 then 'near_candidates' end) as limits from o""")
def status_gap_report(t):
    return status.gap_report(duties(t), edges(t), acts(t), F.lit("1996-01-01").cast("date"), ["hg"])


_VERSIONS = "v as (select o_custkey as name, o_orderkey as version, cast(o_orderdate as date) as since from orders), asked as (select c_custkey as name, case when c_custkey % 5 > 0 then date '1995-06-17' end as day from customer)"


def versions(t) -> tuple[DataFrame, DataFrame]:
    v = t("orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").cast("date").alias("since"))
    return v, t("customer").select(F.col("c_custkey").alias("name"), F.when(F.col("c_custkey") % 5 > 0, F.lit("1995-06-17").cast("date")).alias("day"))


@query(f"""with {_VERSIONS}, x as (select asked.name, day, arg_max(version, struct_pack(s := since, v := version)) filter (day is null or since <= day) as best, arg_min(version, struct_pack(s := since, v := version)) as first from asked left join v on v.name = asked.name group by asked.name, day)
 select name, cast(day as varchar) as day, coalesce(best, first) as version, best is not null as in_force from x""")
def status_as_of_or_first(t):
    return status.as_of(*versions(t))


@query(f"with {_VERSIONS}, x as (select asked.name, day, arg_max(version, struct_pack(s := since, v := version)) filter (day is null or since <= day) as best from asked left join v on v.name = asked.name group by asked.name, day) select name, cast(day as varchar) as day, best as version, best is not null as in_force from x")
def status_as_of(t):
    return status.as_of(*versions(t), fallback=False)


@query("""with a as (select o_orderkey as act, o_custkey % 700 as cite_key, o_orderpriority as issuer, case when o_orderkey % 6 > 0 then cast(o_orderdate as date) end as published from orders),
 k as (select *, row_number() over (partition by cite_key order by issuer <> '1-URGENT', coalesce(cast(published as varchar), '9999'), act) as n, count(*) over (partition by cite_key) as c from a), w as (select distinct c_custkey % 900 as cite_key from customer)
 select w.cite_key, k.act, coalesce(k.c, 0) as candidates from w left join k on k.cite_key = w.cite_key and n = 1""")
def status_citation_resolution(t):
    a = t("orders").select(F.col("o_orderkey").alias("act"), (F.col("o_custkey") % 700).alias("cite_key"), F.col("o_orderpriority").alias("issuer"), F.when(F.col("o_orderkey") % 6 > 0, F.col("o_orderdate").cast("date")).alias("published"))
    return status.resolve_citation(t("customer").select((F.col("c_custkey") % 900).alias("cite_key")), a, "1-URGENT")


@query("""with a as (select p_partkey as act, p_type as kind, p_size as number, 1990 + p_partkey % 7 as year, p_brand as title from part), c as (select distinct p_type as kind, p_size as number, 1991 + p_partkey % 7 as year, p_brand as title from part),
 m as (select * from c where not exists (select 1 from a where a.kind = c.kind and a.number = c.number and a.year = c.year))
 select m.kind, m.number, m.year, min(a.act) as act from m join a on a.kind = m.kind and a.number = m.number and abs(a.year - m.year) = 1 and a.title = m.title group by m.kind, m.number, m.year having count(*) = 1""")
def status_year_alias(t):
    p = t("part")
    a = p.select(F.col("p_partkey").alias("act"), F.col("p_type").alias("kind"), F.col("p_size").alias("number"), (F.col("p_partkey") % 7 + 1990).alias("year"), F.col("p_brand").alias("title"))
    c = p.select(F.col("p_type").alias("kind"), F.col("p_size").alias("number"), (F.col("p_partkey") % 7 + 1991).alias("year"), F.col("p_brand").alias("title")).distinct()
    return status.year_alias(c, a)


_OPS = "ops as (select 'l' || (user_id % 80) as locator, case when event_id % 97 > 0 then cast(ts as date) end as since, event_id as ord, case event_type when 'error' then 'abroga' when 'signup' then 'introduce' else 'modifica' end as kind, case when event_id % 89 > 0 and event_type <> 'error' then event_type end as new_text from events), base as (select 'l' || n_nationkey as locator, n_name as text from nation)"


@query(f"""with {_OPS}, o as (select locator, arg_max(case when kind = 'abroga' then '' else coalesce(new_text, '') end, struct_pack(s := since, o := ord)) filter (since is not null) as now, arg_max(kind, struct_pack(s := since, o := ord)) filter (since is not null) as last, count(*) as n, bool_or(since is null or (new_text is null and kind <> 'abroga')) as bad, bool_or(kind = 'introduce') as ins from ops where since is null or since <= date '2024-01-20' group by locator)
 select coalesce(b.locator, o.locator) as locator, case when coalesce(bad, false) or n is null then b.text when last = 'abroga' then null else now end as text, coalesce(n, 0) as ops, coalesce(bad, false) as blocked from base b full join o on o.locator = b.locator where b.text is not null or ins""")
def status_consolidated(t):
    e = t("events")
    ops = e.select(F.concat(F.lit("l"), (F.col("user_id") % 80).cast("string")).alias("locator"), F.when(F.col("event_id") % 97 > 0, F.col("ts").cast("date")).alias("since"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "error", "abroga").when(F.col("event_type") == "signup", "introduce").otherwise("modifica").alias("kind"), F.when((F.col("event_id") % 89 > 0) & (F.col("event_type") != "error"), F.col("event_type")).alias("new_text"))
    return status.consolidated(t("nation").select(F.concat(F.lit("l"), "n_nationkey").alias("locator"), F.col("n_name").alias("text")), ops, F.lit("2024-01-20").cast("date"))


@query("""with p as (select l_orderkey as act, l_linenumber as point, row_number() over (partition by l_orderkey order by l_linenumber) as n, count(*) over (partition by l_orderkey) as np from lineitem),
 b as (select l_orderkey as act, l_partkey as block, row_number() over (partition by l_orderkey order by l_partkey, l_linenumber) as n, count(*) over (partition by l_orderkey) as nb from lineitem where l_returnflag <> 'R'), tb as (select act, max(nb) as total from b group by act)
 select p.act, p.n::int as n, p.point, case when coalesce(total, 0) = np then b.block end as block, coalesce(total, 0) <> np as mismatch from p left join b on b.act = p.act and b.n = p.n left join tb on tb.act = p.act""")
def status_paired_operations(t):
    li = t("lineitem")
    b = li.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("act"), F.struct("l_partkey", "l_linenumber").alias("ord"), F.col("l_partkey").alias("block"))
    return status.paired_operations(li.select(F.col("l_orderkey").alias("act"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").alias("point")), b)


_PROV = "prov as (select 'p' || conv_id as act, 'art' || turn as locator, text from conversations), st as (select event_id as strike, 'p' || (event_id % 200) as act, case event_id % 4 when 0 then '' when 1 then 'art1' when 2 then 'art2.alin1' else 'art9' end as locator from events where event_type = 'error')"


@query(f"""with {_PROV} select strike, st.act, st.locator, coalesce(a.text, b.text) as text, case when a.text is not null then 'exact' when b.text is not null then 'article' when st.locator = '' then 'whole_act' when st.act not in (select act from prov) then 'act_missing' else 'locator_missing' end as found
 from st left join prov a on a.act = st.act and a.locator = st.locator left join prov b on b.act = st.act and b.locator = split_part(st.locator, '.', 1)""")
def status_struck_text(t):
    return status.struck_text(*_struck(t))


@query(f"""with {_PROV}, f as (select case when a.text is not null then 'exact' when b.text is not null then 'article' when st.locator = '' then 'whole_act' when st.act not in (select act from prov) then 'act_missing' else 'locator_missing' end as found
 from st left join prov a on a.act = st.act and a.locator = st.locator left join prov b on b.act = st.act and b.locator = split_part(st.locator, '.', 1)) select found, count(*) as n from f group by found""")
def status_struck_coverage(t):
    return status.struck_coverage(status.struck_text(*_struck(t)))


def _struck(t) -> tuple[DataFrame, DataFrame]:
    i = F.col("event_id")
    s = t("events").where("event_type = 'error'").select(i.alias("strike"), F.concat(F.lit("p"), (i % 200).cast("string")).alias("act"), F.when(i % 4 == 0, "").when(i % 4 == 1, "art1").when(i % 4 == 2, "art2.alin1").otherwise("art9").alias("locator"))
    return s, t("conversations").select(F.concat(F.lit("p"), "conv_id").alias("act"), F.concat(F.lit("art"), "turn").alias("locator"), "text")
