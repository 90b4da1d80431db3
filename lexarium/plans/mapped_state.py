"""Queries that apply the state, report and evaluation operators to the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, reports, state
from .mapped import EVENTS, SIGNATURES, days_as_text, events, signatures

QUERIES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = (lambda spark, sf_dir: days_as_text(f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))), sql)
        return f

    return add


def s(c) -> F.Column:
    return F.col(c).cast("string")


# ------------------------------------------------------------------ state
_KEYED = "old as (select o_orderkey as act, 'a' || l_linenumber as part, l_quantity as v from orders join lineitem on o_orderkey = l_orderkey where o_orderkey % 3 > 0), new as (select l_orderkey as act, 'b' || l_linenumber as part, l_tax as v from lineitem where l_orderkey % 5 = 0)"


def _keyed(t) -> tuple[DataFrame, DataFrame]:
    li = t("lineitem")
    old = li.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").where("l_orderkey % 3 > 0").select(F.col("l_orderkey").alias("act"), F.concat(F.lit("a"), "l_linenumber").alias("part"), F.col("l_quantity").alias("v"))
    return old, li.where("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("act"), F.concat(F.lit("b"), "l_linenumber").alias("part"), F.col("l_tax").alias("v"))


@query(f"with {_KEYED} select * from old where act not in (select act from new) union all select * from new")
def state_replaced_wholesale(t):
    return state.replaced(*_keyed(t), ["act"])


@query("""with o as (select n_nationkey as k, n_name as url, n_regionkey as v from nation where n_nationkey < 20), n as (select n_nationkey as k, case when n_nationkey % 2 = 0 then '' else 'new' end as url, 9 as v from nation where n_nationkey > 10)
 select coalesce(n.k, o.k) as k, case when n.k is null then o.url when n.url = '' then o.url else n.url end as url, coalesce(n.v, o.v) as v from o full join n on n.k = o.k""")
def state_registry_upsert(t):
    n, k = t("nation"), F.col("n_nationkey")
    old = n.where(k < 20).select(k.alias("k"), F.col("n_name").alias("url"), F.col("n_regionkey").alias("v"))
    new = n.where(k > 10).select(k.alias("k"), F.when(k % 2 == 0, "").otherwise("new").alias("url"), F.lit(9).alias("v"))
    return state.merged(old, new, ["k"], ["url"])


@query("select o_orderkey as act, o_custkey, case when o_orderkey % 7 = 0 then 0 else 1 end as first from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def state_work_list(t):
    o = t("orders").select(F.col("o_orderkey").alias("act"), "o_custkey")
    return state.not_asked(o, t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("act")), ["act"], o.where("act % 7 = 0"))


@query("select event_type as error, count(*) as n from events where event_type not in ('error', 'signup') group by event_type")
def state_retry_reset(t):
    return state.forget_failures(t("events").select(F.col("event_type").alias("error")), ["error", "signup"]).groupBy("error").agg(F.count("*").alias("n"))


_SNAPS = """sn as (select user_id as source, event_id as at, md5(cast(event_id % 50 as varchar)) as hash, event_type as stage, case when event_id % 3 = 0 then date '2024-05-01' end as deadline, [cast(event_id % 4 as varchar), cast(event_id % 7 as varchar)] as documents from events),
 r as (select *, row_number() over (partition by source order by "at" desc) as n from sn), p as (select a.source, a.hash as h1, b.hash as h2, a.stage as s1, b.stage as s2, a.deadline as d1, b.deadline as d2, a.documents as x1, coalesce(b.documents, []) as x2, b.source is null as one from r a left join r b on b.source = a.source and b.n = 2 where a.n = 1)"""


@query(f"""with {_SNAPS}, k as (select *, case when one then 'first' when d1 is distinct from d2 then 'deadline' when s1 is distinct from s2 then 'stage' when len(list_filter(list_distinct(x1), lambda x: not list_contains(x2, x))) > 0 then 'documents' when h1 <> h2 then 'content' else 'unchanged' end as kind from p)
 select source, kind, case when kind in ('deadline', 'stage') then 'high' when kind = 'documents' then 'medium' else 'low' end as severity, len(list_filter(list_distinct(x1), lambda x: not list_contains(x2, x)))::int as new_documents from k""")
def state_snapshot_changes(t):
    i = F.col("event_id")
    sn = t("events").select(F.col("user_id").alias("source"), i.alias("at"), F.md5((i % 50).cast("string").cast("binary")).alias("hash"), F.col("event_type").alias("stage"), F.when(i % 3 == 0, F.lit("2024-05-01").cast("date")).alias("deadline"), F.array((i % 4).cast("string"), (i % 7).cast("string")).alias("documents"))
    return state.changes(sn)


_ALLOWED = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view")]
_PREV = "m as (select event_id as id, event_type as state, case when event_id % 3 > 0 then ['view', 'click', 'purchase', 'error'][event_id % 4 + 1] end as next from events)"


@query(f"with {_PREV} select id, case when state || '>' || next in ({', '.join(f"'{a}>{b}'" for a, b in _ALLOWED)}) then next else state end as state, coalesce(next is not null and state || '>' || next not in ({', '.join(f"'{a}>{b}'" for a, b in _ALLOWED)}), false) as refused from m")
def state_guarded_transitions(t):
    i = F.col("event_id")
    e = t("events")
    moves = e.where(i % 3 > 0).select(i.alias("id"), F.element_at(F.array(*map(F.lit, ("view", "click", "purchase", "error"))), (i % 4 + 1).cast("int")).alias("to"))
    return state.transitions(e.select(i.alias("id"), F.col("event_type").alias("state")), moves, _ALLOWED)


def _delta(t, tasks: int | None = None):
    dealt = lambda d: d.repartition(tasks, "act") if tasks else d
    acts = dealt(t("orders").select(F.col("o_orderkey").alias("act"), F.col("o_orderdate").cast("date").alias("read_at"), F.col("o_orderstatus").alias("v")))
    parts = {"lines": dealt(t("lineitem").select(F.col("l_orderkey").alias("act"), "l_linenumber", F.col("l_linestatus").alias("v")))}
    return acts, parts, state.delta(acts, parts, F.lit("1997-01-01").cast("date"))


@query("select o_orderkey as act, cast(cast(o_orderdate as date) as varchar) as read_at, (select count(*) from lineitem where l_orderkey = o_orderkey) as n from orders where cast(o_orderdate as date) > date '1997-01-01'")
def state_delta_pack(t):
    _, _, (new, parts) = _delta(t)
    return new.join(parts["lines"].groupBy("act").agg(F.count("*").alias("n")), "act", "left").select("act", "read_at", F.coalesce("n", F.lit(0)).alias("n"))


@query("""with c as (select o_orderkey as act, 'x' as v from orders where o_orderkey % 2 = 0 or cast(o_orderdate as date) > date '1997-01-01'), l as (select l_orderkey as act, count(*) as n from lineitem join orders on o_orderkey = l_orderkey where o_orderkey % 2 = 0 or cast(o_orderdate as date) > date '1997-01-01' group by 1)
 select c.act, coalesce(l.n, 0) as n from c left join l on l.act = c.act""")
def state_delta_applied_twice(t):
    tasks = state.tasks_of(t("lineitem"))
    acts, parts, (new, own) = _delta(t, tasks)
    at = (acts.where("act % 2 = 0"), {"lines": parts["lines"].where("act % 2 = 0").join(acts.select("act"), "act", "left_semi")})
    for _ in range(2):
        at = state.apply_delta(*at, new, own, tasks=tasks)
    return at[0].select("act").join(at[1]["lines"].groupBy("act").agg(F.count("*").alias("n")), "act", "left").select("act", F.coalesce("n", F.lit(0)).alias("n"))


@query("select cast(max(cast(o_orderdate as date)) as varchar) as position from orders")
def state_copy_position(t):
    acts = t("orders").select(F.col("o_orderdate").cast("date").alias("read_at"))
    return state.position(acts.select(F.col("read_at").alias("position")).limit(0), acts)


@query("select user_id, count(distinct event_type) as n from events group by user_id")
def state_content_addressed_runs(t):
    runs = t("events").select("user_id", "event_type")
    store = state.appended(runs.limit(0).withColumn("hash", F.lit("")), runs, "user_id", ["event_type"])
    again = state.appended(store, runs, "user_id", ["event_type"])
    return again.groupBy("user_id").agg(F.count("*").alias("n"))


@query("""with l as (select user_id as key, max(event_id % 5 + 1) as last from events group by user_id), n as (select user_id as key, event_id % 5 + 1 as base, event_type as note from events where event_id % 2 = 0),
 a as (select n.key, last + 1 as revision, min(note) as note from n join l on l.key = n.key and base = last group by all), st as (select user_id as key, event_id % 5 + 1 as revision, event_type as note from events) select * from st union all select * from a""")
def state_next_revisions(t):
    e, i = t("events"), F.col("event_id")
    store = e.select(F.col("user_id").alias("key"), (i % 5 + 1).alias("revision"), F.col("event_type").alias("note"))
    return state.revised(store, e.where(i % 2 == 0).select(F.col("user_id").alias("key"), (i % 5 + 1).alias("base_revision"), F.col("event_type").alias("note")))


@query("""with p as (select conv_id as act, turn as locator, text from conversations), c as (select * from p where locator <= 2)
 select 'r' as report, c.act, c.locator, case when c.act % 5 = 0 then 'unavailable' when c.act % 3 = 0 then 'changed' else 'unchanged' end as now from c""")
def state_dependencies_verified(t):
    p = t("conversations").select(F.col("conv_id").alias("act"), F.col("turn").alias("locator"), "text")
    c = state.captured(p.where("locator <= 2").select(F.lit("r").alias("report"), "act", "locator"), p)
    return state.verified(c, p.where("act % 5 <> 0").withColumn("text", F.when(F.col("act") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))


@query("""with f as (select distinct user_id % 40 as report, event_type as finding from events), r as (select user_id % 40 as report, event_type as finding, event_id as seq, ['ok', 'wrong', 'later'][event_id % 3 + 1] as state from events where event_id % 11 = 0)
 select f.report, f.finding, coalesce((select arg_max(state, seq) from r where r.report = f.report and r.finding = f.finding), 'open') as state from f""")
def state_open_findings(t):
    e, i = t("events"), F.col("event_id")
    f = e.select((F.col("user_id") % 40).alias("report"), F.col("event_type").alias("finding")).distinct()
    r = e.where(i % 11 == 0).select((F.col("user_id") % 40).alias("report"), F.col("event_type").alias("finding"), i.alias("seq"), F.element_at(F.array(*map(F.lit, ("ok", "wrong", "later"))), (i % 3 + 1).cast("int")).alias("state"))
    return state.open_findings(f, r)


@query("""with f as (select c_custkey as id, c_acctbal as at from customer), k as (select *, row_number() over (order by "at" desc, id) as n from f), l as (select o_custkey as id, max(o_orderstatus) as stage from orders group by 1)
 select k.id, k."at", l.stage, case when k.id % 3 = 0 then 'deadline' else 'none' end as attention, (select count(*) from f) > 30 as truncated from k left join l on l.id = k.id where n <= 30""")
def state_follow_list(t):
    c = t("customer")
    return state.follow_list(c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("at")), t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderstatus").alias("stage")), c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("deadline").alias("attention")), 30)


@query("select count(*) as lost from orders where o_orderkey % 9 = 0")
def state_append_only_check(t):
    o = t("orders").select("o_orderkey", "o_orderstatus")
    return state.append_only(o, o.where("o_orderkey % 9 <> 0")).agg(F.count("*").alias("lost"))


# ------------------------------------------------------------------ reports
@query("select o_orderkey, o_totalprice, count(*) over () as total from orders where o_orderstatus = 'F' and o_totalprice >= 1000 and o_totalprice <= 400000 and contains(lower(o_orderpriority), 'urgent') order by o_totalprice desc, o_orderkey limit 15 offset 5")
def report_registry_page(t):
    x = reports.filtered(t("orders"), {"o_orderstatus": "F"}, {"o_totalprice": 1000}, {"o_totalprice": 400000}, ("URGENT", ["o_orderpriority", "o_orderstatus"]))
    return reports.page(x.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 15, 5)


@query("select p_partkey, p_name, (select count(*) from part) > 25 as more from part order by p_name, p_partkey limit 25")
def report_has_more(t):
    return reports.has_more(t("part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 25)


@query("with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders) select o_custkey, string_agg(o_orderkey, ',' order by n) as latest from r where n <= 3 group by o_custkey")
def report_last_three(t):
    x = reports.last_rows(t("orders").withColumn("key", s("o_orderkey")), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 3, "key", "latest")
    return x.select("o_custkey", F.array_join("latest", ",").alias("latest"))


@query("""with f as (select 'order' as kind, cast(o_orderkey as varchar) as id, cast(o_orderdate as date) as at from orders union all select 'line', l_orderkey || ':' || l_linenumber, cast(l_shipdate as date) from lineitem)
 select kind, id, cast("at" as varchar) as "at", (select count(*) from f g where g.kind = f.kind) as n_kind from f order by "at" desc, kind, id limit 80""")
def report_merged_feed(t):
    return reports.merged_feed({"order": t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("at")), "line": t("lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.col("l_shipdate").cast("date").alias("at"))}, 80)


@query("select c_custkey as act, c_mktsegment as kind from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and exists (select 1 from orders join lineitem on o_orderkey = l_orderkey where o_custkey = c_custkey and l_linenumber > 1)")
def report_structured_acts(t):
    p = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("act"), F.when(F.col("l_linenumber") == 1, "text").otherwise(F.concat(F.lit("art"), "l_linenumber")).alias("locator"))
    return reports.structured(t("customer").select(F.col("c_custkey").alias("act"), F.col("c_mktsegment").alias("kind")), p, ["BUILDING", "MACHINERY"])


@query("select l_orderkey as act, count(*) as n from lineitem group by 1 having count(*) >= 4")
def report_several_children(t):
    return reports.several_children(t("lineitem").select(F.col("l_orderkey").alias("act")), 4)


@query(f"with {SIGNATURES} select idm, leg, camera, max(name) as name, count(distinct bill) as bills from sig where contains(lower(name), 'nume é1') group by idm, leg, camera order by bills desc, idm, leg, camera limit 40")
def report_people_search(t):
    return reports.search_people(signatures(t), "NUME é1", 40)


@query(f"with {SIGNATURES} select replace(lower(name), 'é', 'e') as person, arg_max(name, struct_pack(l := leg, i := idm, n := name)) as name, count(distinct leg || ':' || camera || ':' || idm) as terms, count(distinct bill) as bills, max(leg) as newest from sig group by 1")
def report_persons(t):
    return reports.directory(signatures(t))


@query(f"with {SIGNATURES} select distinct leg from sig")
def report_legislatures(t):
    return reports.legislatures(signatures(t))


@query(f"""with {SIGNATURES}, d as (select l_orderkey as bill, l_linenumber as division, l_shipdate as at, case when l_returnflag <> 'N' then l_returnflag end as result from lineitem), g as (select bill, count(distinct idm || ':' || leg || ':' || camera) as signers from sig group by bill)
 select o_orderkey as bill, coalesce(signers, 0) as signers, coalesce((select arg_max(result, struct_pack(a := "at", d := division)) from d where d.bill = o_orderkey and result is not null), 'undecided') as result from orders left join g on g.bill = o_orderkey""")
def report_signed_bills(t):
    d = t("lineitem").select(F.col("l_orderkey").alias("bill"), F.col("l_linenumber").alias("division"), F.col("l_shipdate").alias("at"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("result"), F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    return reports.signed_bills(t("orders").select(F.col("o_orderkey").alias("bill")), signatures(t), d)


@query("select user_id % 50 as idm, case when user_id % 3 > 0 then user_id % 3 end as leg, 0 as camera, event_id as at, event_id as ord from events where user_id % 50 in (3, 4) and (user_id % 3 = 0 or user_id % 3 = 1) order by event_id desc limit 60")
def report_member_speeches(t):
    u = F.col("user_id")
    x = t("events").select((u % 50).alias("idm"), F.when(u % 3 > 0, u % 3).alias("leg"), F.lit(0).alias("camera"), F.col("event_id").alias("at"), F.col("event_id").alias("ord"))
    return reports.speeches_of(x, x.where("idm in (3, 4) and (leg is null or leg = 1)").select("idm", "leg", "camera"), 60)


_STAGES = ["signup", "view", "click", "purchase", "refund"]


@query(f"""with {EVENTS}, st as (select project, list(distinct stage) as s from ev group by project)
 select project, array_to_string(list_filter({_STAGES}, lambda x: list_contains(s, x)), ',') as covered, array_to_string(list_filter({_STAGES}, lambda x: not list_contains(s, x)), ',') as missing, list_filter({_STAGES}, lambda x: list_contains(s, x))[-1] as furthest from st""")
def report_stage_coverage(t):
    return reports.stage_coverage(events(t), _STAGES)


_MENTIONS = "mn as (select 'x' || (l_partkey % 90) as celex, l_suppkey as source, l_orderkey || ':' || l_linenumber as place from lineitem)"


@query(f"""with {_MENTIONS}, r as (select *, row_number() over (partition by celex order by source, place) as n from mn)
 select celex, count(*) as mentions, count(distinct source) as sources, string_agg(place, '|' order by n) filter (n <= 3) as examples, celex in (select 'x' || n_nationkey from nation) as imported from r group by celex""")
def report_reference_coverage(t):
    m = t("lineitem").select(F.concat(F.lit("x"), F.col("l_partkey") % 90).alias("celex"), F.col("l_suppkey").alias("source"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("where"))
    return reports.reference_coverage(m, t("nation").select(F.concat(F.lit("x"), "n_nationkey").alias("celex")))


@query(f"""with {_MENTIONS} select celex, count(*) as mentions, title, coalesce(language, 'unknown') as language from mn left join (select 'x' || s_suppkey as celex, s_name as title, case s_suppkey % 3 when 0 then 'ro' when 1 then 'other' else 'unknown' end as language from supplier) k using (celex)
 where celex not in (select 'x' || n_nationkey from nation) group by celex, title, language""")
def report_import_queue(t):
    m = t("lineitem").select(F.concat(F.lit("x"), F.col("l_partkey") % 90).alias("celex"))
    k = F.col("s_suppkey")
    known = t("supplier").select(F.concat(F.lit("x"), k).alias("celex"), F.col("s_name").alias("title"), F.when(k % 3 == 0, F.array(F.lit("en"), F.lit("ro"))).when(k % 3 == 1, F.array(F.lit("en"))).otherwise(F.array().cast("array<string>")).alias("languages"))
    return reports.import_queue(m, t("nation").select(F.concat(F.lit("x"), "n_nationkey").alias("celex")), known)


@query("select c_custkey as run, coalesce((select arg_max(o_orderstatus, o_orderkey) from orders where o_custkey = c_custkey), 'never') as status, (select count(*) from orders where o_custkey = c_custkey) as checks from customer")
def report_latest_checks(t):
    return reports.latest_checks(t("customer").select(F.col("c_custkey").alias("run")), t("orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status")))


_REPORTS = "rp as (select o_orderkey as run, 'k' || (o_custkey % 60) as a, 'k' || (o_orderkey % 60) as b from orders)"


@query(f"""with {_REPORTS}, u as (select run, a as key, 'project' as why from rp union all select run, b, 'source' from rp) select run, key, string_agg(distinct why, ',' order by why) as reasons from u where key in (select 'k' || n_nationkey from nation) group by run, key""")
def report_affected_runs(t):
    return _affected(t)


@query(f"with {_REPORTS}, u as (select run, a as key from rp union all select run, b from rp) select key, count(distinct run) as runs from u where key in (select 'k' || n_nationkey from nation) group by key")
def report_affected_counts(t):
    return reports.affected_counts(_affected(t))


def _affected(t) -> DataFrame:
    r = t("orders").select(F.col("o_orderkey").alias("run"), F.format_string('{"p": {"ids": ["k%d"]}, "s": ["k%d", "k%d"]}', F.col("o_custkey") % 60, F.col("o_orderkey") % 60, F.col("o_orderkey") % 60).alias("json"))
    return reports.affected_runs(r, "json", {"project": "$.p.ids", "source": "$.s"}, t("nation").select(F.concat(F.lit("k"), "n_nationkey").alias("key")))


@query("""with w as (select c_custkey as id, c_mktsegment as family from customer), r as (select o_orderkey as source, case when o_orderkey % 3 = 0 then 'home' else 'AUTOMOBILE' end as family, o_orderstatus as state, o_custkey as id from orders),
 k as (select w.id, w.family, r.source, r.state, row_number() over (partition by w.id, w.family order by r.state not in ('P', 'F'), r.source) as n from w left join r on r.id = w.id and r.family = case w.family when 'HOUSEHOLD' then 'home' else w.family end)
 select id, family, source, coalesce(state, 'unmatched') as state, coalesce(state in ('P', 'F'), false) as attention from k where n = 1""")
def report_watch_matches(t):
    k = F.col("o_orderkey")
    r = t("orders").select(k.alias("source"), F.when(k % 3 == 0, "home").otherwise("AUTOMOBILE").alias("family"), F.col("o_orderstatus").alias("state"), F.col("o_custkey").alias("id"))
    return reports.watch_matches(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("family")), r, {"HOUSEHOLD": "home"}, ["P", "F"])


@query("with x as (select c_custkey as id, case when c_custkey % 4 > 0 then c_custkey end as reviewed_at, (select max(o_orderkey) from orders where o_custkey = c_custkey) as changed_at from customer) select id, changed_at is not null and (reviewed_at is null or changed_at > reviewed_at) as changed from x")
def report_changed_after_review(t):
    last = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("changed_at"))
    x = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey")).alias("reviewed_at")).join(last, "id", "left")
    return reports.changed_after_review(x).select("id", "changed")


@query("""with u as (select 'order' as kind, o_orderstatus as state from orders union all select 'line', l_linestatus from lineitem union all select 'event', event_type from events)
 select coalesce(kind, 'all') as kind, coalesce(state, 'all') as state, count(*) as n from u group by rollup (kind, state)""")
def report_workspace(t):
    return reports.workspace({"order": t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state")), "line": t("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("state")), "event": t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("state"))})


@query("select n_nationkey as k, (select count(*) from customer where c_nationkey = n_nationkey) as customers, (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers from nation")
def report_cockpit(t):
    return reports.cockpit(t("nation").select(F.col("n_nationkey").alias("k")), {"customers": t("customer").select(F.col("c_nationkey").alias("k")), "suppliers": t("supplier").select(F.col("s_nationkey").alias("k"))}, "k")


@query(f"""with {EVENTS}, r as (select project, event, row_number() over (partition by project order by "at" desc, event) as n from ev), e as (select project, string_agg(event, '|' order by n) as events from r where n <= 5 group by project)
 select p.project, coalesce(events, '') as events, notes, sources from (select distinct c_custkey % 320 as project from customer) p left join e on e.project = p.project left join (select project, string_agg(distinct stage, '|' order by stage) as notes from ev group by project) n on n.project = p.project
 left join (select project, string_agg(distinct family, '|' order by family) as sources from ev group by project) f on f.project = p.project""")
def report_evidence_pack(t):
    e = events(t)
    p = t("customer").select((F.col("c_custkey") % 320).alias("project")).distinct()
    x = reports.evidence_pack(p, e.withColumn("event", s("event")), e.select("project", F.col("stage").alias("note")), e.select("project", F.col("family").alias("source")))
    return x.withColumn("events", F.coalesce("events", F.lit("")))


@query(f"""with {EVENTS}, e as (select distinct project, family from ev where event % 3 = 0), r as (select project, family, bool_or(event % 10 = 1) as failed from ev where event % 3 = 1 group by all)
 select coalesce(e.project, r.project) as project, coalesce(e.family, r.family) as family, case when failed then 'failed' when e.project is not null and failed is not null then 'both' when e.project is not null then 'seen' else 'registered' end as state from e full join r on r.project = e.project and r.family = e.family""")
def report_source_states(t):
    e = events(t)
    return reports.source_states(e.where("event % 3 = 0"), e.where("event % 3 = 1").withColumn("failed", F.col("event") % 10 == 1))


@query("""with d as (select o_orderkey as doc, o_custkey as cite_key from orders), a as (select * from d where doc % 3 > 0) select cite_key, doc, cite_key || '-' || doc as act from d where doc not in (select doc from a) and cite_key in (select cite_key from a)""")
def report_namesakes(t):
    d = t("orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("cite_key"))
    return reports.namesakes(d, d.where("doc % 3 > 0"))


@query("""with r as (select l_orderkey as celex, l_linenumber as locator, row_number() over (partition by l_orderkey order by l_linenumber) as n from lineitem), w as (select o_orderkey + 20 as celex from orders where o_orderstatus = 'P') select w.celex, r.locator from w left join r on r.celex = w.celex and n <= 4""")
def report_first_provisions(t):
    return reports.first_of_each(t("lineitem").select(F.col("l_orderkey").alias("celex"), F.col("l_linenumber").alias("locator")), "celex", [F.col("locator")], 4, t("orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 20).alias("celex")))


@query("""with p as (select o_custkey as draft, o_orderkey as bill, o_orderkey % 3 - 1 as st, o_orderkey % 2 as sa, (o_orderkey % 40) / 100.0 as j, o_orderstatus <> 'F' as live from orders), k as (select *, case when st > 0 then 0 when sa > 0 then 1 else 2 end as tier from p where live and (st > 0 or sa > 0 or j >= 0.18))
 select draft, bill, tier::int as tier, (row_number() over (partition by draft order by tier, st desc, sa desc, j desc, bill))::int as place from k""")
def report_duplicate_bills(t):
    k = F.col("o_orderkey")
    p = t("orders").select(F.col("o_custkey").alias("draft"), k.alias("bill"), (k % 3 - 1).alias("same_targets"), (k % 2).alias("same_acts"), (k % 40 / 100.0).alias("jaccard"), (F.col("o_orderstatus") != "F").alias("live"))
    return reports.duplicate_bills(p).select("draft", "bill", "tier", "place")


@query("""with v as (select p_brand, p_type, p_size, count(distinct p_partkey) as n, min(p_partkey) as f from part group by all) select p_brand, p_type, count(*) as n_values, sum(n)::bigint as entities, string_agg(p_size || ':' || n || ':' || f, '|' order by cast(p_size as varchar), n, cast(f as varchar)) as stated from v group by all having count(*) > 1""")
def report_divergent_values(t):
    return reports.divergent(t("part"), ["p_brand", "p_type"], "p_partkey", "p_size")


# ------------------------------------------------------------------ evaluation
_ITEMS = "ex as (select distinct o_orderpriority as field, o_custkey as \"case\", o_orderkey % 5 as item from orders where o_orderkey % 4 > 0), fo as (select distinct o_orderpriority as field, o_custkey as \"case\", o_orderkey % 5 as item from orders where o_orderkey % 3 > 0)"


@query(f"""with {_ITEMS}, j as (select coalesce(ex.field, fo.field) as field, ex.field is not null as e, fo.field is not null as g from ex full join fo on ex.field = fo.field and ex."case" = fo."case" and ex.item = fo.item),
 c as (select field, count(*) filter (e and g) as tp, count(*) filter (not e) as fp, count(*) filter (not g) as fn from j group by field) select field, tp, fp, fn, tp / (tp + fp) as "precision", tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1 from c""")
def eval_scores(t):
    i = t("orders").select(F.col("o_orderpriority").alias("field"), F.col("o_custkey").alias("case"), (F.col("o_orderkey") % 5).alias("item"), "o_orderkey")
    return evaluation.scores(i.where("o_orderkey % 4 > 0"), i.where("o_orderkey % 3 > 0"), "field", "item")


@query("select source, sha256(string_agg(sha256(doc_id || chr(31) || text), '' order by sha256(doc_id || chr(31) || text))) as fingerprint from documents group by source")
def eval_set_fingerprint(t):
    return evaluation.set_fingerprint(t("documents"), "source", "doc_id", "text")


@query("""select event_type, count(*) filter (event_id % 5 = 0) as correct, count(*) filter (event_id % 5 = 1) as wrong, count(*) filter (event_id % 5 = 0) / (count(*) filter (event_id % 5 = 0) + count(*) filter (event_id % 5 = 1)) as "precision" from events group by event_type""")
def eval_judged(t):
    v = F.when(F.col("event_id") % 5 == 0, "correct").when(F.col("event_id") % 5 == 1, "wrong").otherwise("open")
    return evaluation.judged_precision(t("events").withColumn("v", v), "event_type", "v")


_W = "list_distinct(regexp_extract_all(lower(translate({c}, 'ăâîșțĂÂÎȘȚ', 'aaistAAIST')), '[a-z0-9]{{4,}}'))"


@query(f"""with c as (select conv_id as "case", text as claim, {_W.format(c='text')} as w from (select distinct conv_id, text from conversations where role = 'assistant')), s as (select conv_id as "case", {_W.format(c='text')} as s from conversations where role <> 'assistant'),
 k as (select c."case", claim, coalesce(bool_or(len(list_intersect(w, s)) >= 2), false) as ok from c left join s on s."case" = c."case" group by all) select "case", count(*) as claims, count(*) filter (ok) as supported, count(*) filter (ok) / count(*) as share from k group by all""")
def eval_faithfulness(t):
    c = t("conversations").select(F.col("conv_id").alias("case"), "role", "text")
    return evaluation.faithfulness(c.where("role = 'assistant'").select("case", F.col("text").alias("claim")), c.where("role <> 'assistant'").select("case", "text"))


@query("""with x as (select event_id, list_distinct([event_id % 3, event_id % 5]) as c, [0, 1] as a, case when event_id % 7 = 0 then [] else [1] end as r from events)
 select event_id, round(0.65 * len(list_intersect(c, a)) / len(c) + 0.35 * case when len(r) = 0 then 1.0 else len(list_intersect(c, r)) / len(r) end, 6) as score from x""")
def eval_citation_score(t):
    i = F.col("event_id")
    cited = F.array_distinct(F.array(i % 3, i % 5))
    return t("events").select("event_id", evaluation.citation_score(cited, F.array(*(F.lit(x).cast("long") for x in (0, 1))), F.when(i % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(1).cast("long")))).alias("score"))


_CLAIMS = """cl as (select conv_id, case turn % 4 when 0 then text || ' [9]' when 1 then text || ' [1]' when 2 then text || ' conform lege' else text end as sentence, turn from conversations), su as (select conv_id, case when turn % 4 = 0 then 'blocked' when turn % 4 = 1 then 'cited'
 when regexp_matches(lower(translate(sentence, 'ăâîșțĂÂÎȘȚ', 'aaistAAIST')), 'lege|articol|art\\.|alin\\.|ordonanta|hotarare|obligat|interzis|termen') then 'uncited' else 'plain' end as support from cl)"""


def _support(t) -> DataFrame:
    n = F.col("turn") % 4
    c = t("conversations").select("conv_id", F.when(n == 0, F.concat("text", F.lit(" [9]"))).when(n == 1, F.concat("text", F.lit(" [1]"))).when(n == 2, F.concat("text", F.lit(" conform lege"))).otherwise(F.col("text")).alias("sentence"), F.array(F.lit(1), F.lit(2)).alias("approved"))
    return evaluation.claim_support(c)


@query(f"with {_CLAIMS} select support, count(*) as n from su group by support")
def eval_claim_support(t):
    return _support(t).groupBy("support").agg(F.count("*").alias("n"))


@query(f"with {_CLAIMS} select conv_id, case when bool_or(support = 'blocked') then 'blocked' when bool_or(support = 'uncited') then 'needs_review' else 'ok' end as verdict from su group by conv_id")
def eval_guardrail(t):
    return evaluation.guardrail(_support(t), "conv_id")


@query("select n_name as provider, c_mktsegment as model, c_custkey % 3 as task, count(*) as cases, round(avg((c_custkey % 100) / 100.0), 6) as mean, min((c_custkey % 100) / 100.0) >= 0.3 as acceptable from customer join nation on c_nationkey = n_nationkey group by all")
def eval_run_scores(t):
    x = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("provider"), F.col("c_mktsegment").alias("model"), (F.col("c_custkey") % 3).alias("task"), (F.col("c_custkey") % 100 / 100.0).alias("score"))
    return evaluation.run_scores(x, 0.3)


_FRESH = """fr as (select c_custkey as id, c_nationkey as g, case when c_custkey % 11 = 0 then 'unavailable' when c_custkey % 7 = 0 and c_custkey % 2 = 0 then 'needs_review' when m is null then 'missing' when date_diff('day', m, date '1998-08-01') < 0 then 'unknown' when date_diff('day', m, date '1998-08-01') > 400 then 'stale' else 'current' end as state
 from customer left join (select o_custkey, max(cast(o_orderdate as date)) as m from orders group by 1) o on o_custkey = c_custkey)"""


def _fresh(t) -> DataFrame:
    k = F.col("c_custkey")
    x = t("customer").join(t("orders").groupBy("o_custkey").agg(F.max(F.col("o_orderdate").cast("date")).alias("m")), k == F.col("o_custkey"), "left")
    return x.select(k.alias("id"), F.col("c_nationkey").alias("g"), evaluation.freshness(k % 11 != 0, k % 7 == 0, k % 2 != 0, F.col("m"), F.lit("1998-08-01").cast("date"), 400).alias("state"))


@query(f"with {_FRESH} select id, state from fr")
def eval_freshness(t):
    return _fresh(t).select("id", "state")


@query(f"with {_FRESH} select g, {list(evaluation.WORST)}[min(list_position({list(evaluation.WORST)}, state))] as state from fr group by g")
def eval_group_freshness(t):
    return evaluation.group_freshness(_fresh(t), "g")


@query("select l_returnflag, round(sum(cast(l_quantity as decimal(18,3))), 2)::double as low_gb, round(sum(cast(l_extendedprice as decimal(18,3))), 2)::double as high_gb from lineitem group by l_returnflag")
def eval_storage(t):
    x = evaluation.storage(t("lineitem"), "l_returnflag", "l_quantity", "l_extendedprice", 0.02)
    return x.select("l_returnflag", F.col("low_gb").cast("double"), F.col("high_gb").cast("double"))
