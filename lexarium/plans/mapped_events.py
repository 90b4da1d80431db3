"""Queries of the tracker's events and syncs, edges from operations and citations, ranking of hits, written copies, tools.

The SQL is written from what each query means.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tools
from ..operators import evaluation, graph, search, similarity, tracker
from ..session import work_dir
from ..sources.store import Store
from .mapped import days_as_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable:
    def add(f):
        QUERIES[f.__name__] = (lambda spark, sf_dir: days_as_text(f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))), sql)
        return f

    return add


text = lambda *parts: F.concat(*(F.lit(p[1:]) if p.startswith("'") else F.col(p).cast("string") for p in parts))

# ------------------------------------------------------------------ events
_KINDS = {"signup": "stage", "view": "opinion", "purchase": "vote"}


@query("""with e as (select case event_type when 'signup' then 'stage' when 'view' then 'opinion' when 'purchase' then 'vote' end as event_type, case event_type when 'signup' then 0 when 'view' then 1 when 'purchase' then 2 end as k, user_id % 40 as project, 's' || (event_id % 5) as source,
  case when event_id % 13 > 0 then cast(ts as date) end as occurred, event_type || ' ' || (event_id % 3) as title from events where event_type in ('signup', 'view', 'purchase'))
 select distinct event_type, project, 'chamber' as family, source, cast(occurred as varchar) as occurred, title, sha256('{"f00":"' || title || '","f01":' || coalesce('"' || occurred || '"', 'null') || '}') as content, coalesce(cast(occurred as varchar), '9999') || ':' || k || ':' || title as place from e""")
def tracker_typed_events(spark, t):
    e = t("events").select((F.col("user_id") % 40).alias("project"), F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")).alias("source"), F.when(F.col("event_id") % 13 > 0, F.col("ts").cast("date")).alias("occurred"), F.concat(F.col("event_type"), F.lit(" "), (F.col("event_id") % 3).cast("string")).alias("title"), "event_type")
    return tracker.typed_events({kind: e.where(F.col("event_type") == name).drop("event_type") for name, kind in _KINDS.items()}, "chamber")


_ACTS = "acts as (select 'a' || o_orderkey as act, case when o_orderkey % 9 > 0 then o_custkey end as issue, case when o_orderkey % 11 > 0 then cast(o_orderdate as date) end as day, case when o_orderkey % 4 > 0 then 'I' end as part from orders)"


def acts(t) -> DataFrame:
    k = F.col("o_orderkey")
    return t("orders").select(text("'a", "o_orderkey").alias("act"), F.when(k % 9 > 0, F.col("o_custkey")).alias("issue"), F.when(k % 11 > 0, F.col("o_orderdate").cast("date")).alias("day"), F.when(k % 4 > 0, "I").alias("part"))


@query(f"""with {_ACTS}, s as (select *, 'M.Of. ' || case when part is null then '' else 'P. ' || part || ' ' end || issue || ' ' || day as title from acts where issue is not null and day is not null)
 select 'publication' as event_type, act as project, 'gazette' as family, act as source, cast(day as varchar) as occurred, sha256('{{"f00":"' || title || '"}}') as content, title from s""")
def tracker_gazette_events(spark, t):
    return tracker.gazette_events(acts(t))


_PARSED = "parsed as (select act, case when length(act) % 5 = 0 then null when issue % 7 = 0 then issue + 1 else coalesce(issue, 5) end as issue, case when length(act) % 5 = 0 then null when issue % 5 = 0 then day + 1 else coalesce(day, date '1996-01-01') end as day from acts where issue is null or issue % 3 > 0)"


def parsed(t) -> DataFrame:
    i, none = F.col("issue"), F.length("act") % 5 == 0
    return acts(t).where(i.isNull() | (i % 3 > 0)).select("act", F.when(none, None).when(i % 7 == 0, i + 1).otherwise(F.coalesce(i, F.lit(5))).alias("issue"), F.when(none, None).when(i % 5 == 0, F.date_add("day", 1)).otherwise(F.coalesce("day", F.lit("1996-01-01").cast("date"))).alias("day"))


_ISSUES = f"""with {_ACTS}, {_PARSED}, x as (select a.act, a.issue, a.day, p.issue as i, p.day as d from acts a left join parsed p on p.act = a.act),
 r as (select act, list_filter([case when i is null and d is null then 'not_parsed' end, case when issue is null and i is not null then 'issue_missing' end, case when issue <> i then 'issue_differs' end, case when day is null and d is not null then 'day_missing' end, case when day <> d then 'day_differs' end], lambda v: v is not null) as issues from x)"""


@query(f"{_ISSUES} select act, array_to_string(issues, ',') as issues from r")
def tracker_reconciled(spark, t):
    return tracker.reconciled(acts(t), parsed(t)).select("act", F.array_join("issues", ",").alias("issues"))


@query(f"{_ISSUES} select issue, count(*) as n from (select unnest(issues) as issue from r) group by issue")
def tracker_reconciliation_report(spark, t):
    return tracker.reconciliation_report(tracker.reconciled(acts(t), parsed(t)))


@query("""with r as (select c_custkey as source, case when c_custkey % 4 > 0 then md5(c_name) end as hash, c_mktsegment as state from customer),
 f as (select c_custkey as source, case when c_custkey % 3 = 0 then md5(c_name) else md5(c_mktsegment) end as hash, case when c_custkey % 7 = 0 then 'http 500' end as error from customer where c_custkey % 5 > 0),
 o as (select r.*, f.hash as now, case when f.source is null then 'not_fetched' when error is not null then 'failed' when r.hash is null then 'first' when r.hash = f.hash then 'unchanged' else 'changed' end as outcome from r left join f using (source))
 select source, case when outcome in ('first', 'changed') then now else hash end as hash, case outcome when 'failed' then 'failed' when 'changed' then 'needs_review' when 'not_fetched' then state else 'current' end as state, outcome from o""")
def tracker_synced(spark, t):
    c, k = t("customer"), F.col("c_custkey")
    registry = c.select(k.alias("source"), F.when(k % 4 > 0, F.md5("c_name")).alias("hash"), F.col("c_mktsegment").alias("state"))
    fetched = c.where(k % 5 > 0).select(k.alias("source"), F.when(k % 3 == 0, F.md5("c_name")).otherwise(F.md5("c_mktsegment")).alias("hash"), F.when(k % 7 == 0, "http 500").alias("error"))
    return tracker.synced(registry, fetched)


@query("""with s as (select event_id, case when event_id % 11 = 0 then ' ' else event_type end as source, case when event_id % 7 > 0 then ts end as captured, case when event_id % 5 = 0 then '' else props end as payload, case when event_id % 3 = 0 then 'other' else sha256(props) end as sha from events)
 select event_id, case when source = ' ' then 'no_source' when captured is null then 'no_time' when payload = '' then 'no_payload' else 'hash_differs' end as reason from s where source = ' ' or captured is null or payload = '' or sha256(payload) <> sha""")
def tracker_invalid_snapshots(spark, t):
    i = F.col("event_id")
    s = t("events").select(i, F.when(i % 11 == 0, " ").otherwise(F.col("event_type")).alias("source"), F.when(i % 7 > 0, F.col("ts")).alias("captured"), F.when(i % 5 == 0, "").otherwise(F.col("props")).alias("payload"), F.when(i % 3 == 0, "other").otherwise(F.sha2("props", 256)).alias("sha256"))
    return tracker.invalid_snapshots(s).select("event_id", "reason")


# ------------------------------------------------------------------ edges, marks, hits
@query("""with l as (select 'p' || (l_partkey % 300) as source, 'art' || l_linenumber as source_locator, case when l_suppkey % 6 > 0 then 'p' || (l_suppkey * 7 % 300) end as act, 'art' || (l_suppkey % 9) as locator, l_returnflag as f from lineitem),
 ops as (select source, source_locator, act as target, locator, case f when 'R' then 'abroga' else 'modifica' end as kind from l where f in ('R', 'A') and act is not null and act <> source),
 refs as (select source, source_locator, act as target, locator, 'refera' as kind from l where f = 'N' and act is not null and act <> source and not exists (select 1 from ops o where o.source = l.source and o.target = l.act)),
 e as (select distinct * from (select * from ops union all select * from refs)) select e.*, case when cast(substr(e.source, 2) as int) % 10 > 0 then '2000-01-' || lpad(cast(cast(substr(e.source, 2) as int) % 10 as varchar), 2, '0') end as since from e""")
def graph_edges_built(spark, t):
    k = F.col("l_suppkey")
    x = t("lineitem").select(F.concat(F.lit("p"), (F.col("l_partkey") % 300).cast("string")).alias("source"), text("'art", "l_linenumber").alias("source_locator"), F.when(k % 6 > 0, F.concat(F.lit("p"), (k * 7 % 300).cast("string"))).alias("act"), F.concat(F.lit("art"), (k % 9).cast("string")).alias("locator"), F.col("l_returnflag").alias("f"))
    ops = x.where("f in ('R', 'A')").withColumn("kind", F.when(F.col("f") == "R", "abroga").otherwise("modifica"))
    n = F.substring("source", 2, 9).cast("int") % 10
    since = x.select("source").distinct().where(n > 0).withColumn("since", F.concat(F.lit("2000-01-"), F.lpad(n.cast("string"), 2, "0")))
    return graph.edges_of(since, ops, x.where("f = 'N'"))


@query("""with m as (select distinct p_partkey % 50 as page, lower(p_type) as m from part), f as (select p_partkey % 50 as page, lower(p_name) || ' ' || lower(p_type) as f from part where p_size % 3 = 0)
 select count(*) as marks, count(*) filter (hit) as found, count(*) filter (hit) / count(*) as recall from (select exists (select 1 from f where f.page = m.page and (contains(f.f, m.m) or contains(m.m, f.f))) as hit from m)""")
def eval_mark_recall(spark, t):
    page = (F.col("p_partkey") % 50).alias("page")
    return evaluation.mark_recall(t("part").select(page, F.col("p_type").alias("mark")), t("part").where("p_size % 3 = 0").select(page, F.concat_ws(" ", "p_name", "p_type").alias("text")))


@query("""with h as (select l_partkey as act, count(*) filter (l_returnflag = 'R') as title_hits, count(*) as body_hits from lineitem group by 1)
 select act, title_hits, body_hits, p_size as rank, p_size % 7 as citations, p_name as title from h join part on p_partkey = act order by title_hits desc, rank, citations desc, length(title), body_hits desc, act limit 40""")
def search_title_ranking(spark, t):
    h = t("lineitem").groupBy(F.col("l_partkey").alias("act")).agg(F.count_if(F.col("l_returnflag") == "R").alias("title_hits"), F.count("*").alias("body_hits"))
    a = t("part").select(F.col("p_partkey").alias("act"), F.col("p_size").alias("rank"), (F.col("p_size") % 7).alias("citations"), F.col("p_name").alias("title"))
    return search.title_ranking(h, a, 40)


@query("""with e as (select o_custkey as act, o_orderkey % 5 as art, o_totalprice as score from orders where o_orderpriority like '1%'), x as (select o_custkey as act, o_orderkey % 5 as art, o_totalprice / 2 as score from orders where o_orderpriority like '2%'),
 r as (select act, art, 0 as tier, max(score) as score from e group by all union all select act, art, 1, max(score) from x where not exists (select 1 from e where e.act = x.act and e.art = x.art) group by all) select act, art, tier, score from r order by tier, score desc, act, art limit 500""")
def search_merged_hits(spark, t):
    o = lambda p, c: t("orders").where(F.col("o_orderpriority").startswith(p)).select(F.col("o_custkey").alias("act"), (F.col("o_orderkey") % 5).alias("art"), c.alias("score"))
    return search.merged_hits(o("1", F.col("o_totalprice")), o("2", F.col("o_totalprice") / 2), ["act", "art"], 500)


_GRAMS = "list_distinct(list_transform(range(1, length({c}) - 3), lambda i: substr({c}, i, 5)))"


@query(f"""with p as (select p_partkey, lower(p_name) as a, lower(p_type || ' ' || p_name) as b from part), g as (select p_partkey, {_GRAMS.format(c="a")} as u, {_GRAMS.format(c="b")} as v from p)
 select p_partkey as unit, p_partkey as norm, round(len(list_intersect(u, v)) / greatest(len(list_distinct(list_concat(u, v))), 1), 6) as jaccard from g""")
def sim_symmetric(spark, t):
    k = F.col("p_partkey")
    return similarity.symmetric(t("part").select(k.alias("key"), k.alias("unit"), F.col("p_name").alias("text")), t("part").select(k.alias("key"), k.alias("norm"), F.concat_ws(" ", "p_type", "p_name").alias("text")))


# ------------------------------------------------------------------ written index by prefix, copies, tools
PREFIXES = ["thtio", "hean", "eren"]
_FOLDED = "regexp_extract_all(translate(lower(text), 'áàâäãåăéèêëíìîïóòôöõúùûüçñșşțţýÿ', 'aaaaaaaeeeeiiiiooooouuuucnssttyy'), '[a-z0-9]{3,}')"


@query(f"""with d as (select doc_id as doc, lang, list_filter({PREFIXES}, lambda p: len(list_filter({_FOLDED}, lambda w: starts_with(w, p))) > 0) as f from documents) select doc, len(f)::bigint as score, lang from d where len(f) > 0 order by score desc, doc limit 30""")
def search_prefixes(spark, t):
    path = work_dir(spark)
    search.build_index(t("documents"), path, keep=("lang",))
    return search.indexed_search(spark, path, PREFIXES, 30, bm25=False, prefixes=True)


@query("""select 'orders' as name, 'r1' as release, count(*) as n from orders union all select 'part', 'r1', count(*) from part union all select 'part', 'r2', count(*) from part""")
def store_cut_and_published(spark, t):
    store = Store(spark, work_dir(spark))
    with store.transaction() as x:
        x.write("orders", t("orders"))
        x.write("part", t("part"))
    return store.cut(["orders", "part"], work_dir(spark), "r1", {"orders": "o_orderkey"}).unionAll(store.publish(work_dir(spark), {"part": ["p_partkey", "p_name"]}, "r2"))


@query("""select cast(user_id % 40 as varchar) as project, strftime(ts, '%Y-%m-%d %H:%M:%S') as "at", event_type || ' ' || event_id as event from events where user_id % 40 = 7 order by ts, event limit 30""")
def tools_project_timeline(spark, t):
    path = work_dir(spark)
    Store(spark, path).write("events", t("events").select((F.col("user_id") % 40).cast("string").alias("project"), F.col("ts").alias("at"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("event")))
    return tools.call(spark, path, "project_timeline", {"project": "7", "limit": 30}).select("project", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "event")
