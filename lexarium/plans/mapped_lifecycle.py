"""Queries of operators.lifecycle on the driver's tables. The SQL is written from what each query means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle
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


def events(t) -> DataFrame:
    return t("events").select((F.col("user_id") % 300).alias("project"), F.col("event_id").alias("event"), F.col("ts").alias("at"), F.col("event_type").alias("stage"))


_EVENTS = "ev as (select user_id % 300 as project, event_id as event, ts as moment, event_type as stage from events)"


@query(f"""with {_EVENTS} select case stage when 'signup' then 'announced' when 'purchase' then 'done' else 'open' end as status, stage <> 'error' as live, count(*) as n from ev group by all""")
def lifecycle_statuses(spark, t):
    status = lifecycle.canonical_status(F.upper("stage"), {"signup": "announced", "purchase": "done"}, "open")
    return events(t).groupBy(status.alias("status"), lifecycle.live(F.col("stage"), ["rror"]).alias("live")).agg(F.count("*").alias("n"))


@query(f"""with {_EVENTS}, l as (select *, lag(stage) over (partition by project order by moment, event) as was from ev), m as (select *, row_number() over (partition by project order by moment desc, event desc) as k from l where was is not null and stage <> was)
 select project, stage, was, cast(cast(moment as date) as varchar) as day from m where k = 1 and cast(moment as date) <= date '2024-01-30' and date_diff('day', cast(moment as date), date '2024-01-30') <= 2""")
def lifecycle_recent_changes(spark, t):
    r = lifecycle.recent_stage_changes(events(t), F.lit("2024-01-30").cast("date"), 2)
    return r.select("project", "stage", "was", F.to_date("at").alias("day"))


@query("""with l as (select l_partkey, l_orderkey, l_linenumber, min(l_returnflag) as l_returnflag, min(l_suppkey) as l_suppkey from lineitem group by 1, 2, 3),
 s as (select l_partkey as source, l_orderkey * 10 + l_linenumber as moment, l_returnflag as stage, cast(l_suppkey % 3 as varchar) as deadline, list_distinct(['d' || (l_suppkey % 4), 'd' || (l_linenumber % 4)]) as documents from l),
 w as (select *, lag(stage) over o as ws, lag(deadline) over o as wd, lag(documents) over o as wf, row_number() over o as n from s window o as (partition by source order by moment)),
 e as (select source, moment, 'opened' as kind, stage as value from w where n = 1 union all select source, moment, 'stage', stage from w where n > 1 and stage <> ws union all select source, moment, 'deadline', deadline from w where n > 1 and deadline <> wd
  union all select source, moment, 'document', unnest(list_filter(documents, lambda d: wf is null or not list_contains(wf, d))) from w) select source, moment, kind, value from e""")
def lifecycle_snapshot_events(spark, t):
    k = lambda c: F.concat(F.lit("d"), (F.col(c) % 4).cast("string"))
    one = t("lineitem").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_suppkey").alias("l_suppkey"))
    s = one.select(F.col("l_partkey").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_returnflag").alias("stage"), (F.col("l_suppkey") % 3).cast("string").alias("deadline"), F.array_distinct(F.array(k("l_suppkey"), k("l_linenumber"))).alias("documents"))
    return lifecycle.snapshot_events(s).withColumnRenamed("at", "moment")


@query(f"""with {_EVENTS}, n as (select 'n' || event as note, project, event, 'kept' as text from ev where event % 10 = 0), a as (select * from ev where event % 5 = 0 and event % 10 <> 0)
 select note, project, event, text from n union all select sha256('{{"f00":"' || project || '","f01":"' || event || '"}}'), project, event, stage from a""")
def lifecycle_notes(spark, t):
    e = events(t)
    notes = e.where("event % 10 = 0").select(F.concat(F.lit("n"), F.col("event").cast("string")).alias("note"), "project", "event", F.lit("kept").alias("text"))
    out = lifecycle.notes_of(e, notes, e.where("event % 5 = 0"))
    return out.withColumn("text", F.regexp_replace("text", "^.*: ", ""))


@query("""with r as (select case when c_custkey % 2 = 0 then c_custkey end as id, case when c_custkey % 3 = 0 then 'u' || (c_custkey % 40) end as url, c_mktsegment as quality from customer), i as (select id, min(quality) as q from r group by id), u as (select url, min(quality) as q from r where url is not null group by url)
 select o_custkey as source, 'u' || (o_orderkey % 50) as url, coalesce(i.q, u.q, 'unknown') as quality from orders left join i on i.id = o_custkey left join u on u.url = 'u' || (o_orderkey % 50)""")
def lifecycle_evidence_classes(spark, t):
    k = F.col("c_custkey")
    r = t("customer").select(F.when(k % 2 == 0, k).alias("id"), F.when(k % 3 == 0, F.concat(F.lit("u"), (k % 40).cast("string"))).alias("url"), F.col("c_mktsegment").alias("quality"))
    return lifecycle.evidence_classes(t("orders").select(F.col("o_custkey").alias("source"), F.concat(F.lit("u"), (F.col("o_orderkey") % 50).cast("string")).alias("url")), r)


@query("""with o as (select l_suppkey as draft, l_orderkey * 10 + l_linenumber as ord, l_partkey as act, 'art' || l_linenumber as locator, l_returnflag as kind from lineitem where l_partkey in (select p_partkey from part where p_size < 20)),
 n as (select *, row_number() over (partition by draft order by ord, act, locator) as k from o) select draft, ord, act, locator, kind from n where k <= 20""")
def lifecycle_draft_operations(spark, t):
    o = t("lineitem").select(F.col("l_suppkey").alias("draft"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_partkey").alias("act"), F.concat(F.lit("art"), F.col("l_linenumber").cast("string")).alias("locator"), F.col("l_returnflag").alias("kind"))
    return lifecycle.draft_operations(o, t("part").where("p_size < 20").select(F.col("p_partkey").alias("act")), 20).select("draft", "ord", "act", "locator", "kind")


@query("""select count(*) as n, count(*) filter (c) as comparable, round(100 * count(*) filter (c) / count(*), 1) as percent from (select len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 60 as c from documents)""")
def lifecycle_comparable(spark, t):
    return lifecycle.comparable(t("documents"), "text", 60)


@query("""with k as (select conv_id as act, unnest(list_distinct(regexp_extract_all(translate(lower(text), 'áàâäãåăéèêëíìîïóòôöõúùûüçñșşțţýÿ', 'aaaaaaaeeeeiiiiooooouuuucnssttyy'), '[a-z0-9]{3,}'))) as token from conversations) select act, count(distinct token) as n from k group by act""")
def lifecycle_act_tokens(spark, t):
    return lifecycle.act_tokens(t("conversations").select(F.col("conv_id").alias("act"), "text"), "act", "text").groupBy("act").agg(F.count("*").alias("n"))


@query("""select distinct l_orderkey as source, case l_returnflag when 'R' then 'abroga' else 'modifica' end as kind, 'assumed' as certainty from lineitem where l_returnflag in ('R', 'A')""")
def lifecycle_flag_edges(spark, t):
    return lifecycle.flag_edges(t("lineitem").groupBy(F.col("l_orderkey").alias("source")).agg(F.collect_list("l_returnflag").alias("marks")), {"R": "abroga", "A": "modifica"})


@query("""with o as (select l_partkey as act, l_linenumber as locator, count(*) as changes, max(l_shipdate) as last from lineitem where l_returnflag <> 'N' group by all) select o.act, o.locator, changes, cast(cast(last as date) as varchar) as last, p_name as text from o left join part on p_partkey = o.act and o.locator <= p_size % 5""")
def lifecycle_changed_provisions(spark, t):
    o = t("lineitem").where("l_returnflag <> 'N'").select(F.col("l_partkey").alias("act"), F.col("l_linenumber").cast("long").alias("locator"), F.col("l_shipdate").cast("date").alias("since"), F.col("l_returnflag").alias("kind"))
    p = t("part").select(F.col("p_partkey").alias("act"), F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("p_size") % 5, F.lit(0)).cast("long"))).alias("locator"), F.col("p_name").alias("text"), "p_size").where("locator <= p_size % 5")
    return lifecycle.changed_provisions(o, p)


@query("""select p_partkey, p_name || ' & "' || p_type || '" <' || p_size || '>' as title, ' ' || p_name || ' &amp;  &quot;' || p_type || '&quot; &lt;' || p_size || '&gt;' as was from part where p_partkey % 2 = 0""")
def lifecycle_repaired_titles(spark, t):
    raw = F.format_string(" %s &amp;  &quot;%s&quot; &lt;%s&gt;", "p_name", "p_type", F.col("p_size").cast("string"))
    return lifecycle.repaired_titles(t("part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, raw).otherwise(F.col("p_name")).alias("title")), "title").select("p_partkey", "title", "was")


@query("""select p_partkey, p_name, p_type, p_size from part where p_type in ('ECONOMY', 'LARGE') and p_size <= 20 and contains(lower(p_name), 'old')""")
def lifecycle_matrix_rows(spark, t):
    return lifecycle.matching(t("part").select("p_partkey", "p_name", "p_type", "p_size"), {"p_type": ["ECONOMY", "LARGE"]}, {"p_size": 20}, ("p_name", "old"))


@query("""select 'acts' as part, 'all' as measure, count(*)::bigint as value from part union all select 'acts', 'short', count(*) filter (p_size < 10) from part union all select 'edges', 'all', count(*) from lineitem union all select 'edges', 'targets', count(distinct l_partkey) from lineitem union all select 'projects', 'open', count(*) filter (o_orderstatus = 'O') from orders""")
def lifecycle_overview(spark, t):
    return lifecycle.overview({"acts": (t("part"), {"all": F.count("*"), "short": F.count_if(F.col("p_size") < 10)}), "edges": (t("lineitem"), {"all": F.count("*"), "targets": F.countDistinct("l_partkey")}), "projects": (t("orders"), {"open": F.count_if(F.col("o_orderstatus") == "O")})})


@query("""select o_orderkey % 20 as page, count(*) as n, max(case when o_orderkey % 20 < 10 then 1 else 2 end) as run from orders group by 1""")
def lifecycle_examined_once(spark, t):
    """Decisions examined in two runs, the second over all of them: each is examined once, in the run that first saw it."""
    store = Store(spark, work_dir(spark))
    o = t("orders").select("o_orderkey", (F.col("o_orderkey") % 20).alias("page"))
    for run, some in ((1, o.where("page < 10")), (2, o), (3, o)):
        lifecycle.examine_once(store, some, "o_orderkey", lambda d, run=run: d.withColumn("run", F.lit(run)), "strikes")
    return store.read("strikes").groupBy("page").agg(F.count("*").alias("n"), F.max("run").alias("run"))
