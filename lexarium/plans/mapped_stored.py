"""Queries of operators that keep tables in a folder: paged sources, kept-up graphs, top-k joins over the index, commits.

Each works in a new folder that driver and executors share. The SQL is written from what each query means.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upkeep import EDGE, EdgeUpkeep
from ..session import work_dir
from ..sources import paged
from ..sources.store import Store
from .mapped import CHANGE, EDGES, days_as_text, edges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable:
    def add(f):
        QUERIES[f.__name__] = (lambda spark, sf_dir: days_as_text(f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))), sql)
        return f

    return add


# ------------------------------------------------------------------ paged sources
def paged_pages(t) -> DataFrame:
    return t("pages").select(F.expr("page_id div 20").alias("page"), "page_id", "url", F.length("html").alias("n_chars"))


@query("select page_id // 20 as page, page_id % 20 as place, page_id, url, length(html)::bigint as n_chars from pages")
def source_full_crawl(spark, t):
    """All pages of a source of unknown length; page_id is dense."""
    path = work_dir(spark)
    paged.write_pages(paged_pages(t), "page", "page_id", path)
    spark.dataSource.register(paged.PagedSource)
    got = spark.read.format("paged").option("path", path).option("kept", f"{path}-kept").load()
    r = F.from_json("record", "page_id long, url string, n_chars long")
    return got.select("page", "place", r.alias("r")).select("page", F.col("place").cast("long").alias("place"), "r.page_id", "r.url", "r.n_chars")


@query("""with p as (select page_id, page_id // 20 as page, (select max(page_id) * 6 // 10 from pages) as last from pages)
 select case when page_id <= last then 0 else 1 end as batch, count(*) as n, sum(page_id)::bigint as total from p group by 1""")
def source_tail_refresh(spark, t):
    """A stream over a source that grows: the second run asks the last known page again and the new ones, and nothing else."""
    path, kept, out = work_dir(spark), work_dir(spark), work_dir(spark)
    rows = paged_pages(t)
    last = rows.agg(F.max("page_id")).first()[0] * 6 // 10
    spark.dataSource.register(paged.PagedSource)
    for n, some in enumerate((rows.where(F.col("page_id") <= last), rows)):
        paged.write_pages(some, "page", "page_id", path)
        stream = spark.readStream.format("paged").option("path", path).option("kept", kept).option("margin", 1).load().withColumn("batch", F.lit(n))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start().awaitTermination()
    r = spark.read.parquet(out).select("batch", F.get_json_object("record", "$.page_id").cast("long").alias("page_id"))
    # a record of the page that was asked again counts where it came first
    return r.groupBy("page_id").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count("*").alias("n"), F.sum("page_id").alias("total"))


# ------------------------------------------------------------------ derived tables
_SOURCE = "cast(substr(source, 2) as bigint)"


@query(f"""with {EDGES}, now as (select * from edges where {_SOURCE} % 50 in (1, 3) or ({_SOURCE} % 50 <> 2 and since < date '1998-01-01'))
 select target, count(distinct source) as citing, count(distinct source) filter ({CHANGE}) as changing, count(*) as edges, cast(max(since) filter ({CHANGE}) as varchar) as last_change from now group by target""")
def graph_upkeep(spark, t):
    """What is known of cited acts after three replacements of citing ones, by differences only."""
    e = edges(t).select(*EDGE)
    n = F.substring("source", 2, 20).cast("long") % 50
    keeper = EdgeUpkeep(spark, work_dir(spark), 16)
    acts = lambda d: d.select("source").distinct()
    keeper.replace(acts(e), e.where("since < date '1998-01-01'"))
    keeper.replace(acts(e.where(n == 1)), e)
    keeper.replace(acts(e.where(n == 2)), e.limit(0))
    keeper.replace(acts(e.where(n.isin(1, 3))), e)
    return keeper.known()


@query("""with p as (select o_orderkey % 40 as snapshot, o_orderkey, o_custkey from orders) select count(*) as n, count(distinct o_orderkey) as orders, sum(o_custkey)::bigint as total from p where snapshot < 30""")
def store_snapshot_replay(spark, t):
    """Snapshots replayed twice, then with later ones: each counts once."""
    store = Store(spark, work_dir(spark))
    rows = t("orders").select((F.col("o_orderkey") % 40).alias("snapshot"), "o_orderkey", "o_custkey")
    snapshots = rows.select("snapshot").distinct()
    for upto in (20, 20, 30):
        store.replay(snapshots.where(F.col("snapshot") < upto), {"orders": rows})
    return store.read("orders").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("orders"), F.sum("o_custkey").alias("total"))


@query("""select 'p' || p_partkey as act, case when p_partkey % 10 = 3 then 'second' else 'first' end as edition, (select count(*) from lineitem where l_partkey = p_partkey and (p_partkey % 10 <> 3 or l_linenumber = 1)) as provisions from part""")
def store_acts_replaced(spark, t):
    """Acts and their provisions replaced in one commit; a write that breaks between the two tables leaves no trace."""
    store = Store(spark, work_dir(spark))
    acts = t("part").select(F.concat(F.lit("p"), "p_partkey").alias("act"), F.lit("first").alias("edition"))
    provisions = t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("act"), "l_linenumber")
    store.put_acts(acts, {"provisions": provisions.join(acts.select("act"), "act", "left_semi")})
    some = F.substring("act", 2, 20).cast("long") % 10 == 3
    try:
        with store.transaction() as x:
            x.write("provisions", provisions.limit(0))
            raise InterruptedError
    except InterruptedError:
        pass
    store.put_acts(acts.where(some).withColumn("edition", F.lit("second")), {"provisions": provisions.where(some & (F.col("l_linenumber") == 1)).join(acts.select("act"), "act", "left_semi")})
    n = store.read("provisions").groupBy("act").agg(F.count("*").alias("n"))
    return store.read("acts").join(n, "act", "left").select("act", "edition", F.coalesce("n", F.lit(0)).alias("provisions"))


# ------------------------------------------------------------------ streams
MOVES = [("signup", "view"), ("view", "click"), ("click", "view"), ("click", "purchase"), ("purchase", "view"), ("view", "error"), ("error", "signup"), ("timed_out", "signup"), ("timed_out", "view")]
_ALLOWED = ", ".join(f"'{a}>{b}'" for a, b in MOVES)


@query(f"""with recursive e as (select 's' || user_id as source, ts as day, event_type as target, row_number() over (partition by user_id order by ts, event_id) as i from events),
 s(source, i, day, state, outcome, gone) as (select source, i, day, target, 'first', false from e where i = 1
  union all select source, i, day, case when target = b or b || '>' || target in ({_ALLOWED}) then target else b end, case when target = b then 'same' when b || '>' || target in ({_ALLOWED}) then 'moved' else 'refused' end, b <> was
  from (select e.source, e.i, e.day, e.target, s.state as was, case when e.day > s.day + interval 2 day then 'timed_out' else s.state end as b from s join e on e.source = s.source and e.i = s.i + 1) x),
 told as (select outcome, state from s union all select 'timed_out', 'timed_out' from s where gone
  union all select 'timed_out', 'timed_out' from s where i = (select max(e.i) from e where e.source = s.source) and state <> 'timed_out' and day + interval 2 day <= (select max(ts) from events))
 select outcome, state, count(*) as n from told group by all""")
def stream_source_sync(spark, t):
    """Events in three deliveries, each a restart of the query: states, refused moves and sources that fell silent."""
    from datetime import timedelta

    from ..streaming import sync

    folder, out = work_dir(spark), work_dir(spark)
    e = t("events").select(F.concat(F.lit("s"), "user_id").alias("source"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("event"), F.col("event_type").alias("to"))
    low, high = e.agg(F.min("at"), F.max("at")).first()
    cuts = [low + (high - low) * i / 3 for i in range(1, 3)]
    for k, v in sync.PROVIDER.items():
        spark.conf.set(k, v)
    for n in range(3):
        part = e.where((F.col("at") >= cuts[n - 1] if n else F.lit(True)) & (F.col("at") < cuts[n] if n < 2 else F.lit(True)))
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(e.schema).parquet(folder)
        synced = sync.synced_stream(stream, MOVES, timedelta(days=2))
        synced.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("outcome", "state").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ damaged names
_HURT = "case when k % 7 = 0 then substr(name, 1, 13) || '?' || substr(name, 15) when k % 3 = 0 then substr(name, 1, k % 6 + 1) || '?' || substr(name, k % 6 + 3) else name end"
_NAMES = f"""names as (select id, {_HURT} as name from (select 's' || s_suppkey as id, s_suppkey as k, s_name as name from supplier union all select 'c' || c_custkey, c_custkey, c_name from customer union all select 'p' || p_partkey, p_partkey * 3 + 1, p_name from part)),
 parts as (select id, unnest(regexp_extract_all(name, '[^\\s#,.;]+|[\\s#,.;]')) as word, unnest(range(len(regexp_extract_all(name, '[^\\s#,.;]+|[\\s#,.;]')))) as i from names)"""


@query(f"""with {_NAMES}, n as (select word, count(*) as n from parts group by word),
 m as (select d.word, w.word as spelling, w.n, max(w.n) over (partition by d.word) as most from n d join n w on contains(d.word, '?') and not contains(w.word, '?') and length(d.word) = length(w.word)
  and len(list_filter(range(1, length(d.word) + 1), lambda i: substr(d.word, i, 1) <> '?' and substr(d.word, i, 1) <> substr(w.word, i, 1))) = 0),
 f as (select word, min(spelling) as spelling from m where n = most group by word having count(*) = 1),
 r as (select id, bool_and(not contains(p.word, '?') or f.spelling is not null) as sure, string_agg(coalesce(f.spelling, p.word), '' order by i) as now from parts p left join f using (word) group by id)
 select id, name, case when sure then now end as repaired from names join r using (id)""")
def repair_damaged_names(spark, t):
    """Names with one damaged place each: undone where one spelling is the commonest, else null."""
    named = lambda table, letter, key, name, k: t(table).select(F.concat(F.lit(letter), key).alias("id"), k.alias("k"), F.col(name).alias("name"))
    d = named("supplier", "s", "s_suppkey", "s_name", F.col("s_suppkey")).unionAll(named("customer", "c", "c_custkey", "c_name", F.col("c_custkey"))).unionAll(named("part", "p", "p_partkey", "p_name", F.col("p_partkey") * 3 + 1))
    from ..operators.repair import repaired_names

    return repaired_names(d.select("id", F.expr(_HURT).alias("name")), "id", "name")
