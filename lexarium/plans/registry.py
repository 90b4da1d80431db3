"""Every query of the engine's own operators, with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates, graph, rules, search, similarity, state
from ..operators.segments import SegmentedIndex
from ..session import work_dir
from . import mapped, mapped_events, mapped_lifecycle, mapped_state, mapped_stored, mapped_text, sql

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
TERMS = ["thtion", "erhe", "heand", "mentation", "thing"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_plan(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Run a plan of plans.sql. Its tables are handed over as DataFrames, so a session's own views stay as they are."""
    named = re.compile(r"\b(from|join) (" + "|".join(TABLES) + r")\b")
    used = {m[2] for m in named.finditer(query)}
    df = spark.sql(named.sub(r"\1 {\2}", query), **{name: read(spark, sf_dir, name) for name in used})
    return df.select(*(F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in df.dtypes))  # days as text


_INDEXES: dict[tuple[str, str], SegmentedIndex] = {}


def _index(spark, sf_dir) -> SegmentedIndex:
    """The written index of all documents, made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        index = SegmentedIndex(spark, work_dir(spark), keep=("lang",))
        index.put(read(spark, sf_dir, "documents"))
        _INDEXES[key] = index
    return _INDEXES[key]


def _flagship(spark, sf_dir):
    return _index(spark, sf_dir).coverage(TERMS)


def _bm25(spark, sf_dir):
    return _index(spark, sf_dir).search(TERMS).rows


def _match_count(spark, sf_dir):
    index = _index(spark, sf_dir)
    return index.postings(TERMS).select("doc").distinct().join(index.live().select("doc", "lang"), "doc").groupBy("lang").agg(F.count("*").alias("n"))


def _shards(spark, sf_dir):
    index = _index(spark, sf_dir)
    n, _ = index.sizes(index.commits.latest())
    return search.prefix_shards(index.frequencies(), n)


def _citation_counts(spark, sf_dir):
    lines, orders = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    tasks = state.tasks_of(lines)
    met = lines.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = met.select(F.col("l_partkey").alias("target"), F.col("o_custkey").alias("source"), (F.col("l_returnflag") == "R").alias("amends"))
    return graph.citation_counts(edges, tasks).withColumnRenamed("target", "l_partkey")


def _candidates(spark, sf_dir):
    drafts = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("draft"), "text")
    return candidates.candidates(_index(spark, sf_dir), drafts, 10).select(F.col("draft").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def _scan_bm25(spark, sf_dir):
    return search.bm25_search(read(spark, sf_dir, "documents"), TERMS)


def _scan_coverage(spark, sf_dir):
    return search.coverage_search(read(spark, sf_dir, "documents"), TERMS)


def _after_replacement(spark, sf_dir):
    """One document in a hundred replaced, one deleted, the benchmark's items added, then small segments merged."""
    d = read(spark, sf_dir, "documents")
    index = SegmentedIndex(spark, work_dir(spark), keep=("lang",))
    index.put(d)
    index.put(d.where("doc_id % 100 = 7").withColumn("text", F.concat_ws(" ", "text", F.lit("thtion erhe thing"))))
    index.delete(d.where("doc_id % 100 = 8").select("doc_id"))
    index.put(read(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id"), "text", F.lit("en").alias("lang")))
    index.merge(2)
    return index.hydrate(index.search(TERMS, 50).rows)


def _fold(spark, sf_dir):
    k = T.fold_key(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(k.cast("binary")).alias("key_md5"), F.length(k).cast("long").alias("n"))


def _stems(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("t"))
    return d.groupBy(T.stem(F.col("t")).alias("stem")).agg(F.count("*").alias("n"), F.countDistinct("t").alias("forms"))


def _snippets(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("at", F.locate("and", F.col("text")).cast("long")).where("at > 0")
    return d.select("doc_id", "at", T.snippet(F.col("text"), F.col("at"), F.lit(3)).alias("snippet"))


def _terms(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text"), ["the", "and", "that"]), " ").alias("terms"))


def _reenact(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    lines = lines.select(F.concat_ws(":", "doc_id", "i").alias("unit"), "text")
    norms = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("norm"), "text")
    return similarity.re_enactments(lines, norms)


def _quotes(spark, sf_dir):
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote"), "text")
    return similarity.quote_gate(q, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("context"), "text")).select(F.col("quote").alias("item_id"), "verdict")


def _hrefs(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return p.groupBy("href").agg(F.countDistinct("page_id").alias("citing"), F.count("*").alias("n")).orderBy(F.desc("citing"), "href").limit(50)


def _rule(spark, sf_dir):
    rule = rules.parse("IF quantity >= 30 AND (flag = 'R' OR discount < 0.02) THEN 'refuse' ELSE 'accept'")
    names = {"quantity": F.col("l_quantity"), "flag": F.col("l_returnflag"), "discount": F.col("l_discount")}
    return read(spark, sf_dir, "lineitem").groupBy("l_linestatus", rules.compile_rule(rule, names).alias("outcome")).agg(F.count("*").alias("n"))


_FOLD = f"trim(regexp_replace(translate(lower(text), '{T.MARKED}', '{T.PLAIN}'), '\\s+', ' ', 'g'))"
_W = f"regexp_extract_all({_FOLD}, '[a-z0-9]{{3,}}')"
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as t{i}" for i, t in enumerate(TERMS))
_FLAT = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_COVERAGE = f"select doc, score from (select doc_id as doc, len(list_filter({TERMS}, lambda t: list_contains({_W}, t)))::bigint as score from documents) where score > 0 order by score desc, doc limit 25"


def _bm25_sql(docs: str, k: int, keep: str = "") -> str:
    return (
        f"with h as (select doc_id as doc, {keep} len(w) as len, {_TF} from (select doc_id, {keep} {_W} as w from ({docs}))), s as (select count(*) as n, avg(len) as mean, {', '.join(f'count(*) filter (t{i} > 0) as d{i}' for i in range(len(TERMS)))} from h), "
        f"r as (select doc, {keep} round({' + '.join(f'ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / mean))' for i in range(len(TERMS)))}, 6) as score from h, s) select doc, {keep} score from r where score > 0 order by score desc, doc limit {k}"
    )


_REPLACED = "select doc_id, lang, case when doc_id % 100 = 7 then text || ' thtion erhe thing' else text end as text from documents where doc_id % 100 <> 8 union all select item_id + 1000000000, 'en', text from benchmark"
OWN: dict[str, tuple[Query, str]] = {
    "search_coverage": (_flagship, _COVERAGE),
    "search_coverage_scan": (_scan_coverage, _COVERAGE),
    "search_bm25": (_bm25, _bm25_sql("select doc_id, text from documents", 20)),
    "search_bm25_scan": (_scan_bm25, _bm25_sql("select doc_id, text from documents", 20)),
    "search_after_replacement": (_after_replacement, _bm25_sql(_REPLACED, 50, "lang,")),
    "search_candidates": (
        _candidates,
        f"with d as (select distinct doc_id, unnest({_W}) as t from documents), n as (select t, floor(1000 * ln((select count(*) from documents)::double / count(*)))::bigint as w from d group by t having count(*) <= 0.1 * (select count(*) from documents)), q as (select distinct item_id, unnest({_W}) as t from benchmark), "
        "s as (select item_id, doc_id, sum(w)::bigint as score from q join n using (t) join d using (t) group by all), r as (select *, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from s where score > 0) select item_id, rank, doc_id, score from r where rank <= 10",
    ),
    "search_match_count": (_match_count, f"select lang, count(distinct doc_id) as n from documents where list_has_any({_W}, {TERMS}) group by lang"),
    "search_prefix_shards": (_shards, f"with p as (select distinct doc_id, unnest({_W}) as token from documents), t as (select token, count(*) as df from p group by token) select token[1:3] as prefix, count(*) as n_tokens, sum(df)::bigint as n_postings from t where df <= 0.4 * (select count(*) from documents) group by 1"),
    "text_fold_key": (_fold, f"select doc_id, md5({_FOLD}) as key_md5, length({_FOLD})::bigint as n from documents"),
    "text_stems": (_stems, f"with t as (select unnest(list_distinct({_W})) as t from documents) select regexp_replace(t, '^(.{{4,}}?)({'|'.join(T.SUFFIXES)})$', '\\1') as stem, count(*) as n, count(distinct t) as forms from t group by 1"),
    "text_snippet": (
        _snippets,
        """with d as (select doc_id, text, strpos(text, 'and')::bigint as p from documents), s as (select *, greatest(p - 110, 1) as a, least(p + 3 + 109, length(text)) as e from d where p > 0) select doc_id, p as "at", case when a > 1 then '...' else '' end || substr(text, a, e - a + 1) || case when e < length(text) then '...' else '' end as snippet from s""",
    ),
    "text_query_terms": (
        _terms,
        f"with t as (select item_id, {_W} as w from benchmark), u as (select item_id, list_filter(list_transform(range(1, len(w) + 1), lambda i: case when list_position(w, w[i]) = i then w[i] end), lambda x: x is not null and x not in ('the', 'and', 'that')) as k from t) select item_id, array_to_string(k[1:12], ' ') as terms from u",
    ),
    "sim_re_enactments": (
        _reenact,
        f"with l as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents), u as (select doc_id || ':' || i as unit, {_FLAT} as f from l), b as (select item_id as norm, {_FLAT} as f from benchmark), ug as (select distinct unit, unnest(list_transform(range(1, length(f) - 3), lambda i: substr(f, i, 5))) as g from u where len(string_split(f, ' ')) >= 15), "
        "bg as (select distinct norm, unnest(list_transform(range(1, length(f) - 3), lambda i: substr(f, i, 5))) as g from b where len(string_split(f, ' ')) >= 15), nu as (select unit, count(*) as n_u from ug group by unit), nb as (select norm, count(*) as n_b from bg group by norm), "
        "h as (select unit, norm, count(*) as both_n from ug join bg using (g) group by all) select unit, norm, round(both_n / n_b, 6) as part from h join nu using (unit) join nb using (norm) where n_u <= 3 * n_b and round(both_n / n_b, 6) >= 0.8",
    ),
    "graph_link_counts": (_hrefs, "with p as (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages) select href, count(distinct page_id) as citing, count(*) as n from p group by href order by citing desc, href limit 50"),
    "rule_outcomes": (_rule, "select l_linestatus, case when l_quantity is null or l_returnflag is null or l_discount is null then null when l_quantity >= 30 and (l_returnflag = 'R' or l_discount < 0.02) then 'refuse' else 'accept' end as outcome, count(*) as n from lineitem group by all"),
}


#: Columns that hold days; both engines give them as text.
DAYS = {"amendment_timeline": "day", "as_of_version": "day", "change_detection": "day", "feed_merge_capped": "day", "neighbours_first_edge": "day", "strike_summary": "earliest", "upsert_latest": "day", "who_cites": "since"}


def _as_text(name: str, query: str) -> str:
    return f"select * replace (cast({DAYS[name]} as varchar) as {DAYS[name]}) from ({query}) q" if name in DAYS else query


def _further() -> dict[str, tuple[Query, str]]:
    return mapped.QUERIES | mapped_events.QUERIES | mapped_lifecycle.QUERIES | mapped_state.QUERIES | mapped_stored.QUERIES | mapped_text.QUERIES


def queries() -> dict[str, Query]:
    own = {name: f for name, (f, _) in (OWN | _further()).items()}
    plans = {name: (lambda spark, sf_dir, p=p: run_plan(spark, sf_dir, p(sql.Spark))) for name, p in sql.PLANS.items()}
    return own | plans | {"quote_gate": _quotes, "citation_counts": _citation_counts}


def oracle_sql() -> dict[str, str]:
    return {name: q for name, (_, q) in (OWN | _further()).items()} | {name: _as_text(name, p(sql.Duck)) for name, p in sql.PLANS.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagship(spark, sf_dir)
