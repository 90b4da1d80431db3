"""Queries that apply text functions and source normalisers to strings made of the driver's tables, with their SQL.

A string is spelt oddly on Spark's side; the SQL builds the plain spelling from the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files
from .mapped import days_as_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (lambda spark, sf_dir: days_as_text(f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))), sql)
        return f

    return add


def spelt(template: str, **columns: str):
    """The template with each {name} replaced by a column's value."""
    parts = [F.lit("")]
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        parts.append(F.col(columns.get(piece, piece)).cast("string") if i % 2 else F.lit(piece))
    return F.concat(*parts)


@query("""select p_partkey, 'art. ' || p_partkey || '^' || 12 || ' din "' || p_name || '" - anexa ' || p_size || '^' || p_partkey || chr(10) || chr(10) || 'și ț' as n from part""")
def text_normalise(t):
    odd = spelt("﻿  art. {p_partkey}¹² \t din „{p_name}” – anexa {p_size} ind. {p_partkey}  \n\n\n\n  şi ţ ​")
    return t("part").select("p_partkey", T.normalise(odd).alias("n"))


@query("select s_suppkey, 'hotararea nr. ' || s_suppkey || ' insusi: ' || lower(s_name) as k from supplier")
def text_romanian_key(t):
    return t("supplier").select("s_suppkey", T.romanian_key(spelt(" Hotărârea  Nr. {s_suppkey} ÎNSUȘI: {s_name} ")).alias("k"))


_KEY = r"trim(regexp_replace(lower(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), 'ăĂâÂîÎșȘțȚ', 'aAaAiIsStT')), '[ \t]+', ' ', 'g'))"


@query(f"""select doc_id, md5(array_to_string(list_transform(string_split({_KEY}, ' '), lambda w: regexp_replace(w, '(?s)^(.{{4,}}?)({"|".join(T.SUFFIXES)})$', '\\1')), ' ')) as stems from documents""")
def text_stem_phrases(t):
    return t("documents").select("doc_id", F.md5(T.stem_phrase(F.col("text")).cast("binary")).alias("stems"))


@query("select doc_id, md5(text) as text_md5 from documents")
def text_without_markers(t):
    marked = F.replace("text", F.lit("\n"), F.lit("\n + \t\n"))
    return t("documents").select("doc_id", F.md5(T.without_markers(marked).cast("binary")).alias("text_md5"))


_NAMES = ["LEGE", "Ordonanță de urgență", "Ordonanţă", "Hotărâre", "Ordin ", "Decret"]


@query("""select o_orderkey, case when o_orderkey % 7 < 6 then ['lege', 'oug', 'og', 'hg', 'ordin', 'decret'][o_orderkey % 7 + 1] else trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') end as slug from orders""")
def text_slugs(t):
    k = F.col("o_orderkey") % 7
    return t("orders").select("o_orderkey", T.slug(F.when(k < 6, F.get(F.array(*map(F.lit, _NAMES)), k.cast("int"))).otherwise(F.concat(F.col("o_orderpriority"), F.lit(" !")))).alias("slug"))


_KINDS = "['constitutie', 'lege', 'oug', 'decret', 'hg', 'ordin', 'altul', null]"
_RANKS = "[0, 1, 1, 2, 3, 4, 9, 9]"


@query(f"""with k as (select l_orderkey, l_linenumber, l_partkey % 8 + 1 as i, l_suppkey % 8 + 1 as j from lineitem)
 select {_KINDS}[i] as by, {_KINDS}[j] as target, {_RANKS}[i]::int as rank, {_KINDS}[i] is null or {_KINDS}[j] is null or {_RANKS}[i] <= {_RANKS}[j] as may, count(*) as n from k group by all""")
def text_legal_rank(t):
    kinds = F.array(*map(F.lit, ("constitutie", "lege", "oug", "decret", "hg", "ordin", "altul")))
    k = t("lineitem").select(F.get(kinds, (F.col("l_partkey") % 8).cast("int")).alias("by"), F.get(kinds, (F.col("l_suppkey") % 8).cast("int")).alias("target"))
    return k.groupBy("by", "target", T.legal_rank(F.col("by")).alias("rank"), T.may_amend(F.col("by"), F.col("target")).alias("may")).agg(F.count("*").alias("n"))


@query("""with l as (select l_linenumber as n, cast(l_quantity as int) as q, l_partkey % 4 as k from lineitem),
 p as (select case k when 0 then 'art' || n || '.alin' || q || '.lita' when 1 then 'art' || q || '^' || n when 2 then 'art' || n || '.pct' || q end as locator from l)
 select locator, case when locator is null then 'ro:lege-1' else 'ro:lege-1#' || locator end as provision, count(*) as n from p group by all""")
def text_canonical_locator(t):
    d = t("lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    k = F.col("l_partkey") % 4
    said = F.when(k == 0, spelt("art. {l_linenumber} alin. ({q}) lit. a)")).when(k == 1, spelt("ART{q}^{l_linenumber}")).when(k == 2, spelt(" Articolul {l_linenumber}, punctul {q}")).otherwise(spelt("art. {l_linenumber} și art. {q}"))
    loc = T.canonical_locator(said)
    return d.select(loc.alias("locator")).groupBy("locator", T.provision_key(F.lit("lege-1"), F.col("locator")).alias("provision")).agg(F.count("*").alias("n"))


_A, _B = (f"2 * len(regexp_extract_all(lower(p_name), '{w}')) + len(regexp_extract_all(lower(p_type), '{w}'))" for w in (r"\b(cold|small|economy)\b", r"\b(widget|large|standard|promo)\b"))


@query(f"""with s as (select p_partkey, {_A} as a, {_B} as b from part)
 select p_partkey, case when a = 0 and b = 0 then 'altele' when a >= b then 'first' else 'second' end as domain from s""")
def text_domain_class(t):
    return t("part").select("p_partkey", T.keyword_class([(F.col("p_name"), 2), (F.col("p_type"), 1)], [("first", ["cold", "small", "economy"]), ("second", ["widget", "large", "standard", "promo"])], "altele").alias("domain"))


@query("""select coalesce(case event_type when 'signup' then 'comisie' when 'error' then 'vot' when 'purchase' then 'unavailable' end, 'unknown') as stage, count(*) as n from events group by 1""")
def text_stage_of_phrase(t):
    e = F.col("event_type")
    said = F.when(e == "signup", "Trimis la COMISIE pentru raport, apoi vot final").when(e == "error", "Pe ordinea de zi:  Vot  FINAL").when(e == "purchase", "  ").otherwise(F.concat(F.lit("altceva "), e))
    return t("events").select(T.first_containing(said, [("comisie", "comisie"), ("vot final", "vot")], "unknown", "unavailable").alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


@query("""select o_orderkey, case o_orderkey % 4 when 3 then null else cast(cast(o_orderdate as date) as varchar) end as iso, case o_orderstatus when 'F' then 'closed' when 'O' then 'open' else 'announced' end as status,
 case o_orderkey % 3 when 2 then null else '3' || year(o_orderdate) || 'L' || lpad(cast(o_orderkey % 10000 as varchar), 4, '0') end as celex from orders""")
def source_normalisers(t):
    o = t("orders").withColumn("day", F.col("o_orderdate").cast("date"))
    k = F.col("o_orderkey")
    said = F.when(k % 4 == 0, F.date_format("day", "d.M.yyyy")).when(k % 4 == 1, F.date_format("day", " dd/MM/yyyy ")).when(k % 4 == 2, F.date_format("day", "yyyy-MM-dd")).otherwise(F.date_format("day", "MMMM yyyy"))
    state = F.when(F.col("o_orderstatus") == "F", "Închis la termen").when(F.col("o_orderstatus") == "O", "În consultare publică").otherwise("Anunțat")
    celex = F.concat(F.lit("3"), F.year("day").cast("string"), F.lit("l"), F.lpad((k % 10000).cast("string"), 4, "0"))
    return o.select("o_orderkey", files.iso_date(said).alias("iso"), files.consultation_status(state).alias("status"), files.celex_id(F.when(k % 3 == 0, F.concat(F.lit(" "), celex, F.lit("/ "))).when(k % 3 == 1, F.concat(F.lit("https://x/celex/"), celex, F.lit("?a=1"))).otherwise("?!")).alias("celex"))


@query("""with m as (select l_orderkey, ['ro', 'en', 'fr'][l_suppkey % 3 + 1] as language, ['html', 'pdf', 'exe'][l_linenumber % 3 + 1] as format, 'u' || l_partkey || case when l_returnflag = 'R' then '/DOC_1' else '' end as url from lineitem),
 r as (select *, row_number() over (partition by l_orderkey order by case language when 'ro' then 1 when 'en' then 2 else 3 end, case format when 'html' then 1 else 2 end, not ends_with(url, 'DOC_1'), url) as k from m where format <> 'exe')
 select 'c' || l_orderkey as celex, language, format, url from r where k = 1""")
def source_manifestation_pick(t):
    of = lambda values, c: F.get(F.array(*map(F.lit, values)), (F.col(c) % 3).cast("int"))
    m = t("lineitem").select(F.concat(F.lit("c"), "l_orderkey").alias("celex"), of(("ro", "en", "fr"), "l_suppkey").alias("language"), of(("html", "pdf", "exe"), "l_linenumber").alias("format"), F.concat(F.lit("u"), F.col("l_partkey"), F.when(F.col("l_returnflag") == "R", "/DOC_1").otherwise("")).alias("url"))
    return files.pick_manifestation(m, ["ro", "en"], ["html", "pdf"])
