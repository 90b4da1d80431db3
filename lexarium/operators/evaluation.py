"""Measuring extractors, sources and model output against what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import romanian_key


def scores(expected: DataFrame, found: DataFrame, by: str, item: str) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) of distinct items by field; an empty denominator counts as 1."""
    keys = [by, "case", item]
    x = expected.select(*keys).distinct().withColumn("e", F.lit(1)).join(found.select(*keys).distinct().withColumn("g", F.lit(1)), keys, "full")
    x = x.groupBy(by).agg(F.count_if(F.col("e").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("g").isNull()).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.try_divide("tp", F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.try_divide("tp", F.col("tp") + F.col("fn")))
    return x.select(by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(F.try_divide(2 * p * r, p + r)).alias("f1"))


def sampled(df: DataFrame, key: str, n: int = 120) -> DataFrame:
    """The n rows of the smallest key hashes: the same rows on every run."""
    return df.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(n)


def set_fingerprint(df: DataFrame, by: str, key: str, text: str) -> DataFrame:
    """(by, fingerprint): one hash of each group's (key, text) pairs, whatever their order; rows are hashed before they meet."""
    row = F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), F.col(text)), 256)
    return df.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ""), 256).alias("fingerprint"))


def judged_precision(df: DataFrame, by: str, verdict: str) -> DataFrame:
    """correct / (correct + wrong) of verdicts correct, wrong or else; null where none is judged."""
    good, bad = F.count_if(F.col(verdict) == "correct"), F.count_if(F.col(verdict) == "wrong")
    return df.groupBy(by).agg(good.alias("correct"), bad.alias("wrong"), F.try_divide(good, good + bad).alias("precision"))


def mark_recall(marks: DataFrame, found: DataFrame) -> DataFrame:
    """Share of marks(page, mark) that some found(page, text) of the page holds or is held by, folded."""
    m = marks.select("page", romanian_key(F.col("mark")).alias("m")).distinct()
    f = found.select(F.col("page").alias("_p"), romanian_key(F.col("text")).alias("f"))
    hit = m.join(f, (m["page"] == f["_p"]) & (F.contains("f", F.col("m")) | F.contains("m", F.col("f"))), "left_semi")
    return m.agg(F.count("*").alias("marks")).crossJoin(hit.agg(F.count("*").alias("found"))).withColumn("recall", F.try_divide("found", "marks"))  # one row each


def content_words(c: Column, least: int = 4) -> Column:
    return F.array_distinct(F.regexp_extract_all(romanian_key(c), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0)))


def faithfulness(claims: DataFrame, sources: DataFrame, shared: int = 2) -> DataFrame:
    """(case, claims, supported, share): claims(case, claim) with at least `shared` content words of one of the case's sources(case, text)."""
    c = claims.select("case", "claim", content_words(F.col("claim")).alias("w"))
    s = sources.select(F.col("case").alias("_c"), content_words(F.col("text")).alias("s"))
    x = c.join(s, c["case"] == s["_c"], "left").withColumn("ok", F.coalesce(F.size(F.array_intersect("w", "s")) >= shared, F.lit(False)))
    x = x.groupBy("case", "claim").agg(F.max("ok").alias("ok"))
    return x.groupBy("case").agg(F.count("*").alias("claims"), F.count_if("ok").alias("supported"), (F.count_if("ok") / F.count("*")).alias("share"))


def citation_score(cited: Column, allowed: Column, required: Column) -> Column:
    """0.65 * share of the citations that are allowed + 0.35 * share of the required ones that are cited; none required: 1."""
    valid = F.when(F.size(cited) == 0, 0.0).otherwise(F.try_divide(F.size(F.array_intersect(cited, allowed)), F.size(cited)))
    covered = F.when(F.size(required) == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(cited, required)), F.size(required)))
    return F.round(0.65 * valid + 0.35 * covered, 6)


#: Words by which a sentence sounds legal.
LEGAL = ("lege", "articol", "art.", "alin.", "ordonanta", "hotarare", "obligat", "interzis", "termen")


def claim_support(sentences: DataFrame, text: str = "sentence", approved: str = "approved") -> DataFrame:
    """sentences with support: blocked (a source [n] beyond the approved list), cited, uncited (sounds legal), plain."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    key = romanian_key(F.col(text))
    legal = F.lit(False)
    for w in LEGAL:
        legal = legal | F.contains(key, F.lit(w))
    return sentences.withColumn("support", F.when(F.size(F.array_except(n, F.col(approved))) > 0, "blocked").when(F.size(n) > 0, "cited").when(legal, "uncited").otherwise("plain"))


def guardrail(support: DataFrame, by: str) -> DataFrame:
    """(by, verdict): blocked if any sentence is, needs_review if any legal one has no source, else ok."""
    return support.groupBy(by).agg(F.when(F.count_if(F.col("support") == "blocked") > 0, "blocked").when(F.count_if(F.col("support") == "uncited") > 0, "needs_review").otherwise("ok").alias("verdict"))


def run_scores(cases: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(provider, model, task, cases, mean, acceptable): a task is acceptable only if each of its cases passes."""
    return cases.groupBy("provider", "model", "task").agg(F.count("*").alias("cases"), F.round(F.avg("score"), 6).alias("mean"), (F.min("score") >= threshold).alias("acceptable"))


def freshness(enabled: Column, failed: Column, reviewed: Column, checked: Column, today: Column, days: int = 30) -> Column:
    """Six states of a source: unavailable, needs_review, missing, unknown, stale, current."""
    age = F.datediff(today, F.to_date(checked))
    return F.when(~F.coalesce(enabled, F.lit(False)), "unavailable").when(F.coalesce(failed, F.lit(False)) & ~F.coalesce(reviewed, F.lit(False)), "needs_review").when(checked.isNull(), "missing").when(age.isNull() | (age < 0), "unknown").when(age > days, "stale").otherwise("current")


#: States of a group, the worst first.
WORST = ("unavailable", "needs_review", "partial", "missing", "unknown", "stale", "current")


def group_freshness(rows: DataFrame, by: str, state: str = "state") -> DataFrame:
    """(by, state): the worst state of each group's sources."""
    order = F.array(*map(F.lit, WORST))
    return rows.groupBy(by).agg(F.element_at(order, F.min(F.array_position(order, F.col(state))).cast("int")).alias("state"))


def storage(rows: DataFrame, by: str, low: str, high: str, price: float) -> DataFrame:
    """(by, low_gb, high_gb, cost): sums in decimals, half up."""
    d = lambda c: F.sum(F.col(c).cast("decimal(18,3)"))
    return rows.groupBy(by).agg(F.round(d(low), 2).alias("low_gb"), F.round(d(high), 2).alias("high_gb"), F.round(d(high) * F.lit(price).cast("decimal(9,4)"), 2).alias("cost"))

