"""Similarity of drafts with norms: fingerprints, containment, token overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: So many of a norm's rarest grams must be met beyond the ones that a unit may lack.
HITS = 10
#: Up to so many grams of norms go to every task; more are joined by a shuffle of both sides.
FEW = 2_000_000


def flattened(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def fingerprint(c: Column, n: int = 5) -> Column:
    """Distinct character n-grams of the flattened text."""
    return flat_grams(flattened(c), n)


def flat_grams(c: Column, n: int = 5) -> Column:
    """Distinct character n-grams of a flattened text, which is made once for all of them."""

    def grams(flat: Column) -> Column:
        # a lookahead finds them all in one pass; it steps by UTF-16 units, so that pairs of those are cut place by place
        placed = F.transform(F.sequence(F.lit(1), F.length(flat) - n + 1), lambda i: F.substring(flat, i, n))
        every = F.when(F.rlike(flat, F.lit(r"[\x{10000}-\x{10FFFF}]")), placed).otherwise(F.regexp_extract_all(flat, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
        return F.when(F.length(flat) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(c), grams), 1)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def quote_gate(quotes: DataFrame, contexts: DataFrame, least: int = 60) -> DataFrame:
    """quotes(quote, text) with the first reason against each: empty, short, absent, repeated, else ok.

    A quote stands in a context(context, text) if this contains it. Candidates meet on that inner token of the quote which
    the fewest contexts have (every context of the quote has it whole), in an equi join; the text decides after it. Quotes
    of less than three tokens are short anyway, or (of one endless token) compared with every context.
    """
    tokens = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))
    inner = F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))
    long = quotes.select("quote", "text", F.array_distinct(inner).alias("tokens")).where(F.length("text") >= least)
    c = contexts.select("context", F.col("text").alias("whole"))
    asked = long.select("quote", F.explode("tokens").alias("token"))
    posted = c.select("context", F.explode(F.array_distinct(F.regexp_extract_all("whole", F.lit("[A-Za-z0-9]+"), F.lit(0)))).alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    often = posted.groupBy("token").agg(F.count("*").alias("n"))
    pick = asked.join(often, "token", "left").groupBy("quote").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("p")).select("quote", F.col("p.token").alias("token"))
    long = long.select("quote", "text").join(pick, "quote", "left")
    near = long.where("token is not null").join(posted, "token").join(c, "context").where(F.contains("whole", F.col("text"))).select("quote", "context")
    odd = long.where("token is null").join(c, F.contains("whole", F.col("text"))).select("quote", "context")
    n = near.unionAll(odd).groupBy("quote").agg(F.count("*").alias("n"))
    found = F.coalesce("n", F.lit(0))
    verdict = F.when(F.length("text") == 0, "empty").when(F.length("text") < least, "short").when(found == 0, "absent").when(found > 1, "repeated").otherwise("ok")
    return quotes.join(n, "quote", "left").select("quote", verdict.alias("verdict"))


def symmetric(units: DataFrame, norms: DataFrame, n: int = 5) -> DataFrame:
    """(unit, norm, jaccard) of the fingerprints of given pairs(unit, text) x (norm, text), joined by a common key column."""
    u = units.select("key", "unit", fingerprint(F.col("text"), n).alias("g"))
    b = norms.select("key", "norm", fingerprint(F.col("text"), n).alias("h"))
    return u.join(b, "key").select("unit", "norm", F.round(jaccard(F.col("g"), F.col("h")), 6).alias("jaccard"))


def re_enactments(units: DataFrame, norms: DataFrame, contained: float = 0.8, words: int = 15, ratio: int = 3) -> DataFrame:
    """(unit, norm, part): norms whose fingerprint a unit contains.

    units(unit, text) and norms(norm, text) need at least `words` words; a unit may have up to `ratio` times the norm's
    grams. A unit that holds that part of a norm's n grams lacks at most n - least of them, so that it holds HITS of any
    n - least + HITS: only the rarest so many, by their number of units, are joined and counted. What has enough hits is
    decided on the whole fingerprints.
    """
    enough = F.size(F.split("flat", " ")) >= words
    flat = units.select("unit", flattened(F.col("text")).alias("flat")).where(enough).repartition("unit")  # long texts may lie together
    u = flat.select("unit", F.explode(F.array(flat_grams(F.col("flat")))).alias("g")).withColumn("n_u", F.size("g"))
    b = norms.select("norm", flattened(F.col("text")).alias("flat")).where(enough).select("norm", F.explode(F.array(flat_grams(F.col("flat")))).alias("h")).withColumn("n_b", F.size("h"))
    ends = b.agg(F.min("n_b").alias("lo"), F.max("n_b").alias("hi"))  # one row: a unit of fewer grams than any norm needs can contain none
    u = u.crossJoin(F.broadcast(ends)).where((F.col("n_u") >= contained * F.col("lo")) & (F.col("n_u") <= ratio * F.col("hi"))).drop("lo", "hi")
    grams = b.select("norm", "n_b", F.explode("h").alias("gram"))
    near = F.broadcast if b.agg(F.coalesce(F.sum("n_b"), F.lit(0))).first()[0] <= FEW else (lambda d: d)
    posted = u.select("unit", "n_u", F.explode("g").alias("gram"))
    often = posted.join(near(grams.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("units"))
    at = F.row_number().over(Window.partitionBy("norm").orderBy(F.coalesce("units", F.lit(0)), "gram"))  # grams that no unit has are the rarest
    least = F.ceil(F.col("n_b") * (contained - 5e-7)).cast("int")  # what rounds to `contained`
    rarest = grams.join(often, "gram", "left").withColumn("at", at).withColumn("least", least).where(F.col("at") <= F.col("n_b") - F.col("least") + HITS)
    hit = posted.join(near(rarest.select("norm", "n_b", "least", "gram")), "gram").where((F.col("n_u") <= ratio * F.col("n_b")) & (F.col("n_u") >= (contained - 5e-7) * F.col("n_b")))
    met = hit.groupBy("unit", "norm", "least").agg(F.count("*").alias("hits")).where(F.col("hits") >= F.least("least", F.lit(HITS))).select("unit", "norm")
    both = flat.join(met, "unit").select("unit", "norm", flat_grams(F.col("flat")).alias("g")).join(b, "norm").select("unit", "norm", F.round(F.size(F.array_intersect("g", "h")) / F.col("n_b"), 6).alias("part"))
    return both.where(F.col("part") >= contained)
