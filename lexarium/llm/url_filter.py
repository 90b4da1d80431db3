"""URL filters: domain rules first, then gradient-boosted trees on lexical features.

A rule is a host and the beginning of a path (`example.net/en/`): it fits its host and all subdomains, and the longest
fitting rule decides. Every other URL goes to a model: gradient-boosted trees (Spark ML) over lengths, depth, shares of
digits and punctuation, entropy, parameters and suffix statistics, learnt from labelled URLs. Everything stays in the
JVM.

Suffix statistics are counted over all rows: how many URLs share the host's last label and its last two, and which share
of them is labelled to block (smoothed; an example never counts its own label). They are combined before they move, and
reach the URLs in a join in which the suffixes of a thousandth of the rows or more (at most a thousand of them) are
broadcast and only the others are shuffled, so a hot host gathers nowhere.

Defined results: a null URL, or one without ://, has an empty host and path, which no rule fits, and is judged by the model
like any other; repeated rows are judged alike (examples are distinct URLs); without examples of both labels the verdict is
that of the only one, allow if there is none, and the score 0.5; all other
columns stay, and outputs replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

#: Labelled URLs that the trees learn from at most (chosen by hash), trees, their depth, and the weight of the prior in shares.
EXAMPLES, TREES, DEPTH, PRIOR = 200_000, 20, 3, 20.0
#: A suffix of this share of the rows is hot, so that at most its inverse are.
HOT = 0.001
_LEXICAL = ("length", "host_length", "path_length", "labels", "host_digits", "hyphens", "depth", "digits", "punctuation", "entropy", "parameters", "query_length", "extension", "secure", "port", "escapes")
_SUFFIX = ("top_n", "top_rate", "domain_n", "domain_rate")
FEATURES = (*_LEXICAL, *_SUFFIX)
_OUT = ("_lx_host", "_lx_path", "_lx_rule", "_lx_verdict", "_lx_score")


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting (rule, verdict), equally long ones by text; null if none fits.

    rules: (`host/path`, allow or block). They are tested one by one, which suits lists of thousands.
    """
    every = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path")) for r, v in sorted(rules, key=lambda x: (-len(x[0]), x))]
    if not every:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    fits = lambda x: ((host == x["host"]) | F.endswith(host, F.concat(F.lit("."), x["host"]))) & F.startswith(path, x["path"])
    return F.get(F.filter(F.array(*every), fits), F.lit(0))


def entropy(c: Column) -> Column:
    """Bits a character of the text's own distribution."""
    n = F.length(c).cast("double")

    def bits(total: Column, x: Column) -> Column:
        share = (n - F.length(F.replace(c, x, F.lit("")))) / n
        return total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)

    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(c, "")), F.lit(0.0), lambda t, x: F.when(x == "", t).otherwise(bits(t, x)))).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return {
        "length": F.length(u).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"), "labels": count(host, r"\.") + 1,
        "host_digits": count(host, "[0-9]") / F.greatest(F.length(host), F.lit(1)), "hyphens": count(host, "-"), "depth": count(path, "/[^/]"), "digits": count(u, "[0-9]") / n, "punctuation": count(u, "[^A-Za-z0-9]") / n,
        "entropy": entropy(u), "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "query_length": F.length(query).cast("double"),
        "extension": F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)).cast("double"), "secure": F.startswith(lower_ascii(u), F.lit("https")).cast("double"), "port": F.regexp_like(host, F.lit(":[0-9]+$")).cast("double"), "escapes": count(u, "%[0-9A-Fa-f]{2}"),
    }


def _rated(counts: DataFrame, prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}_{c}") for c in ("n", "labelled", "blocked")]


def suffix_counts(rows: DataFrame) -> DataFrame:
    """(domain, top_n, top_labelled, top_blocked, domain_n, ..) of rows(domain, top, label): one row a domain."""
    by = lambda d, *keys: d.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    own = by(rows.select("domain", "top", F.lit(1).alias("n"), F.col("label").isNotNull().cast("long").alias("labelled"), F.coalesce("label", F.lit(0)).cast("long").alias("blocked")), "domain", "top")
    tops = by(own, "top").select("top", *_rated(own, "top"))
    return own.select("domain", "top", *_rated(own, "domain")).join(tops, "top").drop("top")


def with_suffixes(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows(domain, url, ..) joined with counts: the hot domains broadcast (at most 1 / HOT), the others by a shuffle."""
    total = counts.agg(F.sum("domain_n").alias("total")).first()["total"] or 0
    columns = [c for c in counts.columns if c != "domain"]
    is_hot = F.col("domain_n") >= max(HOT * total, 1)
    hot = counts.where(is_hot).select("domain", F.lit(True).alias("hot"), *(F.col(k).alias(f"h_{k}") for k in columns))
    x = rows.join(F.broadcast(hot), "domain", "left")
    # what has met a hot one is dealt out by its own hash, so that it meets nothing more and gathers nowhere
    x = x.withColumn("key", F.when(F.col("hot").isNull(), F.concat(F.lit("d"), F.col("domain"))).otherwise(F.concat(F.lit("m"), F.xxhash64("url", "row").cast("string"))))
    x = x.join(counts.where(~is_hot).select(F.concat(F.lit("d"), "domain").alias("key"), *(F.col(k).alias(f"c_{k}") for k in columns)), "key", "left")
    return x.select(*rows.columns, *(F.coalesce(f"h_{k}", f"c_{k}", F.lit(0)).alias(k) for k in columns))


def featured(urls: DataFrame) -> DataFrame:
    """urls(url, host, path, label, ..) with a column f_<feature> each; label is 1 (block), 0 or null."""
    rows = urls.withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0))
    counts = written(suffix_counts(rows.withColumn("top", F.regexp_extract("host", r"[^.]*$", 0))), "suffixes")
    x = with_suffixes(rows, counts)
    y = F.col("label")
    mine = y.isNotNull().cast("long")
    rate = lambda p: (F.col(f"{p}_blocked") - F.coalesce(y, F.lit(0)) + PRIOR / 2) / (F.col(f"{p}_labelled") - mine + PRIOR)
    own = {"top_n": F.log1p("top_n"), "top_rate": rate("top"), "domain_n": F.log1p("domain_n"), "domain_rate": rate("domain")}
    every = lexical(F.col("url"), F.col("host"), F.col("path")) | own
    return x.select(*urls.columns, *(every[k].alias(f"f_{k}") for k in FEATURES))


def fit(urls: DataFrame, most: int = EXAMPLES) -> GBTClassificationModel | float:
    """Trees from featured urls with a label; a constant score where there are not both labels.

    Of more than `most` examples, those of the lowest hashes of their URL are used.
    """
    e = urls.where("label is not null")
    n = e.groupBy("label").count().collect()
    if len(n) < 2:
        return 0.5
    total = sum(r["count"] for r in n)
    if total > most:
        e = e.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int((1 << 30) * most / total))
    e = e.dropDuplicates(["url"]).select(F.col("label").cast("double").alias("label"), *(f"f_{k}" for k in FEATURES))
    v = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(e).select("label", "features")
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(v)


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", label: Column | None = None) -> DataFrame:
    """pages with _lx_host, _lx_path, _lx_rule, _lx_verdict and _lx_score (0 to 1, higher: blocked likelier).

    label: 1 (block), 0 (allow) or null, a column over pages; without it, the rules' own verdicts are what is learnt from.
    """
    own = [c for c in pages.columns if c.lower() not in _OUT]
    ruled = F.when(F.col("fit.verdict") == "block", 1).when(F.col("fit.verdict") == "allow", 0)
    p = pages.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(url).alias("url"), (F.lit(None) if label is None else label).cast("int").alias("said"))
    p = p.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    f = written(featured(p.withColumn("label", ruled if label is None else F.col("said"))), "urls")
    model = fit(f)
    if isinstance(model, float):
        only = f.where("label is not null").select("label").first()
        scored = f.withColumn("score", F.lit(model))
        guess = F.lit("block" if only and only[0] else "allow")
    else:
        v = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(f)
        scored = model.setFeaturesCol("features").transform(v).withColumn("score", vector_to_array("probability")[1])
        guess = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("row.*", F.col("host").alias("_lx_host"), F.col("path").alias("_lx_path"), F.col("fit.rule").alias("_lx_rule"), F.coalesce("fit.verdict", guess).alias("_lx_verdict"), F.col("score").alias("_lx_score"))
