"""Full-text search over an inverted index: postings, BM25, coverage ranking, prefixes, snippets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MARKED, PLAIN, fold_key
from .postings import term_counts


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, doc, tf) of [a-z0-9]{3,} tokens of the folded text; the only shuffle combines counts before it moves them."""
    words = F.explode(F.regexp_extract_all(fold_key(F.col(text_col)), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    return docs.select(F.col(id_col).alias("doc"), words.alias("token")).groupBy("token", "doc").agg(F.count("*").alias("tf"))


def words_of(query: str) -> list[str]:
    """Distinct query terms as tokens are written, first said first."""
    return list(dict.fromkeys(re.findall("[a-z0-9]{3,}", query.lower().translate(str.maketrans(MARKED, PLAIN)))))


def _once(docs: DataFrame, id_col: str, text_col: str, words) -> DataFrame:
    """(doc, w): words of each text. The generator keeps the optimizer from evaluating them again for each use."""
    return docs.select(F.col(id_col).alias("doc"), F.explode(F.array(words(F.col(text_col)))).alias("w"))


def _all_words(c):
    """The words of fold_key(c), whose runs of white space don't matter to them."""
    return F.regexp_extract_all(F.translate(F.lower(c), MARKED, PLAIN), F.lit("[a-z0-9]{3,}"), F.lit(0))


def _stated(docs: DataFrame, equal: dict | None, at_least: dict | None, at_most: dict | None) -> DataFrame:
    """docs under optional conditions; they are tested before any text is read."""
    for conditions, test in ((equal, "="), (at_least, ">="), (at_most, "<=")):
        for c, v in (conditions or {}).items():
            docs = docs.where({"=": F.col(c) == v, ">=": F.col(c) >= v, "<=": F.col(c) <= v}[test])
    return docs


def coverage_search(docs: DataFrame, terms: list[str], limit: int = 25, id_col: str = "doc_id", text_col: str = "text", equal: dict | None = None, at_least: dict | None = None, at_most: dict | None = None) -> DataFrame:
    """(doc, score): documents by the number of different query terms they have, ties by id."""
    wanted = F.array(*map(F.lit, terms))
    h = _once(_stated(docs, equal, at_least, at_most), id_col, text_col, lambda c: F.array_intersect(wanted, _all_words(c)))
    return h.select("doc", F.size("w").cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "doc").limit(limit)


def bm25_search(docs: DataFrame, terms: list[str], limit: int = 20, offset: int = 0, k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text", equal: dict | None = None, at_least: dict | None = None, at_most: dict | None = None) -> DataFrame:
    """(doc, score): BM25 over the documents, ties by id.

    One pass over the texts leaves length and term counts; the corpus statistics are one row that is joined, so nothing
    runs while the plan is made.
    """
    own = _once(_stated(docs, equal, at_least, at_most), id_col, text_col, _all_words)
    wanted = [_times(t).alias(f"t{i}") for i, t in enumerate(terms)]
    h = own.select("doc", F.size("w").alias("len"), *wanted)
    return ranked(h, len(terms), k1, b).orderBy(F.desc("score"), "doc").offset(offset).limit(limit)


def _times(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == term))


def ranked(h: DataFrame, n_terms: int, k1: float = 1.2, b: float = 0.75, stats: DataFrame | None = None) -> DataFrame:
    """(doc, score) from h(doc, len, t0, t1, ..), of documents that have any term."""
    s = stats if stats is not None else h.agg(F.count("*").alias("_n"), F.avg("len").alias("_mean"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"_d{i}") for i in range(n_terms)))
    x = h.where(F.greatest(*(F.col(f"t{i}") for i in range(n_terms)), F.lit(0)) > 0).crossJoin(F.broadcast(s))  # one row
    score = F.lit(0.0)
    for i in range(n_terms):
        idf = F.log(F.lit(1.0) + (F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        tf = F.col(f"t{i}").cast("double")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("_mean")))
    return x.select("doc", F.round(score, 6).alias("score"))


# ------------------------------------------------------------------ an index that is written once
def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), cut: float | None = None) -> None:
    """Write postings in ranges of tokens, document lengths with the columns `keep`, and one row of statistics.

    cut: tokens of more than this share of the documents get no postings. Files hold ranges of sorted tokens, so that a
    reader skips all others by their statistics. For an index that changes see segments.
    """
    spark, words = docs.sparkSession, f"{path}/words"
    docs.select(F.col(id_col).alias("doc"), *keep, F.explode(F.array(_all_words(F.col(text_col)))).alias("words")).write.mode("overwrite").parquet(words)
    texts = spark.read.parquet(words)
    texts.select("doc", *keep, F.size("words").alias("len")).write.mode("overwrite").parquet(f"{path}/docs")
    lengths = spark.read.parquet(f"{path}/docs")
    lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    term_counts(texts).write.mode("overwrite").parquet(f"{path}/counts")  # counted once, though the ranges are sought first
    # equal (token, doc), of documents that share an id, lie in one range
    p = spark.read.parquet(f"{path}/counts").repartitionByRange("token", "doc").groupBy("token", "doc").agg(F.sum("tf").alias("tf"))
    if cut is not None:
        n = spark.read.parquet(f"{path}/stats").first()["n"]
        p = p.join(p.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > cut * n).select("token"), "token", "left_anti").repartitionByRange("token", "doc")
    p.sortWithinPartitions("token", "doc").write.mode("overwrite").parquet(f"{path}/postings")
    for made in (words, f"{path}/counts"):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def indexed_postings(spark: SparkSession, path: str, terms: list[str], prefixes: bool = False) -> DataFrame:
    """Postings of the terms, or of all tokens that begin with them (three characters or more); other ranges aren't read."""
    p = spark.read.parquet(f"{path}/postings")
    if not prefixes:
        return p.where(F.col("token").isin(*terms)).select("token", "doc", "tf", F.col("token").alias("term"))
    least = [t for t in terms if len(t) >= 3]
    p = p.where(reduce(lambda a, b: a | b, (F.startswith("token", F.lit(t)) for t in least), F.lit(False)))
    begins = F.filter(F.array(*map(F.lit, least)).cast("array<string>"), lambda t: F.startswith(F.col("token"), t))
    return p.select("token", "doc", "tf", F.explode(begins).alias("term"))


def indexed_search(spark: SparkSession, path: str, terms: list[str], limit: int = 20, offset: int = 0, equal: dict | None = None, at_least: dict | None = None, at_most: dict | None = None, bm25: bool = True, prefixes: bool = False) -> DataFrame:
    """(doc, score, kept columns): top documents from a written index by BM25 or by number of terms; rank first, then join
    what else is known of the documents."""
    docs = _stated(spark.read.parquet(f"{path}/docs"), equal, at_least, at_most)
    hits = indexed_postings(spark, path, terms, prefixes).groupBy("doc", "term").agg(F.sum("tf").alias("tf"))
    t = [F.coalesce(F.sum(F.when(F.col("term") == x, F.col("tf"))), F.lit(0)).alias(f"t{i}") for i, x in enumerate(terms)]
    h = hits.groupBy("doc").agg(*t).join(docs, "doc")
    if not bm25:
        score = sum(((F.col(f"t{i}") > 0).cast("long") for i in range(len(terms))), F.lit(0).cast("long"))
        return h.withColumn("score", score).orderBy(F.desc("score"), "doc").offset(offset).limit(limit).select("doc", "score", *(c for c in docs.columns if c not in ("doc", "len")))
    if equal or at_least or at_most:
        whole = docs.agg(F.count("*").alias("_n"), F.avg("len").alias("_mean"))
    else:
        whole = spark.read.parquet(f"{path}/stats").select(F.col("n").alias("_n"), F.col("mean").alias("_mean"))
    df = h.agg(*(F.count_if(F.col(f"t{i}") > 0).alias(f"_d{i}") for i in range(len(terms))))
    top = ranked(h.select("doc", "len", *(f"t{i}" for i in range(len(terms)))), len(terms), stats=whole.crossJoin(df)).orderBy(F.desc("score"), "doc").offset(offset).limit(limit)  # one row each
    return top.join(docs.drop("len"), "doc")


def title_ranking(hits: DataFrame, acts: DataFrame, limit: int) -> DataFrame:
    """hits(act, title_hits, body_hits) with acts(act, rank, citations, title): title hits, legal rank, citations, short
    titles, body hits, id."""
    x = hits.join(acts, "act")
    return x.orderBy(F.desc("title_hits"), "rank", F.desc("citations"), F.length("title"), F.desc("body_hits"), "act").limit(limit)


def merged_hits(exact: DataFrame, textual: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Exact hits before textual ones, each key once."""
    x = exact.select(*keys, F.lit(0).alias("tier"), "score").unionByName(textual.select(*keys, F.lit(1).alias("tier"), "score"))
    return x.groupBy(*keys).agg(F.min(F.struct("tier", (-F.col("score")).alias("s"))).alias("o")).select(*keys, "o.tier", (-F.col("o.s")).alias("score")).orderBy("tier", F.desc("score"), *keys).limit(limit)


def prefix_shards(frequencies: DataFrame, n_docs: int, cut: float = 0.4) -> DataFrame:
    """frequencies(token, n): tokens and postings by three-character prefix, without tokens of more than `cut` of the documents."""
    tokens = frequencies.where(F.col("n") <= cut * n_docs)
    return tokens.groupBy(F.substring("token", 1, 3).alias("prefix")).agg(F.count("*").alias("n_tokens"), F.sum("n").alias("n_postings"))
