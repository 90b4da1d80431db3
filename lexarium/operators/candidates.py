"""Top-k join: the k best documents for each row of a table of drafts, all drafts at once, over a segmented index.

A draft and a document score the weights of the tokens they share, floor(1000 * ln(N / df)); tokens of more than a share
`cut` of the documents weigh nothing and are never joined. Each draft's tokens are ordered from the rarest on. Those that
hold the first half of its weight are joined with the index; the k-th best sum so found is a lower bound of what a result
scores. Tokens whose weights, with those of all more frequent ones, stay below it can't bring in a document that has none
of the rarer tokens, so they are not joined either: only documents that their found sum and the left-out weights can lift
to the bound are looked at, and their whole score is taken from their tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.commits import State
from .search import _all_words
from .segments import NAMED, SegmentedIndex

#: Groups in which a draft's documents are ranked before all of them are.
SALT = 32


def weights(index: SegmentedIndex, cut: float, tokens: DataFrame | None = None) -> DataFrame:
    """(token, w) of the tokens, or of these(token), that weigh something."""
    n, _ = index.sizes(index.commits.latest())
    return index.frequencies(terms=tokens).where(F.col("n") <= cut * n).select("token", F.floor(1000 * F.log(F.lit(float(n)) / F.col("n"))).alias("w")).where("w > 0")


def _few(rows: DataFrame) -> DataFrame:
    """rows, which go to every task if they are at most NAMED."""
    return F.broadcast(rows) if rows.count() <= NAMED else rows


def best(rows: DataFrame, k: int, by: str, order: list[Column]) -> DataFrame:
    """The k first rows of each group, with their rank; ranked in salted parts first, each of which keeps k before it moves."""
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALT))
    top = lambda d, *keys: d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return top(top(rows.withColumn("_salt", salt), by, "_salt").drop("_salt"), by)


def candidates(index: SegmentedIndex, drafts: DataFrame, k: int = 10, cut: float = 0.1, id_col: str = "draft", text_col: str = "text") -> DataFrame:
    """(draft, rank, doc, score): each draft's k best documents of score above 0, ties by document. Drafts' ids are unique."""
    q = drafts.select(F.col(id_col).alias("draft"), F.explode(F.array_distinct(_all_words(F.coalesce(F.col(text_col), F.lit(""))))).alias("token"))
    kept_as = lambda name, d: index.commits.read(State(tables={name: [index.commits.stage(name, d)]}), name)
    q = kept_as("asked", q)
    q = kept_as("weighed", q.join(weights(index, cut, _few(q.select("token").distinct())), "token"))
    by = Window.partitionBy("draft")
    rarest = by.orderBy(F.desc("w"), "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # after: the weight of this token and of all more frequent ones
    q = q.withColumn("all", F.sum("w").over(by)).withColumn("after", F.col("all") - F.sum("w").over(rarest) + F.col("w"))
    state = index.commits.latest()
    blocks = index.commits.read(state, "blocks").select("segment", "token", F.col("postings.doc").alias("docs"))

    def found(tokens: DataFrame) -> DataFrame:
        # blocks of other tokens are left out before anything is moved
        own = blocks.join(_few(tokens.select("token").distinct()), "token", "left_semi")
        hit = own.join(_few(tokens), "token").select("draft", "segment", F.explode("docs").alias("doc"), "w")
        return index._without_dead(hit.groupBy("draft", "segment", "doc").agg(F.sum("w").alias("sum")), state)

    first = found(q.where(2 * F.col("after") > F.col("all")).select("draft", "token", "w"))
    least = best(first, k, "draft", [F.desc("sum"), F.asc("doc")]).where(F.col("rank") == k).select("draft", F.col("sum").alias("least"))
    least = kept_as("least", least)
    q = q.join(least, "draft", "left").fillna(0, ["least"])
    kept = found(q.where(F.col("after") >= F.col("least")).select("draft", "token", "w"))
    left = q.where(F.col("after") < F.col("least")).groupBy("draft").agg(F.sum("w").alias("left"), F.collect_list(F.struct("token", "w")).alias("rest"))
    left = kept_as("left", left)
    may = kept.join(left.select("draft", "left"), "draft", "left").join(least, "draft", "left").where(F.col("sum") + F.coalesce("left", F.lit(0)) >= F.coalesce("least", F.lit(0)))
    words = index.commits.read(state, "docs").select("segment", "doc", "words")
    # the shared tokens are found by hash, once for each pair: bound to a name, they aren't made again for each of them
    shared = F.array(F.array_intersect(F.transform("rest", lambda x: x["token"]), F.col("words")))
    more = F.element_at(F.transform(shared, lambda own: F.aggregate(F.filter("rest", lambda x: F.array_contains(own, x["token"])), F.lit(0).cast("long"), lambda s, x: s + x["w"])), 1)
    whole = may.where("left is null").select("draft", "doc", F.col("sum").alias("score"))
    rest = may.where("left is not null").select("draft", "segment", "doc", "sum").join(words, ["segment", "doc"]).join(left.select("draft", "rest"), "draft").select("draft", "doc", (F.col("sum") + more).alias("score"))
    return best(whole.unionAll(rest), k, "draft", [F.desc("score"), F.asc("doc")]).select("draft", "rank", "doc", "score")
