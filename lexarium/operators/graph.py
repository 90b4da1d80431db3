"""Citation graph of acts: edges(source, source_locator, target, locator, kind, since), read in both directions.

Locators are dotted paths (art5.alin2), an empty one is the whole act. What lies below a path is found by ancestors: a
locator is dealt out under each path that holds it, so that covering is equality on (act, path) and a much cited act is no
one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of edges that change the target.
CHANGES = ("modifica", "abroga", "introduce", "completeaza", "inlocuieste", "suspenda", "proroga")

#: So many acts, or fewer, are broadcast to filter edges.
FEW = 100_000


def covers(outer: Column, inner: Column) -> Column:
    """Whether a path is another or holds it; the empty path holds all. art1 doesn't hold art10."""
    return (outer == "") | (outer == inner) | F.startswith(inner, F.concat(outer, F.lit(".")))


def ancestors(locator: Column, itself: bool = True) -> Column:
    """The paths that hold a locator: the whole act (''), each path above it, and itself."""
    parts = F.split(locator, r"\.")
    depth = F.size(parts)
    above = F.transform(F.when(depth > 1, F.sequence(F.lit(1), depth - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    up = F.when(locator == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("")), above))
    return F.concat(up, F.array(locator)) if itself else up


def touch(cited: Column, target: Column) -> Column:
    """How a cited path meets a target: exact, inside it, around it (whole act included) or apart."""
    return F.when(cited == target, "exact").when(covers(target, cited), "inside").when(covers(cited, target), "around").otherwise("apart")


def overlap_grade(cited: Column, struck: Column) -> Column:
    """Five grades of a citation and a struck provision: exact, sub (cited lies below), over (above), whole (the whole act
    is struck), act (the whole act is cited)."""
    return F.when(cited == struck, "exact").when(struck == "", "whole").when(cited == "", "act").when(covers(struck, cited), "sub").when(covers(cited, struck), "over")


def spanned_text(provisions: DataFrame, act: str = "act", ord_: str = "ord", locator: str = "locator", text: str = "text") -> DataFrame:
    """(act, ord, locator, start, end): where each provision stands in its act's provisions joined by line breaks."""
    w = Window.partitionBy(act).orderBy(ord_).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0))
    return provisions.select(act, ord_, locator, start.alias("start"), (start + F.length(text)).alias("end"))


def at_offset(points: DataFrame, spans: DataFrame, act: str = "act", offset: str = "offset", width: int = 128) -> DataFrame:
    """points with the locator of the provision they lie in (start <= offset < end); null outside all.

    Spans are dealt out to the bins of `width` places that they reach, so that a point only meets spans of its own bin, and
    a long act's bins are keys of their own.
    """
    bins = F.explode(F.when(F.col("end") > F.col("start"), F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))))
    s = spans.select(F.col(act).alias("_act"), "start", "end", "locator", bins.alias("_bin"))
    p = points.withColumn("_at", F.floor(F.col(offset) / width))
    return p.join(s, (p[act] == s["_act"]) & (p["_at"] == s["_bin"]) & (s["start"] <= p[offset]) & (p[offset] < s["end"]), "left").drop("_act", "start", "end", "_bin", "_at")


def edges_of(sources: DataFrame, operations: DataFrame, citations: DataFrame) -> DataFrame:
    """Edges of acts: sources(source, since), operations and citations(source, source_locator, act, locator[, kind]).

    Operations come first; a citation of an act that the same source changes adds no edge, nor does one of itself. Equal
    edges count once.
    """
    ops = operations.where("act is not null and act <> source").select("source", "source_locator", F.col("act").alias("target"), "locator", "kind")
    refs = citations.where("act is not null and act <> source").select("source", "source_locator", F.col("act").alias("target"), "locator", F.lit("refera").alias("kind"))
    refs = refs.join(ops.select("source", "target").distinct(), ["source", "target"], "left_anti")
    return ops.unionByName(refs).distinct().join(sources.select("source", "since"), "source", "left")


def of_targets(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges to the acts that one column of targets names; edges to others are left out before they are joined with anything.
    Up to FEW acts go to every task."""
    acts = targets.toDF("_act").distinct()
    acts = F.broadcast(acts) if acts.count() <= FEW else acts
    return edges.join(acts, edges["target"] == acts["_act"], "left_semi")


def inbound(edges: DataFrame, target: str, changes_only: bool = False) -> DataFrame:
    """Edges to an act by date, undated last."""
    e = edges.where(F.col("target") == target)
    return (e.where(F.col("kind").isin(*CHANGES)) if changes_only else e).orderBy(F.asc_nulls_last("since"), "source", "locator")


def outbound(edges: DataFrame, source: str) -> DataFrame:
    return edges.where(F.col("source") == source).orderBy("target", "locator")


def who_cites(edges: DataFrame, targets: DataFrame, tasks: int | None = None) -> DataFrame:
    """targets(target, path) with every edge that meets them: grade exact, inside or around, most certain first by rank.
    Edges are dealt out to so many tasks, if given (see state.tasks_of)."""
    dealt = lambda d, *keys: d.repartition(tasks, *keys) if tasks else d
    t = targets.select(F.col("target").alias("_t"), "path")
    over = t.withColumn("_key", F.explode(ancestors(F.col("path"))))
    own = dealt(edges, "target", "locator")
    e = own.join(over, (own["target"] == over["_t"]) & (own["locator"] == over["_key"])).drop("_t", "_key")
    below = dealt(edges.withColumn("_key", F.explode(ancestors(F.col("locator"), itself=False))), "target", "_key")
    inside = below.join(t, (below["target"] == t["_t"]) & (below["_key"] == t["path"])).drop("_t", "_key")
    met = e.withColumn("grade", F.when(F.col("locator") == F.col("path"), "exact").otherwise("around")).unionByName(inside.withColumn("grade", F.lit("inside")))
    return met.withColumn("rank", F.when(F.col("grade") == "exact", 0).when(F.col("grade") == "inside", 1).otherwise(2))


def citation_counts(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(target, citing, amending): how many sources cite each target of edges(target, source, amends), and how many amend it.

    A pair is one row before sources are counted; pairs are dealt out to so many tasks, if given (see state.tasks_of), and
    by both ends, so that a much cited target isn't one task's."""
    own = edges.repartition(tasks, "target", "source") if tasks else edges
    pairs = own.groupBy("target", "source").agg(F.max("amends").alias("amends"))
    return pairs.groupBy("target").agg(F.count("source").alias("citing"), F.count(F.when(F.col("amends"), F.col("source"))).alias("amending"))


def neighbours(edges: DataFrame, limit: int = 10) -> DataFrame:
    """(node, neighbour, kind, since, direction): the first edge with each neighbour in either direction, `limit` a node."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "kind", "since", F.lit("out").alias("direction")).unionAll(edges.select("target", "source", "kind", "since", F.lit("in")))
    first = both.groupBy("node", "neighbour").agg(F.min(F.struct(F.coalesce("since", F.lit("9999-12-31").cast("date")).alias("day"), "direction", "kind")).alias("e"))
    at = F.row_number().over(Window.partitionBy("node").orderBy("neighbour"))
    return first.withColumn("at", at).where(F.col("at") <= limit).select("node", "neighbour", "e.kind", F.col("e.day").alias("since"), "e.direction")


def watch_state(edges: DataFrame, pending: DataFrame) -> DataFrame:
    """(target, citing, changing, last_change, pending): what is known of every act that is cited or has pending(target)."""
    change = F.col("kind").isin(*CHANGES)
    one = edges.groupBy("target", "source").agg(F.max(change).alias("change"), F.max(F.when(change, F.col("since"))).alias("last"))  # a row a pair, so that no row is multiplied
    e = one.groupBy("target").agg(F.count("source").alias("citing"), F.count(F.when(F.col("change"), F.col("source"))).alias("changing"), F.max("last").alias("last_change"))
    p = pending.groupBy("target").agg(F.count("*").alias("pending"))
    return e.join(p, "target", "full").select("target", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("citing", "changing")), "last_change", F.coalesce("pending", F.lit(0)).alias("pending"))


def target_facts(targets: DataFrame, edges: DataFrame, pending: DataFrame) -> DataFrame:
    """targets(draft, target) with what watch_state knows of each."""
    return targets.select("draft", "target").distinct().join(watch_state(edges, pending), "target", "left").fillna({"citing": 0, "changing": 0, "pending": 0})


def graph_summary(edges: DataFrame) -> DataFrame:
    change = F.col("kind").isin(*CHANGES)
    return edges.agg(F.count("*").alias("edges"), F.count_if(change).alias("changes"), F.countDistinct(F.when(change, F.col("source"))).alias("changing"), F.countDistinct(F.when(change, F.col("target"))).alias("changed"))


def impact(edges: DataFrame, uses: DataFrame, sizes: DataFrame, small: int = 400, far: int = 40) -> DataFrame:
    """(target, reach, level, hidden): citations, uses of its terms, 10 a term, 5 a repeal of it; hidden: a short text of far reach.

    uses(target, terms, term_uses) and sizes(target, n_chars) may lack acts.
    """
    e = edges.groupBy("target").agg(F.countDistinct("source").alias("citing"), F.count_if(F.col("kind") == "abroga").alias("repeals"))
    x = e.join(uses, "target", "left").join(sizes, "target", "left").fillna(0, ["terms", "term_uses"])
    reach = F.col("citing") + F.col("term_uses") + 10 * F.col("terms") + 5 * F.col("repeals")
    level = F.when(F.col("reach") >= 200, "wide").when(F.col("reach") >= 40, "some").otherwise("narrow")
    return x.withColumn("reach", reach).select("target", "reach", level.alias("level"), F.coalesce((F.col("n_chars") <= small) & (F.col("reach") >= far), F.lit(False)).alias("hidden"))


def tightest(hits: DataFrame, unit: str = "unit", norm: str = "norm") -> DataFrame:
    """hits without those of a unit that holds another unit (a longer path) with the same norm."""
    above = hits.select(F.explode(ancestors(F.col(unit), itself=False)).alias(unit), norm).distinct()
    return hits.join(above, [unit, norm], "left_anti")
