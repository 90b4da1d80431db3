"""Mixing sources to target weights by entropy balancing. DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, fresh, written

#: No document, and so no source, is taken more often than this.
MOST = 3
#: Documents of one source and size that share one salted rank, about.
SALT_ROWS = 2_000
#: Newton steps at most, how near each source must come to its target, and how far one step moves a multiplier.
STEPS, NEAR, FAR = 60, 1e-12, 4.0
#: Bounds of a multiplier: rates at an average size lie between exp(-BOUND) and exp(BOUND).
BOUND = 700.0


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ runs; null has none."""
    spaced = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    trimmed = F.trim(spaced)
    return F.when(text.isNull() | (trimmed == ""), F.lit(0)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sources: DataFrame, weights: DataFrame) -> DataFrame:
    """sources(source, source_size) and weights(_w_source, weight) -> with target (double).

    The total of all sizes is shared by weight; a target stops at MOST times its source's size, and the excess is shared
    again by weight until none is above: then target = min(MOST * size, weight * level) with one level for all, found
    from running sums over the sources ordered by size / weight. One row a source is ordered in one task.
    """
    s = sources.join(weights, sources["source"].eqNullSafe(weights["_w_source"])).drop("_w_source")
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    full = F.coalesce(F.sum(F.col("source_size") * MOST).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (total - full).cast("double") / rest)
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("source_size") * MOST, F.col("level"))).over(Window.partitionBy()))
    return s.withColumn("target", F.least(F.col("weight") * F.coalesce("level", F.lit(0.0)), (F.col("source_size") * MOST).cast("double"))).drop("level")


def cycle_weights(sources: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Weights that repeat over the sources by code point, null last. One row for each source is ordered in one task."""
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select(F.col("source").alias("_w_source"), F.element_at(F.array(*map(F.lit, cycle)), at % len(cycle) + 1).cast("long").alias("weight"))


def tilt(x: Column, z: Column) -> Column:
    """The rate of a document of relative size z under its source's multiplier x."""
    return F.when(x * z >= math.log(MOST), F.lit(float(MOST))).otherwise(F.exp(x * z))


def balance(cells: DataFrame, goal: DataFrame) -> DataFrame:
    """goal(_g, source_size, target, mean) with the multiplier x of each source, by distributed Newton iterations.

    The mix has the least relative entropy sum(r log r - r) of the document rates r to 1 under the token constraints
    sum(r * size) = target and r <= MOST. Its convex dual gives r = min(exp(x * size / mean), MOST). A step sums the
    gradient and the Hessian of all sources over cells(source, size, n), which pre-aggregate before the shuffle, and
    moves each x by Newton's rule, at most FAR and inside the interval that the gradients' signs have left; where that
    fails it halves the interval. It ends when every source is within NEAR of its target, or can come no nearer.
    """
    full = F.col("target") >= F.col("source_size") * MOST * (1 - 1e-12)
    state = goal.withColumn("x", F.when(full, F.lit(BOUND)).otherwise(0.0)).withColumn("lo", F.lit(-BOUND)).withColumn("hi", F.lit(BOUND)).withColumn("done", full | (F.col("source_size") == 0))
    state = written(state, "dual")
    for _ in range(STEPS):
        if state.where(~F.col("done")).limit(1).count() == 0:
            break
        c = cells.join(state.where(~F.col("done")).select("_g", "mean", "x"), cells["source"].eqNullSafe(F.col("_g")))
        z = F.col("size") / F.col("mean")
        rate = tilt(F.col("x"), z)
        words = rate * F.col("size") * F.col("n")
        sums = c.groupBy(F.col("_g").alias("_k")).agg(F.sum(words).alias("taken"), F.sum(F.when(rate < MOST, words * z).otherwise(0.0)).alias("slope"))
        s = state.join(sums, state["_g"].eqNullSafe(sums["_k"]), "left").drop("_k")
        gap = F.col("target") - F.col("taken")
        s = s.withColumn("gap", gap).withColumn("lo", F.when(F.col("gap") > 0, F.col("x")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") < 0, F.col("x")).otherwise(F.col("hi")))
        step = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.try_divide("gap", "slope")))
        to = F.when((F.col("slope") > 0) & (F.col("x") + step > F.col("lo")) & (F.col("x") + step < F.col("hi")), F.col("x") + step).otherwise((F.col("lo") + F.col("hi")) / 2)
        near = F.coalesce((F.abs("gap") <= NEAR * F.col("target")) | (to == F.col("x")), F.col("done"))
        s = s.withColumn("near", near).withColumn("x", F.when(F.col("done"), F.col("x")).otherwise(to))
        before, state = state, written(s.select("_g", "source_size", "target", "mean", "x", "lo", "hi", F.col("near").alias("done")), "dual")
        free(before)
    return state.select("_g", "source_size", "target", "mean", "x")


def mix(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", salt_rows: int = SALT_ROWS) -> DataFrame:
    """How often each document is taken so that each source's words meet its target.

    Returns one row for each row of docs: id, th (hash of the text), size (words), source_size, target, rate and copies.
    weights(_w_source, weight > 0) defaults to 5, 2, 1 repeating by code point, a null source being one source, the last.

    Method. Entropy balancing (see balance) gives each document of a source the rate exp(x * size / mean size), at most
    MOST, so that the rates' words meet the source's target: a source that must grow takes its long documents more
    often, one that must shrink drops them first. Rounding works on cells (source, size): walking down the sizes, a cell
    gets the whole copies by which the running sum of rates advances; what words are then missing or over, by less than
    one long document, is made up copy by copy from the smallest sizes. Within a cell copies differ by one at most
    before that, and the extra ones go by a hash of the id.

    Memory and skew: after the text is measured only narrow rows move; a cell of any size is ranked in salted parts of
    about salt_rows, and windows over a source only hold its distinct sizes. Null texts and texts without words have
    size 0 and are taken 0 times. Rows may repeat and ids be null: then ties fall by text hash, and equal rows in any
    order. An empty table gives no rows; other columns are ignored. Reruns agree.
    """
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("th"), n_words(F.col(text_col).cast("string")).alias("size")), "sized")
    cells = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs"))
    goal = targets(sources, cycle_weights(sources) if weights is None else weights)
    goal = written(goal.select(F.col("source").alias("_g"), "source_size", "target", (F.col("source_size") / F.col("docs")).alias("mean")), "goal")
    goal = balance(cells, goal)
    rate = F.when((F.col("source_size") > 0) & (F.col("size") > 0), tilt(F.col("x"), F.col("size") / F.col("mean"))).otherwise(0.0)
    cells = cells.join(goal, cells["source"].eqNullSafe(goal["_g"])).withColumn("rate", rate).drop("_g")
    down, up = Window.partitionBy("source").orderBy(F.desc("size")), Window.partitionBy("source").orderBy("size")
    upto = F.floor(F.sum(F.col("rate") * F.col("n")).over(down) + 0.5)
    cells = cells.withColumn("upto", upto).withColumn("copies", (F.col("upto") - F.lag("upto", 1, 0).over(down)).cast("long"))
    cells = cells.withColumn("copies", F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("copies"), F.col("n") * MOST))).otherwise(0).cast("long"))
    lack = F.round(F.col("target") - F.sum(F.col("copies") * F.col("size")).over(Window.partitionBy("source"))).cast("long")
    cells = cells.withColumn("lack", lack).withColumn("room", F.when(F.col("size") == 0, 0).otherwise(F.when(F.col("lack") > 0, F.col("n") * MOST - F.col("copies")).otherwise(F.col("copies"))).cast("long"))
    before = F.sum(F.col("room") * F.col("size")).over(up) - F.col("room") * F.col("size")
    step = F.least(F.col("room"), F.floor(F.greatest(F.abs("lack") - before, F.lit(0)) / F.greatest("size", F.lit(1)))).cast("long")
    cells = cells.withColumn("copies", F.col("copies") + F.signum("lack").cast("long") * step)
    cells = written(cells.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "copies", "source_size", "target", "rate"), "copies")
    salted = sized.join(cells, sized["source"].eqNullSafe(cells["_s"]) & (sized["size"] == cells["_z"])).drop("_s", "_z")
    salted = salted.withColumn("h", F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")))
    salted = salted.withColumn("part", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.greatest(F.ceil(F.col("n") / salt_rows), F.lit(1)).cast("long")))
    salted = written(salted, "salted")
    parts = salted.where(F.col("n") > salt_rows).groupBy("source", "size", "part").agg(F.count("*").alias("m"))
    parts = parts.withColumn("start", F.sum("m").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("m")).drop("m").withColumnsRenamed({"source": "_s", "size": "_z", "part": "_p"})
    parts = written(parts, "parts")
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "th")) - 1
    ranked = salted.withColumn("rank", rank)
    ranked = ranked.join(parts, ranked["source"].eqNullSafe(parts["_s"]) & (ranked["size"] == parts["_z"]) & (ranked["part"] == parts["_p"]), "left")
    ranked = ranked.withColumn("rank", F.col("rank") + F.coalesce("start", F.lit(0)))
    each = F.floor(F.col("copies") / F.col("n"))
    copies = (each + F.when(F.col("rank") < F.col("copies") - each * F.col("n"), 1).otherwise(0)).cast("long")
    return ranked.select("id", "th", "source", "size", "source_size", "target", "rate", copies.alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row repeated as often as mix() takes it.

    Rows that agree in id, text and source share their copies evenly; what doesn't divide goes to one of them.
    """
    c = written(mix(docs, None, id_col, text_col, source_col).groupBy("id", "th", "source").agg(F.sum("copies").alias("c"), F.count("*").alias("k")).where("c > 0"), "mixed")
    own = [fresh(x) for x in ("id", "th", "source", "times")]

    def taken(rows: DataFrame, times: Column) -> DataFrame:
        t = rows.select(*(F.col(x).alias(y) for x, y in zip(("id", "th", "source"), own, strict=False)), F.array_repeat(F.lit(0), times.cast("int")).alias(own[3]))
        return docs.join(t, docs[id_col].eqNullSafe(t[own[0]]) & (F.xxhash64(docs[text_col]) == t[own[1]]) & docs[source_col].cast("string").eqNullSafe(t[own[2]]))

    out = taken(c.where("c >= k"), F.floor(F.col("c") / F.col("k"))).withColumn(own[3], F.explode(own[3])).select(*docs.columns)
    left = c.where("c % k > 0")
    if left.limit(1).count():
        out = out.unionAll(taken(left, F.expr("c % k")).dropDuplicates(own[:3]).withColumn(own[3], F.explode(own[3])).select(*docs.columns))
    return out
