"""What is in force: dead and qualified citations, struck provisions, due duties, versions as of a date, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import legal_rank
from .graph import ancestors, of_targets

#: Kinds of edges that qualify a provision, and what they make of it.
QUALIFIES = {"suspenda": "suspendat", "deroga": "derogare", "proroga": "prorogat"}


def crosses_republication(since: Column, republished: Column, locator: Column) -> Column:
    """Whether an edge to a part of an act is older than the act's republication, so that its numbering may have moved."""
    return (locator != "") & republished.isNotNull() & (since.isNull() | (since < republished))


def dead_citations(refs: DataFrame, edges: DataFrame, republished: DataFrame) -> DataFrame:
    """refs(ref, act, locator) that point at a repealed act or part: with by, since, whole and severity.

    The repeal of the whole act counts first; else the earliest of a part that is the cited one or holds it. Of a part,
    a repeal older than the republication(act, republished) is material, all others are blocking.
    """
    day = F.coalesce(F.col("since").cast("string"), F.lit(""))
    dead = edges.where("kind = 'abroga'").groupBy(F.col("target").alias("act"), F.col("locator").alias("gone")).agg(F.min(F.struct(day.alias("day"), F.col("source").alias("by"), "since")).alias("r"))
    r = refs.select("ref", "act", "locator").distinct().withColumn("gone", F.explode(ancestors(F.col("locator"))))
    order = F.struct((F.col("gone") != "").alias("part"), F.col("r.day").alias("day"), "gone", F.col("r.by").alias("by"), F.col("r.since").alias("since"))
    one = r.join(dead, ["act", "gone"]).groupBy("ref", "act", "locator").agg(F.min(order).alias("x")).join(republished, "act", "left")
    moved = crosses_republication(F.col("x.since"), F.col("republished"), F.col("x.gone"))
    return one.select("ref", "act", "locator", F.col("x.by").alias("by"), F.col("x.since").alias("since"), (F.col("x.gone") == "").alias("whole"), F.when(moved, "material").otherwise("blocking").alias("severity"))


def qualified_citations(refs: DataFrame, edges: DataFrame) -> DataFrame:
    """refs that point at something suspended, derogated from or extended, and not repealed: with status, by and since."""
    r = refs.select("ref", "act", "locator").distinct()
    alive = r.join(dead_citations(r, edges, refs.sparkSession.createDataFrame([], "act string, republished date")).select("ref", "act", "locator"), ["ref", "act", "locator"], "left_anti")
    q = edges.where(F.col("kind").isin(*QUALIFIES)).select(F.col("target").alias("act"), F.col("locator").alias("on"), F.col("kind").alias("status"), "since", F.col("source").alias("by")).distinct()
    hit = alive.withColumn("on", F.explode(ancestors(F.col("locator")))).join(q, ["act", "on"])
    return hit.select("ref", "act", "locator", F.create_map(*(F.lit(x) for kv in QUALIFIES.items() for x in kv))[F.col("status")].alias("status"), "by", "since").distinct()


def struck_register(strikes: DataFrame, edges: DataFrame, kinds: DataFrame, today: Column, days: int = 45) -> DataFrame:
    """Strikes(strike, act, locator, published, suspends) that no later change repairs, with deadline and overdue days.

    A repair is a later change of an overlapping part of the act by an act that may change it: kinds(act, kind) gives the
    types, an unknown one may. The deadline is publication + days, only for a strike that suspends.
    """
    by_kind = kinds.select(F.col("act").alias("source"), F.col("kind").alias("by_kind"))
    e = of_targets(edges.where("since is not null"), strikes.select("act")).select(F.col("target").alias("act"), "locator", "since", "source").join(by_kind, "source", "left")
    e = e.withColumn("by", F.when(F.col("by_kind").isNotNull(), legal_rank(F.col("by_kind"))))
    # of the changes of a path, and of those of what lies below it, only the last one by each rank can repair
    dealt = e.withColumn("on", F.explode(ancestors(F.col("locator")))).withColumn("under", F.col("on") != F.col("locator"))
    last = dealt.groupBy("act", "on", "by", "under").agg(F.max("since").alias("last"))
    s = strikes.join(kinds.select("act", F.col("kind").alias("own_kind")), "act", "left").withColumn("own", F.when(F.col("own_kind").isNotNull(), legal_rank(F.col("own_kind"))))
    repairs = (F.col("last") > F.col("published")) & (F.col("by").isNull() | F.col("own").isNull() | (F.col("by") <= F.col("own")))
    key = s.select("strike", "act", "locator", "published", "own")
    met = key.withColumn("on", F.explode(ancestors(F.col("locator")))).join(last, ["act", "on"])
    done = met.where(repairs & (~F.col("under") | (F.col("on") == F.col("locator")))).select("strike").distinct()
    open_ = s.join(done, "strike", "left_anti")
    due = F.when(F.col("suspends"), F.date_add("published", days))
    return open_.select("strike", "act", "locator", "published", due.alias("due"), F.greatest(F.datediff(today, due), F.lit(0)).alias("overdue"))


def strike_summary(register: DataFrame) -> DataFrame:
    """(act, locator, strikes, first_strike, first_published, longest): by struck provision."""
    first = F.min(F.struct("published", "strike"))
    return register.groupBy("act", "locator").agg(F.count("*").alias("strikes"), first["strike"].alias("first_strike"), first["published"].alias("first_published"), F.max("overdue").alias("longest"))


def collisions(refs: DataFrame, register: DataFrame) -> DataFrame:
    """Citations of a draft that meet struck provisions: (ref, act, locator, grade, struck, first_strike), closest grade first."""
    s = strike_summary(register).select("act", F.col("locator").alias("struck"), "first_strike")
    r = refs.select("ref", "act", "locator").distinct()
    over = r.withColumn("struck", F.explode(ancestors(F.col("locator")))).join(s, ["act", "struck"])
    over = over.select("ref", "act", "locator", "struck", "first_strike", F.when(F.col("locator") == F.col("struck"), "exact").when(F.col("struck") == "", "whole").otherwise("sub").alias("grade"))
    # of what is struck below a path only the first counts
    below = s.withColumn("locator", F.explode(ancestors(F.col("struck"), itself=False))).groupBy("act", "locator").agg(F.min(F.struct("first_strike", "struck")).alias("x"))
    under = r.join(below, ["act", "locator"]).select("ref", "act", "locator", "x.struck", "x.first_strike", F.when(F.col("locator") == "", "act").otherwise("over").alias("grade"))
    hit = over.unionAll(under)
    rank = F.element_at(F.create_map(*(F.lit(x) for i, g in enumerate(("exact", "sub", "over", "whole", "act")) for x in (g, i))), F.col("grade"))
    at = F.row_number().over(Window.partitionBy("ref", "act", "locator").orderBy(rank, "first_strike", "struck"))
    return hit.withColumn("at", at).where("at = 1").drop("at")


def due_date(until: Column, days: Column, base: Column, in_force: Column, published: Column) -> Column:
    """The fixed date, else the date of the base named (publication, else entry into force) plus days; null if unknown."""
    return F.coalesce(until, F.date_add(F.when(base == "publicare", published).otherwise(in_force), days))


def implementations(duties: DataFrame, edges: DataFrame, acts: DataFrame) -> DataFrame:
    """(duty, by): acts of the expected type that cite the host and were not published before it; undated ones count."""
    d = duties.select("duty", "host", "expected", F.col("published").alias("_p"))
    e = of_targets(edges, duties.select("host")).select(F.col("source").alias("by"), F.col("target").alias("_t")).distinct()
    a = acts.select(F.col("act").alias("by"), F.col("kind"), F.col("published"))
    x = d.join(e, d["host"] == e["_t"]).join(a, "by")
    return x.where((F.col("expected").isNull() | (F.col("kind") == F.col("expected"))) & (F.col("published").isNull() | F.col("_p").isNull() | (F.col("published") >= F.col("_p")))).select("duty", "by").distinct()


def gap_report(duties: DataFrame, edges: DataFrame, acts: DataFrame, today: Column, complete: list[str]) -> DataFrame:
    """Duties(duty, host, expected, published, due) that nothing implements: overdue days, near candidates, severity, limits.

    A near candidate cites the host but is of another type. A duty whose type isn't declared complete can't be blocking.
    """
    done = implementations(duties, edges, acts)
    near = implementations(duties.withColumn("expected", F.lit(None).cast("string")), edges, acts).groupBy("duty").agg(F.count("*").alias("near"))
    overdue = F.greatest(F.datediff(today, F.col("due")), F.lit(0))
    limits = F.filter(F.array(F.when(~F.coalesce(F.col("expected").isin(*complete), F.lit(False)), "type_incomplete"), F.when(F.col("due").isNull(), "no_due_date"), F.when(F.col("near") > 0, "near_candidates")), lambda x: x.isNotNull())
    out = duties.join(done, "duty", "left_anti").join(near, "duty", "left").withColumn("near", F.coalesce("near", F.lit(0))).withColumn("overdue", overdue).withColumn("limits", limits)
    severity = F.when(F.array_contains("limits", "type_incomplete") | F.col("due").isNull(), "note").when(F.col("overdue") > 365, "blocking").when(F.col("overdue") > 0, "material").otherwise("note")
    return out.select("duty", "host", "expected", "overdue", "near", severity.alias("severity"), F.array_join("limits", ",").alias("limits"))


def as_of(versions: DataFrame, asked: DataFrame, fallback: bool = True) -> DataFrame:
    """asked(name, day) with the version(name, version, since) in force: the latest not after the day, without a day the
    latest of all; if none is that old the first one (fallback) or none. An undated version counts as the last one; a name
    without versions has none in force."""
    v = versions.where("version is not null").select(F.col("name").alias("_n"), "version", "since")
    x = asked.join(v, asked["name"] == v["_n"], "left")
    ok = F.col("_n").isNotNull() & (F.col("day").isNull() | (F.col("since") <= F.col("day")))
    order = F.struct(F.col("since").isNull().alias("undated"), "since", "version")
    best = F.max(F.when(ok, order))
    first = F.min(F.when(F.col("_n").isNotNull(), order))
    g = x.groupBy("name", "day").agg(best.alias("b"), first.alias("f"))
    return g.select("name", "day", F.coalesce("b.version", "f.version" if fallback else F.lit(None)).alias("version"), F.col("b").isNotNull().alias("in_force"))


def resolve_citation(cited: DataFrame, acts: DataFrame, canonical: str) -> DataFrame:
    """cited(cite_key) with one act(act, cite_key, issuer, published): the canonical issuer's first, then the earliest."""
    order = F.struct((F.col("issuer") != canonical).alias("o"), F.coalesce(F.col("published").cast("string"), F.lit("9999")).alias("d"), "act")
    one = acts.groupBy("cite_key").agg(F.min(order).alias("x"), F.count("*").alias("candidates"))
    return cited.select("cite_key").distinct().join(one, "cite_key", "left").select("cite_key", F.col("x.act").alias("act"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def year_alias(cited: DataFrame, acts: DataFrame) -> DataFrame:
    """cited(kind, number, year, title) with no act of that year -> the one act of the next or previous year whose title
    agrees, if there is exactly one."""
    a = acts.select("act", F.col("kind").alias("_k"), F.col("number").alias("_n"), F.col("year").alias("_y"), F.col("title").alias("_t"))
    exact = cited.join(a, (cited["kind"] == a["_k"]) & (cited["number"] == a["_n"]) & (cited["year"] == a["_y"]), "left_anti")
    near = exact.join(a, (exact["kind"] == a["_k"]) & (exact["number"] == a["_n"]) & (F.abs(exact["year"] - a["_y"]) == 1) & (exact["title"] == a["_t"]))
    return near.groupBy("kind", "number", "year").agg(F.min("act").alias("act"), F.count("*").alias("n")).where("n = 1").drop("n")


def consolidated(base: DataFrame, ops: DataFrame, day: Column) -> DataFrame:
    """(locator, text, ops, blocked): base(locator, text) after ops(locator, since, ord, kind, new_text) up to a day.

    Operations apply in the order of (since, ord): a repeal empties, a change with text replaces, an insertion makes a new
    locator. An undated operation or a change without text blocks its locator: the base text stays and blocked says so.
    """
    due = ops.where(F.col("since").isNull() | (F.col("since") <= day))
    bad = F.col("since").isNull() | (F.col("new_text").isNull() & (F.col("kind") != "abroga"))
    o = due.groupBy("locator").agg(F.max_by(F.when(F.col("kind") == "abroga", F.lit(None).cast("string")).otherwise(F.col("new_text")), F.struct("since", "ord")).alias("now"), F.max_by("kind", F.struct("since", "ord")).alias("last"), F.count("*").alias("ops"), F.max(bad).alias("blocked"), F.max((F.col("kind") == "introduce").cast("int")).alias("inserted"))
    x = base.join(o, "locator", "full").where(F.col("text").isNotNull() | (F.col("inserted") == 1))
    text = F.when(F.coalesce("blocked", F.lit(False)) | F.col("ops").isNull(), F.col("text")).otherwise(F.col("now"))
    return x.select("locator", text.alias("text"), F.coalesce("ops", F.lit(0)).alias("ops"), F.coalesce("blocked", F.lit(False)).alias("blocked"))


def paired_operations(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """(act, n, point, block): announced points(act, ord, point) and quoted blocks(act, ord, block) by position.

    Acts in which the numbers of the two differ are given with null block and mismatch true, none is guessed.
    """
    w = Window.partitionBy("act").orderBy("ord")
    p = points.withColumn("n", F.row_number().over(w)).withColumn("np", F.count("*").over(Window.partitionBy("act"))).drop("ord")
    b = blocks.withColumn("n", F.row_number().over(w)).withColumn("nb", F.count("*").over(Window.partitionBy("act"))).drop("ord")
    x = p.join(b, ["act", "n"], "left").join(b.groupBy("act").agg(F.max("nb").alias("total")), "act", "left")
    off = F.coalesce("total", F.lit(0)) != F.col("np")
    return x.select("act", "n", "point", F.when(~off, F.col("block")).alias("block"), off.alias("mismatch"))


def struck_text(strikes: DataFrame, provisions: DataFrame) -> DataFrame:
    """strikes(strike, act, locator) with the text they struck: of the exact locator, else of its article, else a reason."""
    p = provisions.select(F.col("act").alias("_a"), F.col("locator").alias("_l"), "text")
    article = F.element_at(F.split("locator", r"\."), 1)
    s = strikes.withColumn("article", article)
    exact = s.join(p, (s["act"] == p["_a"]) & (s["locator"] == p["_l"]), "left").drop("_a", "_l").withColumnRenamed("text", "exact_text")
    both = exact.join(p, (exact["act"] == p["_a"]) & (exact["article"] == p["_l"]), "left").drop("_a", "_l")
    known = provisions.select("act").distinct().withColumn("known", F.lit(True))
    x = both.join(known, "act", "left")
    found = F.when(F.col("exact_text").isNotNull(), "exact").when(F.col("text").isNotNull(), "article").when(F.col("locator") == "", "whole_act").when(F.col("known").isNull(), "act_missing").otherwise("locator_missing")
    return x.select("strike", "act", "locator", F.coalesce("exact_text", "text").alias("text"), found.alias("found"))


def struck_coverage(found: DataFrame) -> DataFrame:
    return found.groupBy("found").agg(F.count("*").alias("n"))
