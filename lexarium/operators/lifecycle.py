"""Where projects stand and what follows: statuses, recent changes, candidates of events, notes, evidence classes, overviews.

Joins are by key, lists of labels and phrases are parameters, and work that must be done once is an anti join with what has
been done, marked in the same commit as its results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, fold_key, normalise
from ..sources.store import Store

#: Character references that titles are stored with.
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}


def canonical_status(stage: Column, statuses: dict[str, str], otherwise: str) -> Column:
    """The status that a stage's label stands for."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in statuses.items() for x in kv))[fold_key(stage)], F.lit(otherwise))


def live(stage: Column, dead: list[str]) -> Column:
    """Whether a project is still under way: its stage holds none of these phrases; an unknown stage is."""
    key = F.coalesce(fold_key(stage), F.lit(""))
    out = F.lit(True)
    for phrase in dead:
        out = out & ~F.contains(key, F.lit(phrase))
    return out


def recent_stage_changes(events: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """(project, stage, was, at): projects whose last event(project, at, event, stage) with another stage than the one before
    it is at most so many days old."""
    w = Window.partitionBy("project").orderBy("at", "event")
    moved = events.withColumn("was", F.lag("stage").over(w)).where("was is not null and stage <> was")
    last = moved.groupBy("project").agg(F.max_by(F.struct("stage", "was", "at"), F.struct("at", "event")).alias("x")).select("project", "x.*")
    return last.where((F.to_date("at") <= today) & (F.datediff(today, F.to_date("at")) <= days))


def snapshot_events(snapshots: DataFrame) -> DataFrame:
    """(source, at, kind, value): what each snapshot(source, at, stage, deadline, documents) says anew against the one before
    it: opened (the first), stage, deadline, and one document row for each new document."""
    w = Window.partitionBy("source").orderBy("at")
    x = snapshots.withColumn("_s", F.lag("stage").over(w)).withColumn("_d", F.lag("deadline").over(w)).withColumn("_f", F.lag("documents").over(w)).withColumn("_n", F.row_number().over(w))
    none = F.array().cast("array<string>")
    said = lambda kind, value, when: F.when(when, F.array(F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    later = F.col("_n") > 1
    fresh = F.array_except(F.coalesce("documents", none), F.coalesce("_f", none))
    rows = F.concat(
        said("opened", F.col("stage"), F.col("_n") == 1), said("stage", F.col("stage"), later & ~F.col("stage").eqNullSafe(F.col("_s"))), said("deadline", F.col("deadline"), later & ~F.col("deadline").eqNullSafe(F.col("_d"))),
        F.transform(fresh, lambda d: F.struct(F.lit("document").alias("kind"), d.alias("value"))),
    )
    return x.select("source", "at", F.explode(rows).alias("e")).select("source", "at", "e.kind", "e.value")


def notes_of(events: DataFrame, notes: DataFrame, asked: DataFrame) -> DataFrame:
    """notes(note, project, event, text) with one more for each asked(event) that has none: the event's fields, copied."""
    new = events.join(asked.select("event").distinct(), "event", "left_semi").join(notes.select("event"), "event", "left_anti")
    said = F.concat_ws(": ", F.col("at").cast("string"), "stage")
    return notes.unionByName(new.select(content_hash(F.col("project").cast("string"), F.col("event").cast("string")).alias("note"), "project", "event", said.alias("text")))


def evidence_classes(sources: DataFrame, registry: DataFrame, otherwise: str = "unknown") -> DataFrame:
    """sources(source, url) with the quality that registry(id, url, quality) gives them by id, else by address."""
    by_id = registry.where("id is not null").groupBy(F.col("id").alias("source")).agg(F.min("quality").alias("_i"))
    by_url = registry.where("url is not null").groupBy("url").agg(F.min("quality").alias("_u"))
    return sources.join(by_id, "source", "left").join(by_url, "url", "left").select("source", "url", F.coalesce("_i", "_u", F.lit(otherwise)).alias("quality"))


def draft_operations(operations: DataFrame, chosen: DataFrame, cap: int = 200) -> DataFrame:
    """operations(draft, ord, act, locator, kind) on chosen(act) targets, the first `cap` of each draft."""
    o = operations.join(chosen.select("act").distinct(), "act", "left_semi")
    return o.withColumn("_n", F.row_number().over(Window.partitionBy("draft").orderBy("ord", "act", "locator"))).where(F.col("_n") <= cap).drop("_n")


def comparable(units: DataFrame, text: str, words: int = 15) -> DataFrame:
    """(n, comparable, percent): units long enough to be compared."""
    enough = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")) >= words
    return units.agg(F.count("*").alias("n"), F.count_if(enough).alias("comparable")).withColumn("percent", F.round(F.try_divide(100 * F.col("comparable"), "n"), 1))


def act_tokens(provisions: DataFrame, act: str, text: str) -> DataFrame:
    """(act, token): distinct tokens of all of an act's provisions."""
    return provisions.select(act, F.explode(F.array_distinct(F.regexp_extract_all(fold_key(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0)))).alias("token")).distinct()


def flag_edges(acts: DataFrame, flags: dict[str, str]) -> DataFrame:
    """(source, kind, certainty): what a publisher marks of acts(source, marks), by these kinds, as edges whose target isn't told."""
    kinds = F.create_map(*(F.lit(x) for kv in flags.items() for x in kv))
    return acts.select("source", F.explode(F.array_distinct("marks")).alias("m")).select("source", kinds[F.col("m")].alias("kind"), F.lit("assumed").alias("certainty")).where("kind is not null").distinct()


def changed_provisions(operations: DataFrame, provisions: DataFrame) -> DataFrame:
    """(act, locator, changes, last, text): what operations(act, locator, since, kind) touched, with the stored text."""
    o = operations.groupBy("act", "locator").agg(F.count("*").alias("changes"), F.max("since").alias("last"))
    return o.join(provisions.select("act", "locator", "text"), ["act", "locator"], "left")


def repaired_titles(rows: DataFrame, title: str) -> DataFrame:
    """rows whose title changes once character references are read and the spelling is normalised: with `was`."""
    c = F.col(title)
    for said, means in REFERENCES.items():
        c = F.replace(c, F.lit(said), F.lit(means))
    return rows.withColumn("was", F.col(title)).withColumn(title, F.regexp_replace(normalise(c), r"\s+", " ")).where(F.col("was") != F.col(title))


def matching(rows: DataFrame, equal: dict[str, list] | None = None, at_most: dict[str, int] | None = None, said: tuple[str, str] | None = None) -> DataFrame:
    """The rows behind a matrix cell: columns in lists, columns not above a bound, and a folded phrase in a column."""
    for c, values in (equal or {}).items():
        rows = rows.where(F.col(c).isin(*values))
    for c, bound in (at_most or {}).items():
        rows = rows.where(F.col(c) <= bound)
    return rows.where(F.contains(fold_key(F.col(said[0])), F.lit(said[1]))) if said else rows


def overview(tables: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """(part, measure, value): counters of several tables in one, each table read once."""
    out = None
    for part, (t, measures) in tables.items():
        one = t.agg(*(m.cast("long").alias(n) for n, m in measures.items()))
        one = one.select(F.explode(F.array(*(F.struct(F.lit(part).alias("part"), F.lit(n).alias("measure"), F.col(n).alias("value")) for n in measures))).alias("x")).select("x.*")
        out = one if out is None else out.unionAll(one)
    return out


def examine_once(store: Store, inputs: DataFrame, key: str, examine: Callable[[DataFrame], DataFrame], results: str, marks: str = "examined") -> bool:
    """Examine the inputs that aren't marked yet: their results and marks are appended in one commit. Whether there were any."""
    with store.transaction() as t:
        new = inputs.join(t.read(marks).select(key), key, "left_anti") if t.has(marks) else inputs
        if new.limit(1).count() == 0:
            return False
        t.append(results, examine(new))
        t.append(marks, new.select(key).distinct())
    return True
