"""Incremental state over tables: keyed replacement, latest rows, change detection, guarded transitions, deltas, revisions.

Every operator takes and gives DataFrames; what is replaced is found by equi joins on keys, and the newest row of a key
by one partial aggregate, so no key is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash


#: Rows of a task that joins or counts tables dealt out by `tasks_of`.
ROWS = 1 << 20


def tasks_of(*tables: DataFrame) -> int:
    """How many tasks these tables are dealt out to, so that each gets about ROWS rows: Spark's own choice goes by compressed
    bytes, of which keys in order take so few that one task would hold tens of millions of rows."""
    rows = sum(t.count() for t in tables)
    return max(-(-rows // ROWS), int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")))


def newest(df: DataFrame, keys: list[str], order: list[str], first: bool = False) -> DataFrame:
    """One row for each key, the last (or first) by order; the aggregate moves one row a key and task."""
    pick = (F.min_by if first else F.max_by)(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_r")).select("_r.*")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with all rows of the keys in new replaced by new's: applied twice, it gives the same."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merged(old: DataFrame, new: DataFrame, keys: list[str], keep_if_empty: list[str]) -> DataFrame:
    """Upsert by key: new rows win, but an empty or null value of keep_if_empty doesn't overwrite the old one."""
    o = old.select(*keys, *(F.col(c).alias(f"_{c}") for c in old.columns if c not in keys), F.lit(True).alias("_old"))
    x = new.withColumn("_new", F.lit(True)).join(o, keys, "full")
    kept = [F.when(F.col("_new").isNull(), F.col(f"_{c}")).when((F.coalesce(F.col(c).cast("string"), F.lit("")) == "") if c in keep_if_empty else F.lit(False), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in old.columns if c not in keys]
    return x.select(*keys, *kept)


def not_asked(wanted: DataFrame, asked: DataFrame, keys: list[str], struck: DataFrame | None = None) -> DataFrame:
    """Work list: what has not been asked for yet, struck acts first, then the newest."""
    out = wanted.join(asked.select(*keys).distinct(), keys, "left_anti")
    if struck is not None:
        out = out.join(struck.select(*keys).distinct().withColumn("first", F.lit(0)), keys, "left").fillna({"first": 1})
    return out


def forget_failures(asked: DataFrame, kinds: list[str]) -> DataFrame:
    """asked(.., error) without the failures of these kinds, so that they are asked again."""
    return asked.where(F.col("error").isNull() | ~F.col("error").isin(*kinds))


def changes(snapshots: DataFrame, source: str = "source", at: str = "at") -> DataFrame:
    """Of each source's two latest snapshots(source, at, hash, stage, deadline, documents): what changed, and how grave.

    Kinds: first, unchanged, deadline, stage, documents (new ones), content (only the hash differs). Severity: a moved
    deadline or stage is high, new documents medium, else low.
    """
    w = Window.partitionBy(source).orderBy(F.desc(at))
    x = snapshots.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    pair = x.groupBy(source).agg(*(F.max(F.when(F.col("_n") == n, F.struct("hash", "stage", "deadline", "documents"))).alias(name) for n, name in ((1, "now"), (2, "was"))))
    fresh = F.array_except(F.coalesce("now.documents", F.array().cast("array<string>")), F.coalesce("was.documents", F.array().cast("array<string>")))
    kind = F.when(F.col("was").isNull(), "first").when(~F.col("now.deadline").eqNullSafe(F.col("was.deadline")), "deadline").when(~F.col("now.stage").eqNullSafe(F.col("was.stage")), "stage").when(F.size(fresh) > 0, "documents").when(F.col("now.hash") != F.col("was.hash"), "content").otherwise("unchanged")
    severity = F.when(kind.isin("deadline", "stage"), "high").when(kind == "documents", "medium").otherwise("low")
    return pair.select(source, kind.alias("kind"), severity.alias("severity"), F.size(fresh).alias("new_documents"))


def transitions(states: DataFrame, moves: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """states(id, state) after moves(id, to): a move that the table doesn't allow leaves the state and says refused."""
    ok = F.array(*(F.lit(f"{a}>{b}") for a, b in allowed))
    x = states.join(moves.select("id", "to"), "id", "left")
    good = F.array_contains(ok, F.concat("state", F.lit(">"), "to"))
    return x.select("id", F.when(F.col("to").isNotNull() & good, F.col("to")).otherwise(F.col("state")).alias("state"), (F.col("to").isNotNull() & ~good).alias("refused"))


def delta(acts: DataFrame, children: dict[str, DataFrame], since: Column, read_at: str = "read_at", key: str = "act") -> tuple[DataFrame, dict[str, DataFrame]]:
    """The acts read after a position and the rows of their children tables."""
    new = acts.where(F.col(read_at) > since)
    ids = new.select(key).distinct()
    return new, {name: t.join(ids, key, "left_semi") for name, t in children.items()}


def apply_delta(acts: DataFrame, children: dict[str, DataFrame], new: DataFrame, parts: dict[str, DataFrame], key: str = "act", tasks: int | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Replace the delta's acts and all of their children; nothing else is deleted, and twice is once. The result is dealt out
    by key to so many tasks, if given (see tasks_of)."""
    ids = new.select(key).distinct()
    dealt = lambda d: d.repartition(tasks, key) if tasks else d
    return dealt(replaced(acts, new, [key])), {name: dealt(t.join(ids, key, "left_anti").unionByName(parts[name])) for name, t in children.items()}


def position(recorded: DataFrame, acts: DataFrame, read_at: str = "read_at") -> DataFrame:
    """(position): the recorded one, else the latest read_at of all acts."""
    return acts.agg(F.max(read_at).alias("latest")).crossJoin(recorded.agg(F.max("position").alias("kept"))).select(F.coalesce("kept", "latest").alias("position"))  # one row each


def appended(store: DataFrame, new: DataFrame, group: str, content: list[str]) -> DataFrame:
    """Content-addressed append: rows of new whose content the group already has are not added again."""
    n = new.withColumn("hash", content_hash(*(F.col(c) for c in content))).dropDuplicates([group, "hash"])
    return store.unionByName(n.join(store.select(group, "hash"), [group, "hash"], "left_anti"))


def revised(store: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """store(key, revision, ..) with new(key, base_revision, ..) appended as the next revisions; a row whose base isn't the
    latest revision of its key is refused (left out), one of several for one base wins by content."""
    last = store.groupBy(key).agg(F.max("revision").alias("last"))
    x = new.join(last, key, "left").where(F.col("base_revision") == F.coalesce("last", F.lit(0)))
    x = x.withColumn("revision", (F.coalesce("last", F.lit(0)) + 1).cast(store.schema["revision"].dataType)).select(*store.columns)
    return store.unionByName(newest(x, [key], [c for c in store.columns if c not in (key, "revision")], first=True))


def revisions(store: DataFrame, key: str, value) -> DataFrame:
    return store.where(F.col(key) == value).orderBy("revision")


def append_only(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of before that after no longer has: none if the table was only appended to."""
    return before.exceptAll(after)


def captured(report: DataFrame, provisions: DataFrame) -> DataFrame:
    """(report, act, locator, hash): what a report(report, act, locator) relied on, as it was."""
    return report.join(provisions, ["act", "locator"]).select("report", "act", "locator", content_hash(F.col("text")).alias("hash"))


def verified(captures: DataFrame, provisions: DataFrame) -> DataFrame:
    """captures with now: unchanged, changed, or unavailable where the provision is gone."""
    p = provisions.select("act", "locator", content_hash(F.col("text")).alias("_h"))
    return captures.join(p, ["act", "locator"], "left").select("report", "act", "locator", F.when(F.col("_h").isNull(), "unavailable").when(F.col("_h") == F.col("hash"), "unchanged").otherwise("changed").alias("now"))


def open_findings(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """findings(report, finding) with their latest review(report, finding, seq, state); none means open."""
    last = reviews.groupBy("report", "finding").agg(F.max_by("state", "seq").alias("state"))
    return findings.join(last, ["report", "finding"], "left").withColumn("state", F.coalesce("state", F.lit("open")))


def follow_list(follows: DataFrame, lifecycle: DataFrame, attention: DataFrame, cap: int) -> DataFrame:
    """The newest follows(id, at) with stage and attention, at most `cap`; truncated says that there were more."""
    top = follows.orderBy(F.desc("at"), "id").limit(cap + 1)
    at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("at"), "id"))  # cap + 1 rows
    x = top.withColumn("n", at).withColumn("all", F.count("*").over(Window.partitionBy(F.lit(1))))
    return x.where(F.col("n") <= cap).join(lifecycle, "id", "left").join(attention, "id", "left").select("id", "at", "stage", F.coalesce("attention", F.lit("none")).alias("attention"), (F.col("all") > cap).alias("truncated"))
