"""Events of projects from what sources say: typed rows, their upsert key, gazette reconciliation, source syncs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash

#: Columns that tell one event from another.
KEY = ("event_type", "project", "family", "source", "occurred", "content")
#: Kinds of rows in the order that events of one day are told.
ORDER = ("stage", "opinion", "vote")


def typed_events(kinds: dict[str, DataFrame], family: str) -> DataFrame:
    """Events (KEY, title, place) from tables (project, source, occurred, title) by kind; place orders a project's events by
    day, kind and title."""
    rows = [t.select(F.lit(k).alias("event_type"), "project", F.lit(family).alias("family"), "source", "occurred", "title", F.lit(ORDER.index(k)).alias("k")) for k, t in kinds.items()]
    e = reduce(DataFrame.unionAll, rows).withColumn("content", content_hash(F.col("title"), F.col("occurred").cast("string")))
    e = e.dropDuplicates(list(KEY))
    return e.withColumn("place", F.concat_ws(":", F.coalesce(F.col("occurred").cast("string"), F.lit("9999")), "k", "title")).drop("k")


def gazette_events(acts: DataFrame) -> DataFrame:
    """acts(act, issue, day, part) that state a publication -> events with the reference and its hash."""
    said = F.concat_ws(" ", F.lit("M.Of."), F.when(F.col("part").isNotNull(), F.concat(F.lit("P. "), "part")), F.col("issue").cast("string"), F.col("day").cast("string"))
    return acts.where("issue is not null and day is not null").select(F.lit("publication").alias("event_type"), F.col("act").alias("project"), F.lit("gazette").alias("family"), F.col("act").alias("source"), F.col("day").alias("occurred"), content_hash(said).alias("content"), said.alias("title"))


def reconciled(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """(act, issues): how stored(act, issue, day) and parsed(act, issue, day) of an act's publication disagree."""
    p = parsed.select("act", F.col("issue").alias("_i"), F.col("day").alias("_d"))
    x = stored.join(p, "act", "left")
    issue: list[Column] = [
        F.when(F.col("_i").isNull() & F.col("_d").isNull(), "not_parsed"),
        F.when(F.col("issue").isNull() & F.col("_i").isNotNull(), "issue_missing"),
        F.when(F.col("issue") != F.col("_i"), "issue_differs"),
        F.when(F.col("day").isNull() & F.col("_d").isNotNull(), "day_missing"),
        F.when(F.col("day") != F.col("_d"), "day_differs"),
    ]
    return x.select("act", F.filter(F.array(*issue), lambda v: v.isNotNull()).alias("issues"))


def reconciliation_report(found: DataFrame) -> DataFrame:
    return found.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def synced(registry: DataFrame, fetched: DataFrame) -> DataFrame:
    """registry(source, hash, state) after fetched(source, hash, error): outcome first, unchanged, changed or failed, and the
    state that follows; sources that weren't fetched stay."""
    f = fetched.select("source", F.col("hash").alias("_h"), F.col("error").alias("_e"), F.lit(True).alias("_f"))
    x = registry.join(f, "source", "left")
    outcome = F.when(F.col("_f").isNull(), "not_fetched").when(F.col("_e").isNotNull(), "failed").when(F.col("hash").isNull(), "first").when(F.col("hash") == F.col("_h"), "unchanged").otherwise("changed")
    state = F.when(outcome == "failed", "failed").when(outcome.isin("first", "unchanged"), "current").when(outcome == "changed", "needs_review").otherwise(F.col("state"))
    return x.select("source", F.when(outcome.isin("first", "changed"), F.col("_h")).otherwise(F.col("hash")).alias("hash"), state.alias("state"), outcome.alias("outcome"))


def invalid_snapshots(snapshots: DataFrame) -> DataFrame:
    """snapshots(source, captured, payload, sha256) that break the contract, with the first reason."""
    why = F.when(F.coalesce(F.trim("source"), F.lit("")) == "", "no_source").when(F.col("captured").isNull(), "no_time").when(F.coalesce(F.length("payload"), F.lit(0)) == 0, "no_payload").when(F.sha2("payload", 256) != F.col("sha256"), "hash_differs")
    return snapshots.withColumn("reason", why).where("reason is not null")
