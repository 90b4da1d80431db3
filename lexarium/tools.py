"""Named queries with bounded arguments over a store, for callers that only know names and plain values."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import reports, search
from .sources.store import Store

#: Rows that one call gives at most.
MOST = 50


def _bounded(limit: int | None, default: int = 20) -> int:
    return max(1, min(int(default if limit is None else limit), MOST))


def search_laws(spark: SparkSession, store: str, query: str, kind: str | None = None, from_year: int | None = None, to_year: int | None = None, limit: int | None = None) -> DataFrame:
    """Acts by BM25 from the written index, under the conditions given."""
    terms = search.words_of(query)
    if not terms:
        raise ValueError("the query has no word of three letters")
    return search.indexed_search(spark, f"{store}/index", terms, _bounded(limit), equal={"kind": kind} if kind else None, at_least={"year": from_year} if from_year else None, at_most={"year": to_year} if to_year else None)


def search_projects(spark: SparkSession, store: str, query: str, limit: int | None = None) -> DataFrame:
    t = Store(spark, store).read("projects")
    return reports.filtered(t, said=(query, ["project", "title"])).orderBy("project").limit(_bounded(limit))


def project_timeline(spark: SparkSession, store: str, project: str, limit: int | None = None) -> DataFrame:
    return Store(spark, store).read("events").where(F.col("project") == project).orderBy(F.asc_nulls_last("at"), "event").limit(_bounded(limit, MOST))


def evidence_bundle(spark: SparkSession, store: str, project: str) -> DataFrame:
    s = Store(spark, store)
    one = s.read("projects").where(F.col("project") == project).select("project")
    return reports.evidence_pack(one, s.read("events"), s.read("notes"), s.read("sources"))


def source_status(spark: SparkSession, store: str) -> DataFrame:
    """(name, present) of the tables, and `all`: ok, partial or missing."""
    s = Store(spark, store)
    there = [(n, "ok" if s.has(n) else "missing") for n in ("projects", "events", "notes", "sources")]
    states = {v for _, v in there}
    return spark.createDataFrame([*there, ("all", states.pop() if len(states) == 1 else "partial")], "name string, present string")


TOOLS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (search_laws, search_projects, project_timeline, evidence_bundle, source_status)}


def call(spark: SparkSession, store: str, name: str, arguments: dict[str, Any] | None = None) -> DataFrame:
    """Run a tool by name; unknown names and arguments are refused."""
    if name not in TOOLS:
        raise ValueError(f"no tool named {name}")
    known = TOOLS[name].__code__.co_varnames[2 : TOOLS[name].__code__.co_argcount]
    if extra := set(arguments or {}) - set(known):
        raise ValueError(f"unknown arguments: {', '.join(sorted(extra))}")
    return TOOLS[name](spark, store, **(arguments or {}))
