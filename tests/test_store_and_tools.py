"""The store's writes, tracker events, syncs, and the named tools over a store."""

import pytest
from pyspark.sql import functions as F

from lexarium import tools
from lexarium.operators import search, tracker
from lexarium.sources.store import Store


def test_acts_are_replaced_with_all_their_children(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    acts = spark.createDataFrame([("a", "old"), ("b", "x")], "act string, v string")
    s.put_acts(acts, {"provisions": spark.createDataFrame([("a", "art1"), ("a", "art2"), ("b", "art1")], "act string, locator string")})
    new = spark.createDataFrame([("a", "new")], "act string, v string")
    for _ in range(2):
        s.put_acts(new, {"provisions": spark.createDataFrame([("a", "art9")], "act string, locator string")})
    assert {tuple(r) for r in s.read("acts").collect()} == {("a", "new"), ("b", "x")}
    assert {tuple(r) for r in s.read("provisions").collect()} == {("a", "art9"), ("b", "art1")}
    with pytest.raises(ValueError):
        s.put_acts(new, {"provisions": spark.createDataFrame([("z", "art1")], "act string, locator string")})
    with pytest.raises(ValueError):
        s.put_acts(new.union(new), {})
    m = s.cut(["acts", "provisions"], str(tmp_path / "cut"), "r1", {"acts": "act"})
    assert {(r["name"], r["n"]) for r in m.collect()} == {("acts", 2), ("provisions", 2)}
    assert s.publish(str(tmp_path / "pub"), {"acts": ["act"]}, "r1").collect()[0]["n"] == 2 and spark.read.parquet(str(tmp_path / "pub/acts")).columns == ["act"]


def test_add_once_keeps_what_is_there(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for rows in ([(1, "a")], [(1, "b"), (2, "c"), (2, "d")]):
        s.add_once("t", spark.createDataFrame(rows, "k int, v string"), ["k"])
    assert {tuple(r) for r in s.read("t").collect()} == {(1, "a"), (2, "c")}


def test_typed_events_are_ordered_and_told_once(spark):
    shape = "project string, source string, occurred date, title string"
    rows = lambda *r: spark.createDataFrame(r, shape)
    day = __import__("datetime").date(2024, 1, 2)
    e = tracker.typed_events({"stage": rows(("p", "s", day, "sent"), ("p", "s", day, "sent")), "vote": rows(("p", "s", day, "adopted"), ("p", "s", None, "later"))}, "chamber")
    assert [r["title"] for r in e.orderBy("place").collect()] == ["sent", "adopted", "later"]


def test_gazette_rows_are_reconciled(spark):
    shape = "act string, issue int, day string"
    stored = spark.createDataFrame([("a", 1, "2020-01-01"), ("b", None, "2020-01-01"), ("c", 3, None), ("d", 4, "2020-01-01")], shape)
    parsed = spark.createDataFrame([("a", 1, "2020-01-01"), ("b", 2, "2020-01-02"), ("c", 9, "2020-01-01")], shape)
    found = tracker.reconciled(stored, parsed)
    assert {r["act"]: r["issues"] for r in found.collect()} == {"a": [], "b": ["issue_missing", "day_differs"], "c": ["issue_differs", "day_missing"], "d": ["not_parsed"]}
    assert {r["issue"]: r["n"] for r in tracker.reconciliation_report(found).collect()}["not_parsed"] == 1
    events = tracker.gazette_events(spark.createDataFrame([("a", 1, "2020-01-01", "I"), ("b", None, None, None)], shape + ", part string"))
    assert [r["title"] for r in events.collect()] == ["M.Of. P. I 1 2020-01-01"]


def test_syncs_and_snapshot_contracts(spark):
    reg = spark.createDataFrame([("a", None, "new"), ("b", "h", "current"), ("c", "h", "current"), ("d", "h", "x"), ("e", "h", "current")], "source string, hash string, state string")
    got = spark.createDataFrame([("a", "1", None), ("b", "h", None), ("c", "2", None), ("e", None, "http 500")], "source string, hash string, error string")
    assert {r["source"]: (r["hash"], r["state"], r["outcome"]) for r in tracker.synced(reg, got).collect()} == {"a": ("1", "current", "first"), "b": ("h", "current", "unchanged"), "c": ("2", "needs_review", "changed"), "d": ("h", "x", "not_fetched"), "e": ("h", "failed", "failed")}
    s = spark.createDataFrame([("a", "t", "x", "0"), (" ", "t", "x", "0"), ("b", None, "x", "0"), ("c", "t", "", "0")], "source string, captured string, payload string, sha256 string")
    ok = spark.createDataFrame([("d", "t", "x")], "source string, captured string, payload string").withColumn("sha256", F.sha2("payload", 256))
    assert {r["reason"] for r in tracker.invalid_snapshots(s.unionByName(ok)).collect()} == {"hash_differs", "no_source", "no_time", "no_payload"}


def test_tools_by_name(spark, tmp_path):
    s, path = Store(spark, str(tmp_path)), str(tmp_path)
    assert {r["present"] for r in tools.call(spark, path, "source_status").collect()} == {"missing"}
    s.write("projects", spark.createDataFrame([("p1", "Lege_a apelor"), ("p2", "Codul 100%")], "project string, title string"))
    s.write("events", spark.createDataFrame([("p1", 2, "b"), ("p1", 1, "a"), ("p2", 1, "c")], "project string, at int, event string"))
    s.write("notes", spark.createDataFrame([("p1", "n")], "project string, note string"))
    s.write("sources", spark.createDataFrame([("p1", "s")], "project string, source string"))
    search.build_index(spark.createDataFrame([(1, "legea apelor curate", "lege", 2001), (2, "ordin despre ape si apelor", "ordin", 2010)], "doc_id long, text string, kind string, year int"), f"{path}/index", keep=("kind", "year"))
    assert [r["doc"] for r in tools.call(spark, path, "search_laws", {"query": "Apelor", "kind": "ordin"}).collect()] == [2]
    assert [r["project"] for r in tools.call(spark, path, "search_projects", {"query": "0%"}).collect()] == ["p2"]
    assert [r["event"] for r in tools.call(spark, path, "project_timeline", {"project": "p1", "limit": 900}).collect()] == ["a", "b"]
    assert tools.call(spark, path, "evidence_bundle", {"project": "p1"}).collect()[0]["events"] == "b|a"
    for name, args in (("nothing", {}), ("search_laws", {"query": "a"}), ("project_timeline", {"sql": "x"})):
        with pytest.raises((ValueError, TypeError)):
            tools.call(spark, path, name, args)
