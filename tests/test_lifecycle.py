"""Odd rows of the lifecycle operators, and work that is done once."""

from pyspark.sql import functions as F

from lexarium.operators import lifecycle
from lexarium.sources.store import Store


def test_statuses_and_dead_stages(spark):
    d = spark.createDataFrame([("Trimis la  COMISIE",), ("Respins definitiv",), (None,), ("",)], "s string")
    got = d.select(lifecycle.canonical_status(F.col("s"), {"trimis la comisie": "committee"}, "unknown"), lifecycle.live(F.col("s"), ["respins", "retras"])).collect()
    assert [tuple(r) for r in got] == [("committee", True), ("unknown", False), ("unknown", True), ("unknown", True)]


def test_snapshots_say_only_what_is_new(spark):
    rows = [("a", 1, "x", None, ["d1"]), ("a", 2, "x", None, ["d1", "d2"]), ("a", 3, None, "2024", None), ("a", 4, None, "2024", ["d2"]), ("b", 1, None, None, None)]
    got = lifecycle.snapshot_events(spark.createDataFrame(rows, "source string, at int, stage string, deadline string, documents array<string>")).collect()
    assert sorted(map(str, ((r["source"], r["at"], r["kind"], r["value"]) for r in got))) == sorted(
        map(str, [("a", 1, "opened", "x"), ("a", 1, "document", "d1"), ("a", 2, "document", "d2"), ("a", 3, "stage", None), ("a", 3, "deadline", "2024"), ("a", 4, "document", "d2"), ("b", 1, "opened", None)])
    )


def test_examined_inputs_are_not_examined_again_even_after_a_failure(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path)), []

    def examine(d):
        seen.append(sorted(r["k"] for r in d.collect()))
        if len(seen) == 2:
            raise ConnectionError
        return d.withColumn("r", F.col("k") * 2)

    rows = lambda *k: spark.createDataFrame([(i,) for i in k], "k long")
    assert lifecycle.examine_once(store, rows(1, 2), "k", examine, "out")
    try:
        lifecycle.examine_once(store, rows(1, 2, 3), "k", examine, "out")
    except ConnectionError:
        pass
    assert lifecycle.examine_once(store, rows(1, 2, 3), "k", examine, "out") and not lifecycle.examine_once(store, rows(2, 3), "k", examine, "out")
    assert seen == [[1, 2], [3], [3]] and sorted(r["r"] for r in store.read("out").collect()) == [2, 4, 6]


def test_notes_are_made_once(spark):
    e = spark.createDataFrame([(1, 10, "2024-01-01", "open"), (1, 11, None, "vote")], "project long, event long, at string, stage string")
    none = spark.createDataFrame([], "note string, project long, event long, text string")
    once = lifecycle.notes_of(e, none, e.select("event"))
    assert sorted(r["text"] for r in once.collect()) == ["2024-01-01: open", "vote"] and lifecycle.notes_of(e, once, e.select("event")).count() == 2
