"""The written index, streams, readers of files, and operators that need a folder or several tables."""

import numpy as np
from pyspark.sql import functions as F

from lexarium.operators import graph, search, similarity, state
from lexarium.sources import files
from lexarium.streaming import upsert

SF = "/root/testdata/sf0.001"
TERMS = ["thtion", "erhe", "heand"]


def test_a_written_index_ranks_like_a_scan(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = str(tmp_path / "index")
    search.build_index(docs, path, keep=("lang", "n_chars"))
    for kw in ({}, {"equal": {"lang": "en"}}, {"at_least": {"n_chars": 800}, "at_most": {"n_chars": 5000}}):
        scan = [(r["doc"], r["score"]) for r in search.bm25_search(docs, TERMS, **kw).collect()]
        got = search.indexed_search(spark, path, TERMS, **kw).collect()
        found = sorted(((r["doc"], r["score"]) for r in got), key=lambda x: (-x[1], x[0]))
        assert [d for d, _ in found] == [d for d, _ in scan] and np.allclose([s for _, s in found], [s for _, s in scan], atol=2e-6)
        assert [(r["doc"], r["score"]) for r in search.coverage_search(docs, TERMS, 20, **kw).collect()] == [(r["doc"], r["score"]) for r in search.indexed_search(spark, path, TERMS, bm25=False, **kw).collect()]
    by_prefix = search.indexed_postings(spark, path, ["hea"], prefixes=True).select("token").distinct().collect()
    assert len(by_prefix) > 1 and all(r["token"].startswith("hea") for r in by_prefix)
    plan = search.indexed_postings(spark, path, TERMS)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(token" in plan
    plan = search.indexed_postings(spark, path, ["hea"], prefixes=True)._jdf.queryExecution().toString()
    assert "StringStartsWith(token" in plan


def test_an_index_can_leave_out_frequent_tokens(spark, tmp_path):
    d = spark.createDataFrame([(i, f"common word{i}") for i in range(10)], "doc_id long, text string")
    search.build_index(d, str(tmp_path / "i"), cut=0.4)
    assert search.indexed_search(spark, str(tmp_path / "i"), ["common"]).count() == 0
    assert [r["doc"] for r in search.indexed_search(spark, str(tmp_path / "i"), ["word3"]).collect()] == [3]


def test_a_stream_keeps_the_newest_row_of_each_key(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    shape = "k string, at int, v string"
    for batch in ([("a", 1, "x"), ("b", 1, "y"), ("a", 3, "z")], [("a", 2, "late"), ("c", 1, "w"), ("b", 5, "u")]):
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").json(str(source))
        upsert.upsert_stream(spark.readStream.schema(shape).json(str(source)), target, ["k"], ["at"], str(tmp_path / "cp")).awaitTermination()
    assert {(r["k"], r["v"]) for r in upsert.current(spark, target, 5).collect()} == {("a", "z"), ("b", "u"), ("c", "w")}


def test_streamed_windows_count_late_events(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "e"), ("2024-01-01 00:01:10", "e"), ("2024-01-01 00:00:50", "e")]
    spark.createDataFrame(rows, "at string, kind string").coalesce(1).write.json(str(tmp_path / "in"))
    events = spark.readStream.schema("at timestamp, kind string").json(str(tmp_path / "in"))
    counts = upsert.windowed_counts(upsert.first_seen(events, ["at"], "at", "1 hour").select("at", "kind"), "kind", "at", "1 minute", "1 hour")
    assert set(counts.columns) == {"start", "kind", "n"} and counts.isStreaming
    batch = upsert.windowed_counts(spark.read.schema("at timestamp, kind string").json(str(tmp_path / "in")), "kind", "at", "1 minute", "1 hour")
    assert sorted(r["n"] for r in batch.collect()) == [1, 2]


def test_a_manifest_tells_what_changed(spark, tmp_path):
    for name, text in (("a.md", "x"), ("b.txt", "one")):
        (tmp_path / name).write_text(text)
    made = spark.createDataFrame(files.manifest(spark, str(tmp_path)).collect(), "path string, length long, sha256 string")
    assert files.verify(made, spark, str(tmp_path)).count() == 0
    (tmp_path / "b.txt").write_text("other")
    (tmp_path / "e.txt").write_text("new")
    (tmp_path / "a.md").unlink()
    assert {(r["path"], r["problem"]) for r in files.verify(made, spark, str(tmp_path)).collect()} == {("a.md", "missing"), ("b.txt", "changed"), ("e.txt", "unknown")}


def test_edges_of_operations_and_citations(spark):
    ops = spark.createDataFrame([("lege-1", "art1", "lege-98", "art5", "abroga"), ("lege-1", "art3", "lege-1", "art1", "modifica")], "source string, source_locator string, act string, locator string, kind string")
    refs = spark.createDataFrame([("lege-1", "art2", "lege-98", ""), ("lege-1", "art2", "cod", ""), ("hg-2", "art1", "hg-2", "art2"), ("hg-2", "art1", "lege-5", ""), ("hg-2", "art1", None, "")], "source string, source_locator string, act string, locator string")
    since = spark.createDataFrame([("lege-1", "2020-01-01")], "source string, since string")
    e = graph.edges_of(since, ops, refs)
    assert {(r["source"], r["target"], r["locator"], r["kind"], r["since"]) for r in e.collect()} == {("lege-1", "lege-98", "art5", "abroga", "2020-01-01"), ("lege-1", "cod", "", "refera", "2020-01-01"), ("hg-2", "lege-5", "", "refera", None)}


def test_symmetric_overlap(spark):
    u = spark.createDataFrame([(1, "u", "abcdefgh")], "key int, unit string, text string")
    b = spark.createDataFrame([(1, "n", "abcdefgx")], "key int, norm string, text string")
    assert [r["jaccard"] for r in similarity.symmetric(u, b).collect()] == [0.6]


def test_title_ranking_and_merged_hits(spark):
    hits = spark.createDataFrame([("a", 1, 5), ("b", 2, 1), ("c", 1, 5)], "act string, title_hits int, body_hits int")
    acts = spark.createDataFrame([("a", 3, 9, "long title"), ("b", 9, 0, "t"), ("c", 1, 0, "t")], "act string, rank int, citations int, title string")
    assert [r["act"] for r in search.title_ranking(hits, acts, 3).collect()] == ["b", "c", "a"]
    exact, text = spark.createDataFrame([("x", 1.0)], "k string, score double"), spark.createDataFrame([("x", 9.0), ("y", 2.0), ("z", 3.0)], "k string, score double")
    assert [(r["k"], r["tier"]) for r in search.merged_hits(exact, text, ["k"], 3).collect()] == [("x", 0), ("z", 1), ("y", 1)]


def test_a_plan_leaves_the_sessions_views_alone(spark):
    from lexarium.plans import registry

    spark.range(3).createOrReplaceTempView("part")
    registry.queries()["inventory_metrics"](spark, SF).collect()
    assert spark.table("part").columns == ["id"]
    spark.catalog.dropTempView("part")


def test_applying_a_delta_twice_is_applying_it_once(spark):
    acts = spark.createDataFrame([("a", 1, "old"), ("b", 2, "new"), ("c", 3, "new")], "act string, read_at int, v string")
    parts = {"p": spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2")], "act string, n string")}
    new, own = state.delta(acts, parts, F.lit(1))
    at = (spark.createDataFrame([("b", 1, "x"), ("z", 0, "keep")], acts.schema), {"p": spark.createDataFrame([("b", "9"), ("z", "1")], "act string, n string")})
    once = state.apply_delta(*at, new, own)
    twice = state.apply_delta(*once, new, own)
    for t in (once, twice):
        assert {tuple(r) for r in t[0].collect()} == {("b", 2, "new"), ("c", 3, "new"), ("z", 0, "keep")}
        assert {tuple(r) for r in t[1]["p"].collect()} == {("b", "1"), ("b", "2"), ("z", "1")}
