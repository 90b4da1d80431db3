"""Commits, the segmented index, paged sources, kept-up tables and top-k joins."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexarium.operators import candidates, search, upkeep
from lexarium.operators.segments import SegmentedIndex
from lexarium.sources import paged
from lexarium.sources.commits import Commits, Stale
from lexarium.sources.store import Store

SF = "/root/testdata/sf0.001"
TERMS = ["thtion", "erhe", "heand"]


# ------------------------------------------------------------------ commits
def test_a_stale_writer_is_refused_and_readers_keep_their_state(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write("t", spark.range(3))
    old = s.transaction()
    with s.transaction() as t:
        t.write("t", spark.range(5))
    assert old.read("t").count() == 3 and s.read("t").count() == 5
    with pytest.raises(Stale), old:
        old.write("t", spark.range(1))
    assert s.read("t").count() == 5


def test_a_failure_between_two_tables_leaves_the_old_state(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    with s.transaction() as t:
        t.write("a", spark.range(1))
        t.write("b", spark.range(1))
    with pytest.raises(ZeroDivisionError), s.transaction() as t:
        t.write("a", spark.range(2))
        1 / 0  # noqa: B018
    assert s.read("a").count() == 1
    with s.transaction() as t:
        t.append("a", spark.range(2))
        assert t.read("a").count() == 3 and s.read("a").count() == 1
    assert (s.read("a").count(), s.read("b").count()) == (3, 1)


def test_an_unfinished_commit_is_passed_over(spark, tmp_path):
    c = Commits(spark, str(tmp_path))
    first = c.commit(c.latest(), {"t": [c.stage("t", spark.range(2))]}, {"v": 1})
    (tmp_path / "_commits" / f"{first.number + 1:012d}").write_text('{"tables": {"t"')
    assert c.latest() == first
    second = c.commit(first, {"u": [c.stage("u", spark.range(1))]})
    assert second.number == first.number + 2 and set(second.tables) == {"t", "u"} and second.facts == {"v": 1} and c.at(first.number) == first


def test_expired_folders_go_and_the_rest_stays(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for n in (1, 2, 3):
        s.write("t", spark.range(n))
    s.write("u", spark.range(9))
    staged = s.commits.stage("t", spark.range(7))  # not committed
    assert s.commits.expire(1, hours=1) == [] and len(s.commits.expire(1, hours=0)) == 3
    assert s.read("t").count() == 3 and s.read("u").count() == 9 and not (tmp_path / staged).exists() and s.commits.expire(1, hours=0) == []
    s.write("t", spark.range(4))
    assert s.read("t").count() == 4


def test_snapshots_replayed_twice_count_once(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 3)], "snapshot string, v int")
    one = rows.where("snapshot = 's1'").select("snapshot").distinct()
    assert [s.replay(one, {"t": rows}), s.replay(one, {"t": rows}), s.replay(rows.select("snapshot").distinct(), {"t": rows})] == [True, False, True]
    assert sorted(r["v"] for r in s.read("t").collect()) == [1, 2, 3]


# ------------------------------------------------------------------ segments
def hits(df):
    return [(r["doc"], r["score"]) for r in df.orderBy(F.desc("score"), "doc").collect()]


def close(a, b):
    return [d for d, _ in a] == [d for d, _ in b] and all(abs(x - y) < 3e-6 for (_, x), (_, y) in zip(a, b, strict=True))


def test_replaced_and_deleted_documents_rank_as_in_a_new_index(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    index = SegmentedIndex(spark, str(tmp_path / "i"), keep=("lang",))
    index.put(docs)
    now = docs
    for i in range(3):
        new = docs.where(F.col("doc_id") % 20 == i).withColumn("text", F.concat_ws(" ", F.lit("erhe heand " * i), "text")).unionByName(spark.createDataFrame([(10_000 + i, "thtion erhe", "xx")], docs.schema))
        index.put(new)
        index.delete(docs.where(F.col("doc_id") % 20 == 10 + i).select("doc_id"))
        now = now.join(new.select("doc_id"), "doc_id", "left_anti").where(F.col("doc_id") % 20 != 10 + i).unionByName(new)
    want = hits(search.bm25_search(now, TERMS, 30))
    state = index.commits.latest()
    assert len(state.facts["segments"]) == 4 and close(hits(index.search(TERMS, 30).rows), want)
    sizes = [s["n"] for s in state.facts["segments"].values()]
    assert max(sizes[1:]) < sizes[0] / 10  # a replacement writes its own documents only
    assert index.sizes(state)[0] == now.count() == index.live().count()
    f = {r["token"]: r["n"] for r in index.frequencies(terms=TERMS).collect()}
    assert f == {r["token"]: r["n"] for r in search.postings(now).where(F.col("token").isin(*TERMS)).groupBy("token").agg(F.countDistinct("doc").alias("n")).collect()}
    index.merge(2)
    assert len(index.commits.latest().facts["segments"]) == 2 and close(hits(index.search(TERMS, 30).rows), want)
    index.merge(1)
    last = index.commits.latest()
    assert len(last.facts["segments"]) == 1 and next(iter(last.facts["segments"].values()))["dead"] == 0 and close(hits(index.search(TERMS, 30).rows), want)
    assert index.hydrate(index.search(TERMS, 3).rows).columns == ["doc", "score", "lang"]
    cover = [(r["doc"], r["score"]) for r in index.coverage(TERMS, 30).collect()]
    assert cover == [(r["doc"], r["score"]) for r in search.coverage_search(now, TERMS, 30).collect()]


def test_most_blocks_of_a_frequent_term_stay_unread(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(["common"] * rng.randint(1, 2) + [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 300))] + ["rare"] * (i % 997 == 0))) for i in range(12_000)]
    index = SegmentedIndex(spark, str(tmp_path))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index.put(docs)
    for terms in (["common"], ["common", "rare"]):
        got = index.search(terms, 10)
        assert got.read < 0.35 * got.blocks and close(hits(got.rows), hits(search.bm25_search(docs, terms, 10)))


def test_searches_without_hits(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path))
    assert index.search(["one"]).rows.count() == 0
    index.put(spark.createDataFrame([(1, None), (2, ""), (3, "one two")], "doc_id long, text string"))
    assert [r["doc"] for r in index.search(["one", "none"]).rows.collect()] == [3] and index.search([]).rows.count() == 0
    index.delete(spark.createDataFrame([(3,), (9,)], "doc_id long"))
    assert index.search(["one"]).rows.count() == 0 and index.sizes(index.commits.latest()) == (2, 0)


def test_candidates_are_the_best_of_all_documents(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 300:03d}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(300)]
    drafts = [(i, " ".join(word() for _ in range(rng.randint(0, 20)))) for i in range(25)] + [(99, None)]
    index = SegmentedIndex(spark, str(tmp_path))
    index.put(spark.createDataFrame(docs, "doc_id long, text string"))
    index.delete(spark.createDataFrame([(0,), (7,)], "doc_id long"))
    sets = {i: set(t.split()) for i, t in docs if i not in (0, 7)}
    from math import floor, log

    df = {}
    for s in sets.values():
        for w in s:
            df[w] = df.get(w, 0) + 1
    weigh = {w: floor(1000 * log(len(sets) / n)) for w, n in df.items() if n <= 0.3 * len(sets)}
    want = []
    for q, t in drafts:
        scores = sorted((-sum(weigh.get(w, 0) for w in set((t or "").split()) & s), i) for i, s in sets.items())
        want += [(q, at, i, -s) for at, (s, i) in enumerate([x for x in scores if x[0] < 0][:5], 1)]
    got = candidates.candidates(index, spark.createDataFrame(drafts, "draft long, text string"), 5, 0.3).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


# ------------------------------------------------------------------ paged sources
@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 100])
@pytest.mark.parametrize("known", [0, 1, 5])
def test_the_end_is_found_in_few_questions(n, known):
    asked = []
    n = max(n, known)
    assert paged.find_end(lambda i: asked.append(i) or i < n, known) == n and len(asked) <= 2 * max(n - known, 1).bit_length() + 2


def asked(log):
    return [int(x) for x in Path(log).read_text().split()] if Path(log).exists() else []


def test_a_broken_crawl_asks_no_page_twice(spark, tmp_path):
    log = str(tmp_path / "log")

    def fetch(number, options):
        """Notes what it is asked, and breaks the first time at page 6."""
        with open(log, "a") as f:
            f.write(f"{number}\n")
        if number == 6 and not Path(log + ".broke").exists():
            Path(log + ".broke").touch()
            raise ConnectionError("line lost at 6")
        return [json.dumps({"id": i}) for i in range(number * 3, min(number * 3 + 3, 29))]

    spark.dataSource.register(paged.source(fetch, "counted"))
    load = lambda **more: spark.read.format("counted").options(kept=str(tmp_path / "kept"), pagesPerTask=4, **more).load()
    with pytest.raises(Exception, match="line lost at 6"):
        load(last=9).count()
    assert load(last=9).count() == 29
    seen = asked(log)
    assert sorted(set(seen)) == list(range(10)) and all(seen.count(i) == 1 for i in range(10) if i != 6) and seen.count(6) == 2
    assert load().count() == 29 and set(asked(log)[len(seen) :]) <= set(range(10, 32))  # the search for the end asks beyond it only
    assert load(first=8).count() == 5


def test_tokens_are_renewed_once(monkeypatch):
    given, calls = iter("ab"), []

    def fetch(n, options, token):
        calls.append((n, token))
        if token == "a" and n == 2:
            raise paged.Expired
        return [str(n)]

    ask = paged.with_token(fetch, lambda: next(given))
    assert [ask(n, {}) for n in (1, 2, 3)] == [["1"], ["2"], ["3"]] and calls == [(1, "a"), (2, "a"), (2, "b"), (3, "b")]


# ------------------------------------------------------------------ kept-up tables
def test_upkeep_equals_a_rebuild_and_reads_touched_buckets_only(spark, tmp_path):
    rng = random.Random(4)
    shape = "source string, target string, locator string, kind string, since string"
    make = lambda c: [(c, f"p{rng.randint(0, 30)}", rng.choice(["", "art1"]), rng.choice(["refera", "abroga"]), rng.choice([None, "1999-01-01", "2001-01-01"])) for _ in range(rng.randint(0, 6))]
    acts = {f"c{i}": make(f"c{i}") for i in range(40)}
    frame = lambda rows: spark.createDataFrame(rows, shape).withColumn("since", F.col("since").cast("date"))
    named = lambda some: spark.createDataFrame([(c,) for c in some], "source string")
    keeper = upkeep.EdgeUpkeep(spark, str(tmp_path), 8)
    keeper.replace(named(acts), frame([e for rows in acts.values() for e in rows]))
    for some in (["c1", "c2"], ["c3"], ["c1", "c99"]):
        acts |= {c: make(c) for c in some}
        keeper.replace(named(some), frame([e for c in some for e in acts[c]]))
    whole = upkeep.known(upkeep.counted(frame([e for rows in acts.values() for e in rows])))
    assert sorted(map(tuple, keeper.known().select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    before = keeper.commits.latest()
    assert keeper.replace(named(["c3"]), frame(acts["c3"])) == before  # nothing changed, nothing is written
    acts["c3"] = [("c3", "p1", "", "abroga", "2020-01-01")]
    touched = {t for _, t, *_ in acts["c3"]} | {r["target"] for r in spark.read.parquet(*(f"{tmp_path}/{f}" for k, v in before.tables.items() if k.startswith("by_source/") for f in v)).where("source = 'c3'").collect()}
    after = keeper.replace(named(["c3"]), frame(acts["c3"]))
    changed = {k for k in after.tables if after.tables[k] != before.tables.get(k)}
    buckets = {f"known/{i}" for i in keeper._names(spark.createDataFrame([(t,) for t in touched], "target string"), "target")}
    assert {k for k in changed if k.startswith("known/")} == buckets and len([k for k in changed if k.startswith("by_source/")]) == 1
    assert [r["target"] for r in keeper.known(["p1"]).collect()] == ["p1"]


# ------------------------------------------------------------------ source states
def test_source_states_do_not_depend_on_batches_and_survive_restarts(spark, tmp_path):
    from datetime import datetime, timedelta

    from lexarium.streaming import sync

    for k, v in sync.PROVIDER.items():
        spark.conf.set(k, v)
    day = lambda d, h=0: datetime(2024, 1, d, h)
    rows = [("a", day(1), 1, "new"), ("b", day(1), 2, "new"), ("a", day(1, 5), 3, "read"), ("a", day(2), 4, "new"), ("b", day(5), 5, "read"), ("a", day(5, 1), 6, "done"), ("c", day(9), 7, "new")]
    allowed, runs = [("new", "read"), ("read", "done"), ("timed_out", "read")], {}
    for name, cuts in (("one", [7]), ("three", [3, 5, 7])):
        folder, out, at = str(tmp_path / name / "in"), str(tmp_path / name / "out"), 0
        for to in cuts:
            spark.createDataFrame(rows[at:to], "source string, at timestamp, event long, to string").coalesce(1).write.mode("append").parquet(folder)
            s = sync.synced_stream(spark.readStream.schema("source string, at timestamp, event long, to string").parquet(folder), allowed, timedelta(days=2))
            s.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
            at = to
        runs[name] = sorted((r["source"], r["at"], r["outcome"], r["state"]) for r in spark.read.parquet(out).collect())
    want = [("a", day(1), "first", "new"), ("a", day(1, 5), "moved", "read"), ("a", day(2), "refused", "read"), ("a", day(4), "timed_out", "timed_out"), ("a", day(5, 1), "refused", "timed_out")]
    want += [("b", day(1), "first", "new"), ("b", day(3), "timed_out", "timed_out"), ("b", day(5), "moved", "read"), ("b", day(7), "timed_out", "timed_out"), ("c", day(9), "first", "new")]
    assert runs["one"] == runs["three"] == sorted(want)
