"""Joins by ancestor keys and bins against brute force over covering paths, and the repair of damaged names."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from lexarium.operators import graph, repair, similarity, status

PATHS = ["", "art1", "art1.alin1", "art1.alin1.lita", "art1.alin2", "art10", "art10.alin1", "art2"]


def covers(outer, inner):
    return outer in ("", inner) or inner.startswith(outer + ".")


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(7)
    rows = sorted({(f"c{rng.randint(0, 9)}", f"p{rng.choice([0, 0, 0, 1, 2])}", rng.choice(PATHS), rng.choice(["abroga", "modifica", "refera", "suspenda"]), rng.choice([None, date(2000, 1, 1), date(2001, 5, rng.randint(1, 9))])) for _ in range(60)}, key=str)
    return rows, spark.createDataFrame(rows, "source string, target string, locator string, kind string, since date")


REFS = [(f"r{a}{i}", a, p) for a in ("p0", "p1", "p3") for i, p in enumerate(PATHS)]


def test_ancestors(spark):
    got = spark.createDataFrame([(p,) for p in PATHS], "p string").select("p", graph.ancestors(F.col("p")).alias("up"), graph.ancestors(F.col("p"), itself=False).alias("above")).collect()
    for r in got:
        assert sorted(r["up"]) == sorted(p for p in {*PATHS, r["p"]} if covers(p, r["p"])) and sorted(r["above"]) == sorted(set(r["up"]) - {r["p"]})


def test_who_cites_and_dead_and_qualified(spark, edges):
    rows, e = edges
    t = spark.createDataFrame([(a, p) for _, a, p in REFS], "target string, path string")
    got = sorted((r["source"], r["target"], r["locator"], r["kind"], str(r["since"]), r["path"], r["grade"]) for r in graph.who_cites(e, t).collect())
    grade = lambda cited, path: "exact" if cited == path else "inside" if covers(path, cited) else "around" if covers(cited, path) else None
    assert got == sorted((s, a, c, k, str(d), p, grade(c, p)) for s, a, c, k, d in rows for _, b, p in REFS if a == b and grade(c, p))
    refs = spark.createDataFrame(REFS, "ref string, act string, locator string")
    gone = spark.createDataFrame([("p0", date(2001, 1, 1))], "act string, republished date")
    want = {}
    for ref, act, path in REFS:
        dead = [((c != ""), str(d) if d else "", c, s, d) for s, a, c, k, d in rows if a == act and k == "abroga" and covers(c, path)]
        if dead:
            part, _, c, by, d = min(dead, key=lambda x: x[:4])
            want[ref] = (by, d, not part, "material" if part and act == "p0" and (d is None or d < date(2001, 1, 1)) else "blocking")
    assert {r["ref"]: (r["by"], r["since"], r["whole"], r["severity"]) for r in status.dead_citations(refs, e, gone).collect()} == want
    got = {(r["ref"], r["status"], r["by"], r["since"]) for r in status.qualified_citations(refs, e).collect()}
    assert got == {(ref, "suspendat", s, d) for ref, act, path in REFS if ref not in want for s, a, c, k, d in rows if a == act and k == "suspenda" and covers(c, path)}


def test_struck_register_and_collisions(spark, edges):
    rows, e = edges
    strikes = [(i, a, p, date(2000, 6, 1), i % 2 == 0) for i, (_, a, p) in enumerate(REFS)]
    s = spark.createDataFrame(strikes, "strike long, act string, locator string, published date, suspends boolean")
    kinds = {"p0": "lege", "p1": "hg", **{f"c{i}": k for i, k in enumerate(["lege", "hg", "ordin", "oug"])}}
    rank = {"lege": 1, "oug": 1, "hg": 3, "ordin": 4}
    k = spark.createDataFrame(list(kinds.items()), "act string, kind string")
    got = status.struck_register(s, e, k, F.lit("2001-01-01").cast("date"))
    may = lambda by, own: by not in kinds or own not in kinds or rank[kinds[by]] <= rank[kinds[own]]
    left = [x for x in strikes if not any(a == x[1] and d and d > x[3] and (covers(c, x[2]) or covers(x[2], c)) and may(by, a) for by, a, c, _, d in rows)]
    assert sorted(r["strike"] for r in got.collect()) == sorted(x[0] for x in left) and 0 < len(left) < len(strikes)
    refs = spark.createDataFrame(REFS, "ref string, act string, locator string")
    order = ("exact", "sub", "over", "whole", "act")
    grade = lambda c, x: "exact" if c == x else "whole" if x == "" else "act" if c == "" else "sub" if covers(x, c) else "over" if covers(c, x) else None
    want = {}
    for ref, act, path in REFS:
        hits = [(order.index(grade(path, x[2])), x[0], x[2]) for x in left if x[1] == act and grade(path, x[2])]
        if hits:
            g, first, struck = min(hits)
            want[ref] = (order[g], first, struck)
    assert {r["ref"]: (r["grade"], r["first_strike"], r["struck"]) for r in status.collisions(refs, got).collect()} == want


def test_offsets_meet_their_span_across_bins(spark):
    spans, at = [], 0
    for i, n in enumerate([0, 1, 127, 128, 129, 1000, 3]):
        spans.append(("a", at, at + n, f"art{i}"))
        at += n + 1
    points = [("a", i) for i in range(at + 5)] + [("b", 1)]
    got = {(r["act"], r["offset"]): r["locator"] for r in graph.at_offset(spark.createDataFrame(points, "act string, offset long"), spark.createDataFrame(spans, "act string, start long, end long, locator string")).collect()}
    assert got == {(a, i): next((x for b, s, e, x in spans if a == b and s <= i < e), None) for a, i in points}


def test_repair_of_damaged_words(spark):
    words = [("minister", 5), ("ministru", 2), ("m?nist?r", 1), ("?????", 1), ("ab", 1), ("cb", 1), ("?b", 1), ("a?", 1), ("m?n?s?e?", 1), ("zz?", 1)]
    got = {r["word"]: r["repaired"] for r in repair.repaired_words(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {"m?nist?r": "minister", "?????": None, "?b": None, "a?": "ab", "m?n?s?e?": None, "zz?": None}
    names = [(1, "Ministerul  Apelor"), (2, "M?nisterul Ap?lor"), (3, "??????????"), (4, None), (5, ""), (6, "Minister?l, Apelor.")]
    got = {r["id"]: r["repaired"] for r in repair.repaired_names(spark.createDataFrame(names, "id int, name string"), "id", "name").collect()}
    assert got == {1: "Ministerul  Apelor", 2: "Ministerul Apelor", 3: None, 4: None, 5: "", 6: "Ministerul, Apelor."}


def test_re_enactments_lose_nothing_to_the_prefix(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    norms = [(i, " ".join(word() for _ in range(rng.randint(15, 25)))) for i in range(20)]
    units = []
    for i in range(120):
        w = norms[i % 20][1].split()
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = word()
        units.append((f"u{i}", " ".join(w + [word() for _ in range(rng.randint(0, 20))])))
    grams = lambda t: {t[i : i + 5] for i in range(len(t) - 4)}
    want = {(u, n): round(len(grams(t) & grams(x)) / len(grams(x)), 6) for u, t in units for n, x in norms if len(grams(t)) <= 3 * len(grams(x))}
    got = similarity.re_enactments(spark.createDataFrame(units, "unit string, text string"), spark.createDataFrame(norms, "norm int, text string"))
    assert {(r["unit"], r["norm"]): r["part"] for r in got.collect()} == {k: v for k, v in want.items() if v >= 0.8}
