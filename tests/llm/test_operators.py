"""Small tests of each operator: odd rows, empty tables, brute force."""

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexarium.llm import components, decontamination, html_extraction, language_model, license_scan, line_dedup, mixing, ngram_jaccard, secret_scan, topk_search, toxicity

SF = "/root/testdata/sf0.001"


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_jaccard_join_is_exact(spark):
    got = {r["id"]: r for r in ngram_jaccard.ngram_jaccard_join(docs(spark)).collect()}
    sets = {}
    for r in docs(spark).select("doc_id", "text").collect():
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {i: r["component"] for i, r in got.items()} == roots(sets, links)
    assert all(got[i]["n_shingles"] == len(s) for i, s in sets.items())


def test_jaccard_join_in_small_tiles_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_EDGES", 0)
    rng = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(60):
        w = list(base)
        for at in rng.integers(0, 120, i % 7):
            w[at] = f"x{rng.integers(0, 5)}"
        rows.append((i, " ".join(w[: 120 - i % 4 * 9])))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows if (w := t.split())}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r["id"]: r["component"] for r in ngram_jaccard.ngram_jaccard_join(d, tile=4, share=500).collect()}
    assert got == roots(sets, links) and len(set(got.values())) > 1


def test_components_in_distributed_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_EDGES", 0)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (7, 7), (None, 3)], "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in components.connected(edges).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 50: 40}


def test_jaccard_join_of_odd_rows(odd, none):
    got = ngram_jaccard.ngram_jaccard_join(odd).collect()
    assert len(got) == 9
    assert {r["component"] for r in got if r["id"] == 5 or (r["id"] == 4 and r["n_shingles"] > 100)} == {4}
    assert [r["component"] for r in got if r["id"] is None] == [4]
    assert all(r["component"] == r["id"] for r in got if r["n_shingles"] == 0)
    assert ngram_jaccard.ngram_jaccard_join(none).count() == 0
    kept = ngram_jaccard.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5 or doc_id is null").count() == 0 and kept.where("doc_id in (2, 3, 6)").count() == 3


def test_line_dedup_against_brute_force(spark):
    got = line_dedup.line_dedup(docs(spark)).agg(F.sum("_lx_lines").alias("n"), F.sum("_lx_dropped").alias("d")).first()
    lines = [line_dedup.fold_line(x) for r in docs(spark).select("text").collect() for x in r["text"].split("\n")]
    distinct = sorted({x for x in lines if x})
    sets = [frozenset(x[i : i + 5] for i in range(len(x) - 4)) if len(x) > 4 else frozenset([x]) for x in distinct]
    places = {}
    for i, s in enumerate(sets):
        for g in sorted(s)[: len(s) - -(-80 * len(s) // 100) + 1]:
            places.setdefault(g, []).append(i)
    pairs = {p for own in places.values() for p in itertools.combinations(own, 2)}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    kept = len(set(roots(range(len(sets)), links).values())) + sum(not x for x in lines)
    assert kept <= got["n"] - got["d"] <= kept * 1.003 + 1  # MinHash may miss a link, never invents one


def test_hot_bands_are_tied_and_still_decided_exactly(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_BATCH", 2)
    monkeypatch.setattr(line_dedup, "HOT", 3)
    base = "the quick brown fox jumps over the lazy dog and runs away from all of the hounds in the old forest by the river"
    rows = [(i, f"{base} {i:03d}\n{i * 7919:012d} unlike {i}") for i in range(40)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).orderBy("doc_id").collect()
    assert [r["_lx_dropped"] for r in got] == [0] + [1] * 39 and got[5]["text"] == rows[5][1].split("\n")[1]


def test_line_links_are_recalled_against_brute_force(spark):
    rng = np.random.default_rng(11)
    letters, lines = list("abcdefghijklmnopqrstuvwxyz "), []
    for n in (8, 12, 20, 40, 80, 160):
        for _ in range(60):
            x = rng.choice(letters, n)
            y = x.copy()
            y[rng.integers(0, n)] = "#"
            lines += ["".join(x).strip(), "".join(y).strip()]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    sets = [frozenset(x[i : i + 5] for i in range(len(x) - 4)) if len(x) > 4 else frozenset([x]) for x in map(line_dedup.fold_line, lines)]
    links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) > 100
    dropped = line_dedup.line_dedup(d).agg(F.sum("_lx_dropped")).first()[0]
    want = len(lines) - len(set(roots(range(len(lines)), links).values()))
    assert want * 0.98 <= dropped <= want


@pytest.mark.parametrize("union", [5, 10, 15, 20, 60, 200])
def test_line_gate_keeps_like_lines_of_any_length(union):
    rng = np.random.default_rng(union)
    lost = 0
    for _ in range(400):
        h = rng.integers(0, 2**63, union).astype(np.uint64)
        apart, side = union // 5, rng.integers(0, 2, union // 5).astype(bool)
        a, b = np.concatenate([h[apart:], h[:apart][side]]), np.concatenate([h[apart:], h[:apart][~side]])
        code = line_dedup.codes(line_dedup.least(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2))
        lost += line_dedup.BINS - line_dedup.agreeing(code[0], code[1]) > line_dedup.unlike(np.int64(len(a)), np.int64(len(b)), 80)
    assert lost == 0 if union <= 60 else lost <= 2


def test_lines_led_by_different_leaders_are_linked():
    two = np.ones((4, 2, line_dedup.BINS // 2), np.uint64)  # 12 bins change from each line of a chain to the next
    for row, changed in enumerate((0, 36, 12, 24)):
        two.reshape(4, -1)[row, :changed] = 2
    code = np.bitwise_or.reduce(two << (2 * np.arange(line_dedup.BINS // 2, dtype=np.uint64)), axis=2).view(np.int64)
    t = line_dedup.pa.RecordBatch.from_pydict({"band": [1] * 4, "id": [0, 1, 2, 3], "code": code[:, 0], "code2": code[:, 1], "n": [200] * 4})
    out = next(line_dedup.band_edges([t]))
    near = lambda x, y: line_dedup.agreeing(code.view(np.uint64)[x], code.view(np.uint64)[y]) >= line_dedup.CODES
    assert near(0, 2) and near(1, 3) and near(2, 3) and not near(0, 1) and not near(0, 3) and not near(1, 2)
    assert set(roots(range(4), zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)).values()) == {0}


def test_line_dedup_of_odd_rows(odd, none):
    got = line_dedup.line_dedup(odd)
    assert got.count() == 9 and set(odd.columns) <= set(got.columns)
    assert sorted(r["text"] for r in got.where("doc_id = 4").collect())[0].startswith("one two")
    assert [r["text"] for r in got.where("doc_id is null").collect()] == [""]
    assert [r["text"] for r in got.where("doc_id = 2").collect()] == [None]
    assert line_dedup.line_dedup(none).count() == 0


def test_lines_are_folded_alike():
    texts = ["A  b\t c \n\n x\n", None, "", " \u00e9\u00c9 \U0001f600z\r\n\x0b", "one"]
    text, number, data, starts, ends = line_dedup.folded_lines(line_dedup.pa.array(texts))
    got = [(int(t), int(n), data[a:b].tobytes().decode()) for t, n, a, b in zip(text, number, starts, ends)]
    assert got == [(t, n, f) for t, x in enumerate(texts) for n, line in enumerate((x or "").split("\n")) if (f := line_dedup.fold_line(line))]


def test_minhash_of_short_lines():
    h, line = line_dedup.char_hashes(["ab", "", "abcdef", "ab"])
    assert line.tolist() == [0, 2, 2, 3] and h[0] == h[3]


def test_decontamination_tolerates_substitutions(spark):
    words = [f"w{i}" for i in range(60)]
    item = spark.createDataFrame([(7, " ".join(words[:40])), (8, None), (9, "a b")], "item_id int, text string")
    changed = words[:40]
    for i in (3, 11, 19, 27, 35):
        changed[i] = "other"
    rows = [(1, "x y z " + " ".join(changed)), (2, " ".join(words[40:])), (3, " ".join(words[:6])), (4, None), (5, "W0, w1. " + " ".join(words[2:40])), (None, " ".join(words))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r for r in decontamination.contaminated(d, item).collect()}
    assert set(got) == {1, 5, None} and got[1]["start"] == 7 and got[1]["agree"] == 32  # the first three words only pay for the fourth
    assert {r["doc_id"] for r in decontamination.decontaminate(d, item).collect()} == {2, 3, 4}
    assert decontamination.contaminated(d, item.limit(0)).count() == 0


def counts(same, least):
    """Brute force: whether any window of at least so many words has 80% agreeing."""
    return any(5 * sum(same[i:j]) >= 4 * (j - i) for i in range(len(same)) for j in range(i + least, len(same) + 1))


def test_decontamination_finds_passages_wherever_words_differ():
    rng = np.random.default_rng(3)
    cases = [(n, whole, at) for n in range(5, 19) for whole in (True, False) if whole or n >= 13 for k in (1, 2, 3, 4) for at in itertools.combinations(range(n), k) if k < 3 or rng.random() < 0.1]
    item = [f"w{i}" for i in range(40)]
    indexes = {n: decontamination.build_index([(7, " ".join(item[:n]))]) for n in range(5, 41)}
    for n, whole, at in cases:
        got = [f"o{i}" if i in at else item[i] for i in range(n)]
        doc = ["x", "y", *got, "z"]
        words = next(iter(decontamination.rows_of(decontamination.pa.array([" ".join(doc)]), decontamination.ALNUM)))
        size = n if whole else 40
        found = decontamination.overlaps(words, indexes[size]).get(0)
        same = [i not in at for i in range(n)] + [False] * (not whole)
        assert bool(found) == counts(same, min(13, size)), (n, whole, at)
        if found:
            start, length, agree = found
            assert length >= min(13, size) and 5 * agree >= 4 * length and agree == sum(same[start - 2 : start - 2 + length])


def test_decontamination_finds_every_verbatim_item(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {(d["doc_id"], b["item_id"]) for d in docs(spark).collect() for b in bench.collect() if b["text"] in d["text"]}
    got = {(r["id"], r["item"]) for r in decontamination.contaminated(docs(spark), bench).collect()}
    assert want <= got


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_automaton_accepts_what_is_one_edit_away():
    terms = ["abba", "cabab", "bbbbb", "acabca"]
    m = toxicity.Matcher(terms)
    for n in range(7):
        for w in map("".join, itertools.islice(itertools.product("abcx", repeat=n), 0, None, 3)):
            best = min(((d, t) for t, x in enumerate(terms) if (d := edits(w, x)) == 0 or (d == 1 and len(x) >= toxicity.FUZZY_FROM)), default=None)
            assert m.match(w) == best, w


def test_toxicity_on_held_out_rows(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(d, toxicity.training_rows(labels), labelled=2000)
    held = toxicity.score(d.join(labels.join(toxicity.training_rows(labels), "doc_id", "left_anti"), "doc_id"), model).select("toxic", "_lx_toxic").toPandas()
    assert (held["toxic"] == held["_lx_toxic"].astype(int)).mean() > 0.97


def test_toxicity_of_odd_rows(spark, odd, none):
    model = toxicity.fit(odd.drop("_lx_score"), spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int"))
    assert [r[0] for r in toxicity.score(odd.drop("_lx_score"), model).select("_lx_score").collect()] == [0.0] * 9
    assert toxicity.score(none.drop("_lx_score"), model).count() == 0


def test_mix_meets_targets(spark):
    m = mixing.mix(docs(spark)).toPandas()
    for _, g in m.groupby("source"):
        assert abs((g["copies"] * g["size"]).sum() - g["target"].iloc[0]) <= max(0.02 * g["target"].iloc[0], g["size"].max())
    assert m["copies"].between(0, 3).all() and abs(m.groupby("source")["target"].first().sum() - m["size"].sum()) < 1e-3


def test_mix_is_the_tilt_of_least_entropy(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(n)), "abc"[i % 3]) for i, n in enumerate(rng.integers(1, 400, 300))]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), salt_rows=3).toPandas()
    for _, g in m.groupby("source"):
        z, words = g["size"] / g["size"].mean(), (g["rate"] * g["size"]).sum()
        assert abs(words / g["target"].iloc[0] - 1) < 1e-9
        tilted = g["rate"] < 3
        x = np.log(g["rate"][tilted]) / z[tilted]
        assert not tilted.any() or x.max() - x.min() < 1e-9
    other = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2), salt_rows=3).toPandas()
    assert m.set_index("id")["copies"].to_dict() == other.set_index("id")["copies"].to_dict()


def test_repeated_rows_share_their_copies_exactly(spark):
    d = spark.createDataFrame([(1, "a b c", "s", "x"), (1, "a b c", "s", "y"), (1, "a b c", "s", "z"), (2, "d " * 9, "t", "x"), (None, "d", None, "n")], "doc_id long, text string, source string, times string")
    want = {(r["id"], r["th"]): r["c"] for r in mixing.mix(d).groupBy("id", "th").agg(F.sum("copies").alias("c")).collect()}
    got = {(r["doc_id"], r["th"]): r["c"] for r in mixing.mixed(d).groupBy("doc_id", F.xxhash64("text").alias("th")).agg(F.count("*").alias("c")).collect()}
    assert got == {k: v for k, v in want.items() if v} and mixing.mixed(d).columns == d.columns


def test_mix_of_odd_rows(odd, none):
    m = mixing.mix(odd).toPandas()
    assert len(m) == 9 and (m["copies"][m["size"] == 0] == 0).all()
    assert mixing.mix(none).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_scans_of_odd_rows(odd, none):
    got = license_scan.license_scan(odd).collect()
    assert [r["_lx_found"] for r in got if r["doc_id"] == 1] == [["apache"]] * 2
    assert all(r["_lx_score"] == 0 and not r["_lx_starts"] for r in got if r["doc_id"] != 1)
    assert license_scan.license_scan(none).count() == 0
    s = secret_scan.secret_scan(odd).collect()
    assert sorted(len(r["base"]) for r in s) == [0] * 7 + [1, 1]
    assert secret_scan.secret_scan(none).count() == 0


def test_template_words_in_any_order_are_found(spark):
    d = spark.createDataFrame([(1, "software encumbered this is free and unencumbered into the public domain released"), (2, "free software")], "doc_id long, text string")
    assert [r["_lx_found"] for r in license_scan.license_scan(d).orderBy("doc_id").collect()] == [["unlicense"], []]


def test_examples_are_told_from_owned_secrets(spark):
    key, own = "Ab1" * 9, "Zy9" * 9
    rows = [(i, f"see {key} here", "en", f"s{i}") for i in range(3)] + [(9, f"see {own} here", "en", "s1")]
    got = {r["id"]: r for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[0]["n_example"] == 1 and not got[0]["all"] and got[9]["n_live"] == 1 and got[9]["all"][0]["start"] == 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>t</title></head><body><nav><a>m</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one <b>two<br>three<p>four</p><aside>x</aside><form>q</form><script>if (a < b) '</p>'</script></article><footer>f</footer>", "A & B\none two three\nfour"),
        ("", ""),
        (None, ""),
        ("a < b", "a < b"),
        ("<main><p>kept</p><section id=comments><p>said</p></section><div class='cookie-notice'>c</div></main>", "kept"),
        ("<!-- x --><article>5 &lt; 6 &#65;</article>", "5 < 6 A"),
    ],
)
def test_main_text(page, text):
    assert html_extraction.main_text(page) == text


BODY = "The court held that the rule was in force and that it is for the party to show why it should not be applied in this case."
SAID = "I think that this is not what they said at all, and it would be better if they had asked all of us who were there."


@pytest.mark.parametrize("wrapper", ["div class='page has-sidebar'", "div class='no-sidebar'", "div id=search-results-page", "section class=with-comments", "div class='layout-sidebar'"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_names_of_the_layout_keep_the_text(wrapper, inner):
    name = wrapper.split()[0]
    page = f"<body><{wrapper}><{inner}><div class='entry-header'><h2>Of rules</h2></div><p>{BODY}</p><p>{BODY}</p></{inner}><div class=comments><p>{SAID}</p></div><div class='sidebar'>menu</div></{name}><div class='cookie-notice'><p>{SAID}</p></div></body>"
    assert html_extraction.main_text(page) == f"Of rules\n{BODY}\n{BODY}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div><h1>Of rules</h1><p>{BODY}</p><p>So held.</p><p>{BODY}</p></div><article class='teaser'><p>Read more</p></article>", f"Of rules\n{BODY}\nSo held.\n{BODY}"),
        (f"<div><p>{BODY}</p></div><article class='comment'><p>{SAID}</p></article>", BODY),
        (f"<p>Home</p><article><h1>Of rules</h1><p>{BODY}</p><p>So held.</p><p>© 2020 The court</p></article><p>Top</p>", f"Of rules\n{BODY}\nSo held."),
        (f"<main><h1>Of rules</h1><article><p>{BODY}</p></article></main><div><p>{SAID}</p></div>", f"Of rules\n{BODY}\n{SAID}"),
        ("<p>Home</p><article><p>Short.</p></article>", "Short."),
    ],
)
def test_an_article_element_is_one_signal(page, text):
    assert html_extraction.main_text(page) == text


def test_names_inside_a_line_keep_it_whole():
    assert html_extraction.main_text(f"<article><p>one <span class='ad'>buy</span> two</p><p class='related'>x<p>{BODY}</article>") == f"one two\n{BODY}"


def test_blocks_inherit():
    assert html_extraction.inherit([None, True, None, None, False, None], [False] * 6) == [True, True, True, False, False, False]


def test_language_model_sums_to_one_and_beats_its_base(spark, odd, none):
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    s = language_model.lm_scores(docs(spark), learn).toPandas()
    assert s["score"].sum() > s["base_score"].sum() and len(s) == docs(spark).count()
    w = np.random.default_rng(0).normal(size=(2, language_model.TEMPLATES << language_model.BITS, language_model.CLASSES)).astype(np.float32)
    h, cls, own, n = language_model.tokens(pa.array(["one two one", None, "x"]))
    for f, m in zip(language_model.contexts(h, cls, n), w, strict=True):
        assert np.allclose(np.exp(language_model.choice_logs(m, f)).sum(1), 1, atol=1e-5)
    by_class, by_part = language_model.contexts(h, cls, n)
    want = [np.log(np.exp(sum(w[0, r] for r in by_class[:, i]))[cls[i]] / np.exp(sum(w[0, r] for r in by_class[:, i])).sum()) for i in range(len(h))]
    want = [x + (0 if cls[i] == language_model.CLASSES - 1 else np.log(np.exp(sum(w[1, r] for r in by_part[:, i]))[own[i]] / np.exp(sum(w[1, r] for r in by_part[:, i])).sum())) for i, x in enumerate(want)]
    assert np.allclose(language_model.word_logs(w, h, cls, own, n), want, atol=1e-4) and list(n) == [4, 1, 2]
    assert language_model.lm_scores(odd, learn).where("n_tokens = 1 and base_score < 0").count() == 3
    assert language_model.lm_scores(none, learn).count() == 0


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 3, size=(300, 4)) / 16
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(300, None), (350, [float("nan")] * 4), (301, [1.0, None, 0.0, 0.0]), (None, [1.0] * 4), (400, [1.0])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.pmod("vec_id", F.lit(50)) == 0).collect()}
    q = np.floor(v * 256).astype(int)
    for i in range(0, 300, 50):
        best = sorted(((-int(q[i] @ q[j]), j) for j in range(300) if j != i))[:5]
        assert [got[i, k] for k in range(1, 6)] == [(j, -s) for s, j in best]
    assert {i for i, _ in got} == set(range(0, 300, 50))


def test_top_k_in_small_blocks_with_huge_components(spark):
    rows = [(0, [-1e300, 1.0]), (50, [1.0, 1.0]), (51, [0.5, -2.0]), (51, [0.5, -2.0]), (52, [0.0, 0.0]), (100, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(d.where("vec_id > 0"), F.pmod("vec_id", F.lit(50)) == 0, queries=1, block=2).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == 50] == [(52, 0), (100, 0), (51, -98304), (51, -98304)]
    assert topk_search.segments_of(np.array([[-9200000000000000000, 256]]))[0][2].tolist() == [-9200000000000000000]
    assert topk_search.top_k(d.limit(0), F.lit(True)).count() == 0


def test_top_k_of_many_blocks_is_exact(spark):
    v = np.random.default_rng(4).normal(size=(500, 8))
    d = spark.createDataFrame([(i, [float(x) for x in r], "x") for i, r in enumerate(v)], "vec_id long, embedding array<double>, score string").repartition(3)
    q = np.floor(v * 256).astype(int)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_search.top_k(d, F.pmod("vec_id", F.lit(20)) == 0, queries=7, block=30).collect()}
    for i in range(0, 500, 20):
        assert [got[i, n] for n in range(1, 6)] == [(j, -s) for s, j in sorted((-int(q[i] @ q[j]), j) for j in range(500) if j != i)[:5]]


def test_license_templates_over_wrapped_lines(spark):
    text = license_scan.TEMPLATES[5][1].split()
    wrapped = "\n".join(" ".join(text[i : i + 7]) for i in range(0, len(text), 7))
    d = spark.createDataFrame([(1, "intro words\n\n" + wrapped + "\nmore", 3), (2, " ".join(text[:12]), 4), (3, None, 5)], "doc_id long, text string, _lx_words int")
    got = {r["doc_id"]: r for r in license_scan.license_scan(d).collect()}
    assert got[1]["_lx_found"] == ["mit"] and got[1]["_lx_score"] == 1.0 and got[2]["_lx_found"] == [] and got[3]["_lx_words"] == 0


def test_many_terms_in_one_line_are_told_apart_in_one_pass():
    hits = {"nasty": (0, 0)}
    text = "> nasty said\n\"nasty\" nasty\n" + "nasty " * 5
    words = toxicity._WORD.findall(text)
    x = toxicity.features(text, words, hits, np.array([1.0]))
    assert x[3] == 1 and x[1] == 1 and x[7] == np.log1p(6)
    long = "nasty " * 20000
    assert toxicity.features(long, long.split(), hits, np.array([1.0]))[7] == np.log1p(20000)


def test_columns_named_like_outputs_give_way(spark, odd):
    d = odd.withColumn("_lx_drop", F.lit(1)).withColumn("_lx_text", F.lit("t")).withColumn("_LX_LINES", F.lit(2)).withColumn("_lx_id", F.lit(3))
    model = toxicity.fit(d, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert toxicity.score(d, model).columns.count("_lx_score") == 1
    assert html_extraction.extract(d, "text").select("_lx_text").count() == 9
    assert line_dedup.line_dedup(d).select("_lx_lines", "_lx_drop").count() == 9
    assert ngram_jaccard.keep_one_of_each(d).columns == d.columns
    assert decontamination.contaminated(d, spark.createDataFrame([(1, "one two three four five six", 2)], "item_id long, text string, id int")).where("item = 1").count() == 2


@pytest.mark.parametrize("open_", ["<div class='nav'>", "<article>", "<ul><li class='ad'>", "<p>of <b>", "<div class='menu'><main>"])
def test_deep_and_long_pages_take_time_in_proportion(open_):
    import time

    html_extraction.main_text(open_ * 10)
    start = time.process_time()
    text = html_extraction.main_text(f"<p>{BODY}</p>" + (open_ + "x the of ") * 30_000)
    assert time.process_time() - start < 20 and BODY in text  # a square of the depth took minutes


def test_names_end_where_their_elements_do():
    page = f"<div class='nav'><span class='ad'>menu one</div>still an advert</span><p>{BODY}</p><p class='related'>more<p>{BODY}<div><div class='share'><div>a</div>b</div>c</div>"
    assert html_extraction.main_text(page).split("\n")[0] == BODY and "menu one" not in html_extraction.main_text(page) and "advert" not in html_extraction.main_text(page)


def test_extract_of_odd_rows(odd, none):
    assert html_extraction.extract(odd, "text").where("doc_id = 2").first()["_lx_text"] == "" and html_extraction.extract(none, "text").count() == 0


def test_language_model_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 50)  # most words meet their counts in the join
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    a, b = (language_model.lm_scores(docs(spark).repartition(n), learn).toPandas().set_index("id").sort_index() for n in (2, 7))
    assert np.allclose(a["score"], b["score"], rtol=1e-9) and np.allclose(a["base_score"], b["base_score"], rtol=1e-12)
    gain = (a["score"] - a["base_score"])[a["learnt"] == False].sum() / a["n_tokens"][a["learnt"] == False].sum()  # noqa: E712
    assert gain > 0.1


def test_language_model_gains_on_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    s = language_model.lm_scores(d, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2).where("not learnt")
    r = s.agg(((F.sum("score") - F.sum("base_score")) / F.sum("n_tokens")).alias("gain"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better")).first()
    print("gain", r["gain"], "better", r["better"])
    assert r["gain"] > 0.2 and r["better"] > 0.9


def test_gradient_steps_lower_the_penalised_loss(spark):
    rows = language_model.TEMPLATES << language_model.BITS
    texts = docs(spark).select("text").collect()
    h, cls, own, n = language_model.tokens(pa.array([r["text"] for r in texts]))
    f, _ = language_model.contexts(h, cls, n)
    half = np.cumsum(n)[len(n) // 2]
    seen, losses = np.zeros((rows, language_model.CLASSES), np.int64), []
    language_model.seen_sums(seen, f[:, :half], cls[:half])
    w, rest = language_model.start_weights(seen)
    for _ in range(3):
        losses.append(-language_model.chosen_logs(w, f[:, :half], cls[:half]).sum() + language_model.PULL / 2 * ((w - rest) ** 2).sum())
        expected = np.zeros((language_model.CLASSES, rows))
        language_model.expected_sums(expected, f[:, :half], w)
        w = language_model.stepped(w, seen, expected.T / (1 << language_model.UNITS), rest)
    assert losses[0] > losses[1] > losses[2]
    p = np.exp(language_model.choice_logs(w, f[:, :5000]))
    want, got = np.zeros((language_model.CLASSES, rows)), np.zeros((language_model.CLASSES, rows))
    language_model.expected_sums(got, f[:, :5000], w)
    for i in range(language_model.TEMPLATES):
        np.add.at(want.T, f[i, :5000], np.rint(p * (1 << language_model.UNITS)))
    assert np.abs(got - want).max() <= 2 and got.sum() == np.rint(got).sum()


def test_base_scores_against_brute_force(spark):
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    words = {r["doc_id"]: r["text"].encode().lower().split() + [None] for r in docs(spark).select("doc_id", "text").collect()}
    got = language_model.lm_scores(docs(spark), learn).collect()
    seen = Counter(w for r in got if r["learnt"] for w in words[r["id"]])
    n, v = sum(seen.values()), len(seen)
    for r in got:
        w = words[r["id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in seen for x in w), n)
        assert abs(r["base_score"] - sum(np.log10((seen[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)


def test_many_secrets_in_one_text_keep_their_places(spark):
    text = " ".join(f"é{i:024x}" for i in range(1000))
    (r,) = secret_scan.secret_scan(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")).collect()
    assert [(x["start"], x["end"]) for x in r["base"]] == [(26 * i + 1, 26 * i + 25) for i in range(1000)]


def test_copies_in_many_repositories_are_examples(spark):
    key = "Ab1" * 9
    rows = [(i, f"see {key} here", f"l{i}", f"s{i % 2}") for i in range(5)]
    got = secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r["n_example"] == 1 for r in got)
    assert all(r["n_live"] == 1 for r in secret_scan.secret_scan(spark.createDataFrame(rows[:4], "doc_id long, text string, lang string, source string")).collect())


def test_runs_hold_one_value_at_a_time():
    from lexarium.llm.common import runs

    sizes = [3, 1, 0, 5, 2]
    values = np.repeat([1, 2, 3, 4, 5], [4, 1, 3, 2, 1])
    cuts = np.cumsum([0, *sizes])
    batches = [pa.record_batch({"part": values[a:b]}) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert [[v for b in r for v in b.column(0).to_pylist()] for r in runs(iter(batches), "part")] == [[1] * 4, [2], [3] * 3, [4] * 2, [5]]


def test_more_parts_than_tasks_change_nothing(spark):
    d = docs(spark)
    few = {r["id"]: (r["n_shingles"], r["component"]) for r in ngram_jaccard.ngram_jaccard_join(d).collect()}
    assert {r["id"]: (r["n_shingles"], r["component"]) for r in ngram_jaccard.ngram_jaccard_join(d, share=2000, tasks=3).collect()} == few
    lines = lambda **more: sorted(map(tuple, line_dedup.duplicate_lines(d, **more).collect()))
    assert lines(share=2000, tasks=3) == lines()


def test_decontamination_of_repeated_words_long_texts_and_clashing_columns(spark):
    import time

    item = " ".join(["same"] * 500)
    index = decontamination.build_index([(1, item), (2, "one two three four five six seven eight nine ten eleven twelve thirteen")])
    (words,) = decontamination.rows_of(pa.array([" ".join(["same"] * 20_000)]), decontamination.ALNUM)
    start = time.process_time()
    assert decontamination.overlaps(words, index)[0][1:] == (500, 500) and time.process_time() - start < 20
    assert len(decontamination.diagonals(words, index)) == len(set(map(tuple, decontamination.diagonals(words, index).tolist())))
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, f"{long} One two, three four five six SEVEN eight nine ten eleven other thirteen {long}", "x", 5), (1, "same words only", "y", 6), (2, None, None, None), (None, "", "", 0)]
    d = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, item string, start long")
    b = spark.createDataFrame([(7, "one two three four five six seven eight nine ten eleven twelve thirteen", 1), (8, None, 2), (None, "a b c", 3)], "item_id long, text string, agree int")
    got = [tuple(r) for r in decontamination.contaminated(d, b).collect()]
    assert got == [(1, 7, 50_000, 13, 12)] * 2
    left = decontamination.decontaminate(d, b)
    assert left.columns == d.columns and sorted(map(str, left.collect())) == sorted(map(str, [r for r in d.collect() if "SEVEN" not in (r["text"] or "")]))


def test_clashing_score_columns_give_way(spark, odd):
    d = odd.withColumn("score", F.lit("mine")).withColumn("id", F.lit(0)).withColumn("learnt", F.lit(1))
    got = language_model.lm_scores(d, F.col("doc_id") != 3)
    assert got.count() == d.count() and dict(got.dtypes)["score"] == "double" and dict(got.dtypes)["id"] == "bigint"


def test_unlike_lines_of_common_shingles_seldom_meet_in_bands(spark, monkeypatch):
    """Lines of the same few syllables are no candidates, so that bands don't grow with the square of the input; like ones still are."""
    rng, real, met = np.random.default_rng(5), line_dedup.written, []

    def counted(df, tag):
        out = real(df, tag)
        if tag == "met":
            met.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    syllables = ["the ", "of ", "and", "tion", "er", "ing ", "en", "re", "on", "at "]
    lines = ["".join(rng.choice(syllables, 24)) for _ in range(8000)]
    more = [x[:30] + "#" + x[31:] for x in lines[:200]]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines + more)], "doc_id long, text string")
    dropped = {r["id"] for r in line_dedup.duplicate_lines(d).collect()}
    assert met[0] < 16 * 2 * 200 * 1.5  # at most what the like lines need, and half of that
    assert len(dropped & set(range(8000, 8200))) >= 196


def test_language_model_sums_follow_the_number_of_tokens(spark, monkeypatch):
    real, plans = language_model.written, []

    def kept(df, tag):
        if tag == "sums":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, tag)

    monkeypatch.setattr(language_model, "written", kept)
    monkeypatch.setattr(language_model, "ROUNDS", 0)
    texts = spark.createDataFrame([(f"some words {i}",) for i in range(40)], "text string")
    for n in (23_200_000, 116_000_000):
        language_model.train(texts, n)
    a, b = (int(re.search(r"Repartition (\d+), false", p).group(1)) for p in plans)
    assert b >= 5 * a


def test_tiles_of_few_members_are_solved_without_bitmaps(monkeypatch):
    def brute(ids, sets, labels):
        links, labels, order = [], list(labels), sorted(range(len(ids)), key=lambda i: len(sets[i]))
        for x, i in enumerate(order):
            for k in order[x + 1 :]:
                both = len(np.intersect1d(sets[i], sets[k]))
                if labels[i] != labels[k] and 100 * both >= 80 * (len(sets[i]) + len(sets[k]) - both):
                    links.append((ids[i], ids[k]))
                    labels = [labels[i] if v == labels[k] else v for v in labels]
        return links

    rng, calls = np.random.default_rng(5), []
    tiles = [[np.unique(rng.choice(30, rng.integers(20, 31), replace=False)) for _ in range(2 + k % 3)] for k in range(60)]
    want = [brute(list(range(len(t))), t, range(len(t))) for t in tiles]
    bitmaps = components._bitmaps
    monkeypatch.setattr(components, "_bitmaps", lambda *a: calls.append(a) or bitmaps(*a))
    got = [components.link_tile(np.arange(len(t)), t, np.arange(len(t)), 80) for t in tiles]
    assert got == want and sum(map(len, want)) > 5 and not calls
    assert not components.link_tile(np.arange(2), [tiles[0][0], tiles[0][0]], np.arange(2), 80, np.array([1, 1]))


def test_toxicity_learns_from_small_parts_and_gives_memory_back(monkeypatch):
    import pyarrow as pa

    from lexarium.llm import toxicity

    freed = []
    monkeypatch.setattr(toxicity, "release", lambda: freed.append(1))
    texts = [f"w{i} " + "ab " * 300_000 for i in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 0], pa.int32()), pa.array(texts)], ["toxic", "text"])
    got = [r for b in toxicity._distinct([batch]) for r in b.to_pylist()]
    assert got == [{"toxic": k % 2, "words": ["ab", f"w{k}"]} for k in range(3)]
    assert len(list(toxicity._distinct([batch]))) == 3 and len(freed) == 2
