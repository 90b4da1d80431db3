"""The chain of stages on a small corpus in a folder of its own, and on an empty one."""

import pytest

import corpus_pipeline

BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def folder(spark, path, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def prose(i, n=60):
    return " ".join(f"w{(i * 7919 + k * 104729) % 100003}" for k in range(n))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = [(i, prose(i) + "\n" + prose(i + 500), "en", f"s{i % 2}", 700) for i in range(80)]
    docs += [(100 + i, f"you utter moron and idiot {prose(900 + i, 20)}", "en", "s0", 100) for i in range(40)]
    docs += [(200, prose(1) + "\n" + prose(501), "en", "s1", 700), (201, prose(7000) + " " + BENCH, "en", "s0", 300), (202, None, None, None, None), (203, "", "en", "s1", 0)]
    near = prose(3000, 200).split()
    other = [*near[:100], "changed", *near[101:]]  # the same words in other lines, so that no line is like another
    docs += [(300, "\n".join(" ".join(near[k : k + 10]) for k in range(0, 200, 10)), "en", "s0", 900), (301, "\n".join(" ".join(other[k : k + 6]) for k in range(0, 200, 6)), "en", "s0", 900)]
    sf = folder(spark, str(tmp_path_factory.mktemp("sf")), docs, [(i, 1, int(i >= 100)) for i in [*range(80), *range(100, 140)]], [(1, BENCH)])
    out, at = [], spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.written(stage(spark, at, sf), name)
        out.append({"columns": at.columns, "ids": {r["doc_id"] for r in at.collect()}, "rows": at.collect()})
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out, strict=True)), {d[0] for d in docs}


def test_each_stage_takes_effect_and_keeps_clean_documents(stages):
    by, every = stages
    clean = set(range(80))
    assert all(by[n]["columns"] == ["doc_id", "text", "lang", "source", "n_chars"] for n in by)
    assert len(by["toxicity"]["ids"] & set(range(100, 140))) <= 2 and clean <= by["toxicity"]["ids"]
    texts = {r["doc_id"]: r["text"] for r in by["line_dedup"]["rows"]}
    assert texts[1] and texts[200] == "" and texts[202] is None and clean <= set(texts)
    joined = by["ngram_jaccard_join"]["ids"]
    assert len(joined & {300, 301}) == 1 and clean <= joined
    assert 201 not in by["benchmark_decontamination"]["ids"] and clean <= by["benchmark_decontamination"]["ids"]
    assert by["source_mixing"]["ids"] <= every and not by["source_mixing"]["ids"] & {200, 202, 203}


def test_an_empty_corpus_stays_empty(spark, tmp_path):
    sf = folder(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_a_corpus_of_nothing_but_null_texts(spark, tmp_path):
    sf = folder(spark, str(tmp_path), [(1, None, None, None, None), (None, "", None, None, 0)], [(1, 1, 1)], [(None, None)])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_repeated_rows_and_clashing_columns_pass_through_every_stage(spark, tmp_path):
    docs = [(i, prose(i) + "\n" + prose(i + 500), "en", f"s{i % 2}", 700) for i in range(30)]
    sf = folder(spark, str(tmp_path), docs + docs[:5], [(i, 1, int(i > 25)) for i in range(30)], [(1, BENCH)])
    extra = ["id", "th", "item", "component", "size", "copies", "part", "label", "score", "line", "cls"]
    at = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", *(f"concat('{c}', doc_id) as {c}" for c in extra))
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.written(stage(spark, at, sf), name)
        assert at.columns == columns, name
        assert at.where(" or ".join(f"{c} <> concat('{c}', doc_id)" for c in extra)).count() == 0, name
    assert {r["doc_id"] for r in at.collect()} <= set(range(30))
