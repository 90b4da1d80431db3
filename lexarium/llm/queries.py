"""The opN queries: each applies its operator to its whole table and derives the result's columns from the operator's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, language_model, license_scan, line_dedup, mixing, ngram_jaccard, prefix_trie, ranked_search, secret_scan, topk_search, toxicity, url_filter
from .common import table
from .queries_sql import ORACLES


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = license_scan.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return d.select(
        "doc_id", F.col("_lx_words").alias("n_words"), F.size("_lx_starts").cast("long").alias("n_base"), F.array_min("_lx_starts").cast("long").alias("first_word"), F.array_max("_lx_starts").cast("long").alias("last_word"),
        join(F.col("_lx_base")).alias("base_labels"), join(F.col("_lx_found")).alias("labels"), F.col("_lx_score").alias("score"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.training_rows(table(spark, sf_dir, "labels")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(True))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), F.col("_lx_score").alias("score"), F.col("_lx_toxic").cast("int").alias("predicted"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = html_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return p.select("page_id", "url", F.col("_lx_text").alias("text"), F.col("_lx_chars").alias("n_chars"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = language_model.lm_scores(table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2)
    return s.select(F.col("id").alias("doc_id"), (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard_join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return s.select(
        F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("all")).alias("spans"), "n_live", "n_example"
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return c.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("start").alias("start_word"), F.col("words").alias("n_words"), F.col("agree").alias("n_agree"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("_lx_lines").alias("n_lines"), F.col("_lx_dropped").alias("n_dropped"), "text")


#: Rules that op11 judges by.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return u.select("page_id", F.col("_lx_host").alias("host"), F.col("_lx_path").alias("path"), F.col("_lx_rule").alias("rule"), F.col("_lx_verdict").alias("verdict"), F.col("_lx_score").alias("score"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark")).select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = prefix_trie.turn_paths(table(spark, sf_dir, "conversations"))
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(4)).cast("int")
    t = prefix_trie.prefix_trie(prefix_trie.rebuilt(paths, head, F.col("conv") - F.col("conv") % 20, 3))
    return t.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_license_scan, op2_toxicity, op3_source_mixing, op4_html_extraction, op5_lm_scoring, op6_ngram_jaccard_join, op7_exact_topk, op8_secret_scan, op9_benchmark_decontamination, op10_line_dedup, op11_url_filter, op12_ranked_search, op13_prefix_trie)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
