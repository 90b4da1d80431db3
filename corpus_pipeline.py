"""A corpus pipeline of five stages; each is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import decontamination, line_dedup, mixing, ngram_jaccard, toxicity
from lexarium.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labelled ones among docs, doesn't reject."""
    model = toxicity.fit(docs, toxicity.training_rows(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).where(~F.col("_lx_toxic")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that stay elsewhere; n_chars follows the text."""
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.when(F.col("_lx_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return ngram_jaccard.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each repeated as often as the mix takes it."""
    return mixing.mixed(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("ngram_jaccard_join", drop_near_copies), ("benchmark_decontamination", decontaminate), ("source_mixing", mix_sources)]

#: No SQL expresses the learnt toxicity model, MinHash bands or spaced seeds; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
