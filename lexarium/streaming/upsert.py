"""Structured Streaming over the incremental operators: event upserts, dedup within a watermark, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import newest, replaced


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def upsert_stream(events: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keep the newest row of each key in versions of a table below `target`, one version a batch, and process what is there.

    A batch writes version <batch id> from the latest one before it; a batch that is run again after a failure starts from
    the same version and writes the same rows.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        new = newest(batch, keys, order)
        before = next((v for v in range(n - 1, -1, -1) if _exists(spark, f"{target}/v{v}/_SUCCESS")), None)
        if before is not None:
            old = spark.read.parquet(f"{target}/v{before}")
            new = replaced(old, newest(new.unionByName(old.join(new.select(*keys), keys, "left_semi")), keys, order), keys)
        new.write.mode("overwrite").parquet(f"{target}/v{n}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, batches: int) -> DataFrame:
    """The table after so many batches at most."""
    last = next(v for v in range(batches, -1, -1) if _exists(spark, f"{target}/v{v}/_SUCCESS"))
    return spark.read.parquet(f"{target}/v{last}")


def first_seen(events: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Events without those whose key was seen within the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, by: str, at: str, width: str, delay: str) -> DataFrame:
    """(start, by, n): events a window and kind; late ones up to the delay still count."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
