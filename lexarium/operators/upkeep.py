"""Derived tables kept up by signed changes: edges of replaced acts flow into what is known of the acts they cite.

Edges are kept twice in buckets, by source and by target, and what is known of each target (see graph.watch_state) in the
targets' buckets. Replacing acts reads the buckets of these acts, makes the differences (+1 and -1 an edge), and reads and
rewrites only the target buckets that these touch; all of it is one commit. Applying the same acts again makes no
differences and writes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import Commits, State
from .graph import CHANGES, FEW

EDGE = ["source", "target", "locator", "kind", "since"]


def counted(edges: DataFrame) -> DataFrame:
    """(EDGE, n): equal edges once, with their number."""
    return edges.groupBy(*EDGE).agg(F.count("*").alias("n"))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(EDGE, n): what counted edges gained (n > 0) and lost (n < 0)."""
    return old.select(*EDGE, (-F.col("n")).alias("n")).unionAll(new.select(*EDGE, "n")).groupBy(*EDGE).agg(F.sum("n").alias("n")).where("n <> 0")


def known(edges: DataFrame) -> DataFrame:
    """(target, citing, changing, edges, last_change) from counted edges."""
    change = F.col("kind").isin(*CHANGES)
    one = edges.groupBy("target", "source").agg(F.max(change).alias("change"), F.sum("n").alias("n"), F.max(F.when(change, F.col("since"))).alias("last"))  # a row a pair, so that no row is multiplied
    return one.groupBy("target").agg(F.count("source").alias("citing"), F.count(F.when(F.col("change"), F.col("source"))).alias("changing"), F.sum("n").alias("edges"), F.max("last").alias("last_change"))


class EdgeUpkeep:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.commits, self.buckets = spark, Commits(spark, path), buckets

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _names(self, rows: DataFrame, by: str) -> list[int]:
        """The buckets that rows touch: at most `buckets` numbers."""
        return sorted(r[0] for r in rows.select(self._bucket(by)).distinct().collect())

    def _read(self, state: State, name: str, numbers: list[int], like: DataFrame) -> DataFrame:
        folders = [f for i in numbers for f in state.tables.get(f"{name}/{i}", [])]
        return self.spark.read.schema(like.schema).parquet(*(f"{self.commits.path}/{f}" for f in folders)) if folders else like.limit(0)

    def _stage(self, name: str, rows: DataFrame, by: str, numbers: list[int]) -> dict[str, list[str]]:
        """Write rows of these buckets in one job; a bucket without rows has no folder."""
        folder = self.commits.stage(name, rows.withColumn("bucket", self._bucket(by)).repartition("bucket"), ["bucket"])
        there = self.commits.parts(folder)
        return {f"{name}/{i}": [f"{folder}/bucket={i}"] if f"bucket={i}" in there else [] for i in numbers}

    def replace(self, acts: DataFrame, edges: DataFrame) -> State:
        """The edges of acts(source) are now these; acts without any lose theirs."""
        base = self.commits.latest()
        ids = acts.select("source").distinct()
        ids = F.broadcast(ids) if ids.count() <= FEW else ids
        # staged, as it is read three times
        new = self.commits.read(State(tables={"new": [self.commits.stage("new", counted(edges.join(ids, "source", "left_semi")))]}), "new")
        sources = self._names(ids, "source")
        own = self._read(base, "by_source", sources, new)
        staged_diff = self.commits.stage("differences", differences(own.join(ids, "source", "left_semi"), new))
        diff = self.commits.read(State(tables={"d": [staged_diff]}), "d")
        targets = self._names(diff, "target")
        if not targets:
            return base
        tables = self._stage("by_source", own.join(ids, "source", "left_anti").unionByName(new), "source", sources)
        old = self._read(base, "by_target", targets, new)
        now = old.unionByName(diff).groupBy(*EDGE).agg(F.sum("n").alias("n")).where("n <> 0")
        by_target = self._stage("by_target", now, "target", targets)
        touched = diff.select("target").distinct()
        again = known(self._read(State(tables=by_target), "by_target", targets, new).join(touched, "target", "left_semi"))
        rest = self._read(base, "known", targets, again).join(touched, "target", "left_anti")
        return self.commits.commit(base, tables | by_target | self._stage("known", rest.unionByName(again), "target", targets))

    def known(self, targets: list[str] | None = None) -> DataFrame:
        """What is known of all targets, or of these: of their buckets only."""
        state = self.commits.latest()
        like = known(self.spark.createDataFrame([], "source string, target string, locator string, kind string, since date, n long"))
        if targets is None:
            return self._read(state, "known", list(range(self.buckets)), like)
        asked = self.spark.createDataFrame([(t,) for t in targets], "target string")
        return self._read(state, "known", self._names(asked, "target"), like).where(F.col("target").isin(*targets))
