"""A folder of Parquet tables as a store: keyed replacement, several tables in one commit, cuts for distribution, copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import newest, replaced
from .commits import Commits, Stale, State

__all__ = ["Stale", "Store", "Transaction"]


class Transaction:
    """Writes to several tables that are seen together or not at all.

    `with store.transaction() as t:` commits at the end; an exception inside leaves the old state. Reads see what the
    transaction itself has written.
    """

    def __init__(self, commits: Commits, base: State):
        self.commits, self.base = commits, base
        self.staged: dict[str, list[str]] = {}

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and self.staged:
            self.commits.commit(self.base, self.staged)

    def has(self, name: str) -> bool:
        return name in self.staged or name in self.base.tables

    def read(self, name: str) -> DataFrame:
        return self.commits.read(State(tables=self.base.tables | self.staged), name)

    def write(self, name: str, rows: DataFrame) -> None:
        self.staged[name] = [self.commits.stage(name, rows)]

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows in a folder of their own: nothing that is there is rewritten."""
        there = self.staged.get(name, self.base.tables.get(name, []))
        self.staged[name] = [*there, self.commits.stage(name, rows)]

    def put(self, name: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """Replace all rows of the keys in rows."""
        self.write(name, replaced(self.read(name), rows, list(keys)) if self.has(name) else rows)

    def put_acts(self, acts: DataFrame, children: dict[str, DataFrame], key: str = "act") -> None:
        """Replace acts and all their children wholesale; children of acts that aren't given are refused."""
        for name, rows in children.items():
            if rows.join(acts.select(key), key, "left_anti").limit(1).count():
                raise ValueError(f"{name} has rows of other acts")
        if acts.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError("an act is given twice")
        ids = acts.select(key)
        for name, rows in children.items():
            self.write(name, self.read(name).join(ids, key, "left_anti").unionByName(rows) if self.has(name) else rows)
        self.put("acts", acts, [key])

    def add_once(self, name: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """Append rows whose keys the table doesn't have; of several with one key the first by content."""
        rows = newest(rows, list(keys), [c for c in rows.columns if c not in keys] or list(keys), first=True)
        self.append(name, rows.join(self.read(name).select(*keys), list(keys), "left_anti") if self.has(name) else rows)


class Store:
    """Tables below one path. Readers follow the last commit; a writer that started from an older one is refused (Stale)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.commits = spark, path.rstrip("/"), Commits(spark, path)

    def transaction(self) -> Transaction:
        return Transaction(self.commits, self.commits.latest())

    def has(self, name: str) -> bool:
        return self.transaction().has(name)

    def read(self, name: str) -> DataFrame:
        return self.transaction().read(name)

    def write(self, name: str, rows: DataFrame) -> None:
        with self.transaction() as t:
            t.write(name, rows)

    def put(self, name: str, rows: DataFrame, keys: Sequence[str]) -> None:
        with self.transaction() as t:
            t.put(name, rows, keys)

    def put_acts(self, acts: DataFrame, children: dict[str, DataFrame], key: str = "act") -> None:
        with self.transaction() as t:
            t.put_acts(acts, children, key)

    def add_once(self, name: str, rows: DataFrame, keys: Sequence[str]) -> None:
        with self.transaction() as t:
            t.add_once(name, rows, keys)

    def replay(self, snapshots: DataFrame, tables: dict[str, DataFrame], key: str = "snapshot") -> bool:
        """Add what snapshots say, once: snapshots(key, ..) that `replayed` names already add nothing to any table.

        tables: rows with the key's column, of which those of new snapshots are appended. Returns whether any was new.
        """
        with self.transaction() as t:
            new = snapshots.join(t.read("replayed").select(key), key, "left_anti") if t.has("replayed") else snapshots
            if new.limit(1).count() == 0:
                return False
            ids = new.select(key).distinct()
            for name, rows in tables.items():
                t.append(name, rows.join(ids, key, "left_semi"))
            t.append("replayed", ids)
        return True

    def cut(self, names: Sequence[str], to: str, version: str, sort: dict[str, str] | None = None) -> DataFrame:
        """Copy tables of one commit to a folder of their own, in ranges of a sort column where one is given, with a manifest
        row each."""
        out, state = [], self.transaction()
        for name in names:
            t = state.read(name)
            by = (sort or {}).get(name)
            (t.repartitionByRange(by).sortWithinPartitions(by) if by else t).withColumn("release", F.lit(version)).write.mode("overwrite").parquet(f"{to}/{name}")
            out.append((name, version, self.spark.read.parquet(f"{to}/{name}").count()))
        m = self.spark.createDataFrame(out, "name string, release string, n long")
        m.coalesce(1).write.mode("overwrite").json(f"{to}/manifest")
        return m

    def publish(self, to: str, keep: dict[str, Sequence[str]], version: str) -> DataFrame:
        """A copy with only the tables and columns that readers use, checked against the counts it was made from."""
        m, state = [], self.transaction()
        for name, columns in keep.items():
            state.read(name).select(*columns).write.mode("overwrite").parquet(f"{to}/{name}")
            n, got = state.read(name).count(), self.spark.read.parquet(f"{to}/{name}").count()
            if n != got:
                raise ValueError(f"{name}: {n} rows became {got}")
            m.append((name, version, got))
        return self.spark.createDataFrame(m, "name string, release string, n long")
