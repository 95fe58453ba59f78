"""Versioned Parquet store of the engine's tables, and the trace as CSV.

A version is a folder that is complete once its marker exists; readers take the newest complete one, so a transaction
is a new version, undo is forgetting the last, and a crashed write is never seen. A version holds a table as a whole or
as what was added and removed since the one before; tables it does not name are those of the version before. After
``COMPACT`` changes in a row a table is written as a whole again, so reads stay short, and versions that none of the
newest ones needs are deleted.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: The tables and their keys.
KEYS = {
    "vectors": ["vec_id"], "membership": ["vec_id"], "partition_meta": ["partition_id"], "mst_edges": ["src", "dst"],
    "cluster_membership": ["threshold", "vec_id"], "cluster_meta": ["threshold", "cluster_id"], "projection": ["layer"],
}
TABLES = tuple(KEYS)
COMPACT = 8


@dataclass
class Delta:
    """Rows added to a table after those with the keys of ``removed`` are taken out. Either may be None."""

    added: DataFrame | None = None
    removed: DataFrame | None = None

    def on(self, table: DataFrame, keys: list[str]) -> DataFrame:
        if self.removed is not None:
            table = table.join(self.removed.select(*keys).distinct(), keys, "left_anti").select(*table.columns)
        return table if self.added is None else table.unionByName(self.added.select(*table.columns))

    def then(self, other: Delta, keys: list[str]) -> Delta:
        """This change and then another one as one."""
        added = self.added
        if added is not None and other.removed is not None:
            added = added.join(other.removed.select(*keys).distinct(), keys, "left_anti").select(*added.columns)
        both = lambda a, b: b if a is None else a if b is None else a.unionByName(b)
        key = lambda d: None if d is None else d.select(*keys)
        return Delta(both(added, other.added), both(key(self.removed), key(other.removed)))


def difference(old: DataFrame, new: DataFrame, keys: list[str]) -> Delta:
    """What turns one state of a table into another."""
    every = [f.name for f in new.schema.fields]
    return Delta(new.join(old.select(*every), every, "left_anti").select(*every), old.join(new, every, "left_anti").select(*keys))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _is(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._is(f"{self.path}/{n}/_COMPLETE"))

    def write(self, tables: dict[str, DataFrame | Delta], version: int | None = None, by: dict[str, str] | None = None) -> int:
        """Write a new version; tables named in ``by`` are laid out by that column so that filters on it prune files.
        Writing a version that is complete already does nothing (a replayed micro-batch)."""
        have = self.versions()
        v = version if version is not None else (have[-1] + 1 if have else 0)
        if v in have:
            return v
        root = f"{self.path}/v{v}"
        compacted = False
        for name, table in tables.items():
            if isinstance(table, Delta) and self._chain(name, have[-1] if have else None)[1] >= COMPACT:
                table, compacted = table.on(self.read(name), KEYS[name]), True
            parts = {"": table} if isinstance(table, DataFrame) else {"+": table.added, "-": table.removed}
            for sign, df in parts.items():
                if df is None:
                    continue
                w = df.write.mode("overwrite")
                if by and name in by and not sign:
                    w = w.partitionBy(by[name])
                w.parquet(f"{root}/{name}{sign}")
        self._fs.create(self._path(f"{root}/_COMPLETE"), True).close()
        if compacted:
            self.vacuum()
        return v

    def _chain(self, name: str, version: int | None) -> tuple[int | None, int]:
        """(version that holds the table as a whole, number of changes since)."""
        changes = 0
        for v in reversed([x for x in self.versions() if version is not None and x <= version]):
            if self._is(f"{self.path}/v{v}/{name}"):
                return v, changes
            changes += any(self._is(f"{self.path}/v{v}/{name}{s}") for s in "+-")
        return None, changes

    def has(self, name: str) -> bool:
        have = self.versions()
        return bool(have) and self._chain(name, have[-1])[0] is not None

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version (the newest by default); KeyError when there is none."""
        have = self.versions()
        v = version if version is not None else (have[-1] if have else None)
        base = self._chain(name, v)[0] if v in have else None
        if base is None:
            raise KeyError(f"{name} in version {v}")
        df = self.spark.read.parquet(f"{self.path}/v{base}/{name}")
        for u in [x for x in have if base < x <= v]:
            part = {s: f"{self.path}/v{u}/{name}{s}" for s in "+-"}
            added, removed = (self.spark.read.parquet(p) if self._is(p) else None for p in part.values())
            if added is not None or removed is not None:
                df = Delta(added, removed).on(df, KEYS[name])
        return df

    def undo(self) -> int | None:
        """Forget the newest version; the number of the one that is current then."""
        have = self.versions()
        if have:
            self._fs.delete(self._path(f"{self.path}/v{have[-1]}"), True)
        return have[-2] if len(have) > 1 else None

    def vacuum(self, keep: int = 2 * COMPACT) -> list[int]:
        """Delete the versions that none of the newest ``keep`` ones needs; the numbers of those deleted."""
        have = self.versions()
        if len(have) <= keep:
            return []
        oldest = have[-keep]
        need = min([oldest, *(b for b in (self._chain(n, oldest)[0] for n in TABLES) if b is not None)])
        gone = [v for v in have if v < need]
        for v in gone:
            self._fs.delete(self._path(f"{self.path}/v{v}"), True)
        return gone

    @contextmanager
    def transaction(self) -> Iterator[dict[str, DataFrame | Delta]]:
        """Collect tables in the dictionary given; they become one version at the end, or nothing if an error occurs."""
        tables: dict[str, DataFrame | Delta] = {}
        yield tables
        if tables:
            self.write(tables)


class Trace:
    """Spans (id, parent_id, start, end, message) of the driver, written as CSV."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int | None, float, float, str]] = []
        self._open: list[int] = []
        self._next = 0

    @contextmanager
    def span(self, message: str) -> Iterator[None]:
        me, self._next = self._next, self._next + 1
        parent = self._open[-1] if self._open else None
        self._open.append(me)
        start = time.time()
        try:
            yield
        finally:
            self._open.pop()
            self.rows.append((me, parent, start, time.time(), message))

    def write(self, spark: SparkSession, path: str) -> None:
        df = spark.createDataFrame(self.rows, "id long, parent_id long, start double, end double, message string")
        df.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
