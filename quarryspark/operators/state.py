"""Snapshot store: tables are Parquet, a commit is a new version directory and one pointer rename.

A table is a list of parts; rows that are only appended become a further part, and after ``most_parts`` of them the
table is written as one. Every mutation is a pure function from tables to tables. ``transaction`` holds an exclusive
lock (a lease: one that its writer did not give back is taken over when it has run out), checks keys, references and value sets of the tables that changed, writes only those, and
flips the pointer last; a failure leaves the old version current and removes the new one.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarryspark.functions.text import ascii_lower
from quarryspark.operators.schemas import CHECKS, REFERENCES, TABLES, UNIQUE, EngineError

Tables = dict[str, DataFrame]


def constraint_violations(tables: Tables, only: set[str] | None = None) -> DataFrame:
    """table, rule, violations: one row per rule that is broken."""
    names = only or set(tables)
    parts = []

    def add(df: DataFrame, table: str, rule: str) -> None:
        parts.append(df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), "violations"))

    for t in sorted(names & set(tables)):
        df = tables[t]
        for key in UNIQUE.get(t, []):
            cols = [ascii_lower(F.col("title")).alias("key") if k == "lower title" else F.col(k) for k in key]
            add(df.groupBy(*cols).count().where("count > 1"), t, f"unique({', '.join(key)})")
        for check in CHECKS.get(t, []):
            add(df.where(f"NOT coalesce({check}, false)"), t, check)
    for t, key, parent in REFERENCES:
        if parent in tables and t in tables and (t in names or parent in names):
            target = UNIQUE[parent][0][0]
            keys = tables[parent].select(F.col(target).alias("referenced"))
            add(tables[t].where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("referenced"), "left_anti"), t, f"{key} references {parent}")
    if not parts:
        any_table = next(iter(tables.values()))
        return any_table.sparkSession.createDataFrame([], "table string, rule string, violations long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("violations > 0")


class StateStore:
    def __init__(self, spark: SparkSession, root: str, lease_s: float = 3600.0, most_parts: int = 32):
        self.spark, self.root, self.lease_s, self.most_parts = spark, root, lease_s, most_parts

    @property
    def _pointer(self) -> str:
        return os.path.join(self.root, "CURRENT")

    def initialize(self) -> bool:
        """Create version 0 with empty tables; True if it was not there yet."""
        os.makedirs(self.root, exist_ok=True)
        if os.path.exists(self._pointer):
            return False
        self._point({"version": 0, "tables": {}})
        return True

    def _point(self, manifest: dict) -> None:
        tmp = f"{self._pointer}.tmp"
        try:
            with open(tmp, "w", encoding="utf-8") as f:
                json.dump(manifest, f, sort_keys=True)
                f.flush()
                os.fsync(f.fileno())
            os.replace(tmp, self._pointer)
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(tmp)

    def manifest(self) -> dict:
        try:
            with open(self._pointer, encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            raise EngineError("invalid_state", "the project is not initialized") from None

    def table(self, name: str) -> DataFrame:
        manifest = self.manifest()
        kind = self._schema(manifest, name)
        return self._read(manifest["tables"].get(name, []), kind)

    def _read(self, paths: list[str], kind: StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(os.path.join(self.root, p) for p in paths))  # a column added since then is null

    @staticmethod
    def _schema(manifest: dict, name: str) -> StructType:
        """The table's schema with the columns that migrations have given it."""
        return StructType.fromDDL(manifest.get("columns", {}).get(name) or TABLES[name])

    def tables(self) -> Tables:
        return {n: self.table(n) for n in {**TABLES, **self.manifest().get("columns", {})}}

    @staticmethod
    def _owner(lock: str) -> str | None:
        try:
            with open(lock, encoding="utf-8") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def _locked(self, wait_s: float) -> tuple[str, str]:
        """The lock's path and this owner's mark, once the lock is held."""
        lock, until = os.path.join(self.root, "LOCK"), time.monotonic() + wait_s
        while True:
            owner = json.dumps({"owner": uuid.uuid4().hex, "until": time.time() + self.lease_s})
            mine = f"{lock}.{uuid.uuid4().hex}"
            try:
                with open(mine, "w", encoding="utf-8") as f:
                    f.write(owner)
                os.link(mine, lock)  # fails if it is there; its content is there at once
                return lock, owner
            except FileExistsError:
                held = self._owner(lock)
                if held is not None and json.loads(held or '{"until": 0}')["until"] < time.time():
                    with contextlib.suppress(FileNotFoundError):
                        os.replace(lock, f"{lock}.stale")  # one of the waiting writers gets it
                elif time.monotonic() > until:
                    raise EngineError("state_error", "another writer holds the state") from None
                else:
                    time.sleep(0.05)
            finally:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(mine)

    @contextlib.contextmanager
    def transaction(self, wait_s: float = 5.0, columns: dict[str, str] | None = None) -> Iterator[Tables]:
        """Yields the tables; those replaced in the mapping are checked, written and made current on exit.

        columns: tables that this transaction makes, or gives further columns, with their schemas.
        """
        lock, owner = self._locked(wait_s)
        manifest = self.manifest()
        if columns:
            manifest["columns"] = manifest.get("columns", {}) | columns
        version = manifest["version"] + 1
        new_dir = os.path.join(self.root, f"v={version}")
        try:
            before = self.tables()
            now = dict(before)
            yield now
            changed = {n for n in now if now[n] is not before[n]}
            paths = dict(manifest["tables"])
            for n in changed:
                base, rows = getattr(now[n], "appended", (None, None))
                kept = paths.get(n, [])
                if base is not before[n] or len(kept) >= self.most_parts:  # no mere append, or enough small parts
                    kept, rows = [], now[n]
                paths[n] = [*kept, f"v={version}/{n}"]
                rows.select(*self._schema(manifest, n).names).write.parquet(os.path.join(self.root, paths[n][-1]))
            written = {n: self._read(paths.get(n, []), self._schema(manifest, n)) if n in changed else before[n] for n in now}
            broken = constraint_violations(written, changed).limit(20).collect() if changed else []
            if broken:
                raise EngineError("state_error", "; ".join(f"{r['table']}: {r['rule']}" for r in broken))
            if self._owner(lock) != owner:
                raise EngineError("state_error", "the lease on the state ran out")
            if changed or columns:
                self._point(manifest | {"version": version, "tables": paths})
        except BaseException:
            shutil.rmtree(new_dir, ignore_errors=True)
            raise
        finally:
            if self._owner(lock) == owner:
                os.remove(lock)


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with further rows. A transaction writes only the rows, beside what is there."""
    out = table.unionByName(rows.select(*table.columns))
    out.appended = (table, rows)
    return out


def replace_rows(table: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """The rows take the place of those with their keys."""
    return append(table.join(rows.select(key).distinct(), key, "left_anti").select(*table.columns), rows)


def overlay(table: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """UPDATE by key: columns of ``changes`` other than the key replace the table's, null included."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, F.struct(*names).alias("_new"))
    joined = table.join(new, key, "left")
    return joined.select(*(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns))


def compare_and_set(proposals: DataFrame, which: Column, expected: str, **values) -> DataFrame:
    """Of the rows of ``which``, those whose status is ``expected`` take the values; others stay."""
    hit = F.coalesce(which, F.lit(False)) & F.coalesce(F.col("status") == expected, F.lit(False))
    return proposals.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})
