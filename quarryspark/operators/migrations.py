"""Numbered migrations of the state: discovery, history, and changes of tables in one commit each.

A migration is a file ``<number>_<name>.sql``. Its statements, each ended by a semicolon, either make a table
(``CREATE TABLE name (columns)``) or give one a column (``ALTER TABLE name ADD COLUMN column type``); older
files of the table read the new column as null, so nothing is written again.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarryspark.operators.schemas import TABLES, EngineError
from quarryspark.operators.state import StateStore, append

CREATE = re.compile(r"create\s+table\s+(\w+)\s*\((.*)\)", re.I | re.S)
ADD = re.compile(r"alter\s+table\s+(\w+)\s+add\s+column\s+(\w+\s+\w+)", re.I)
#: SQL names of column types that migrations use, as Spark has them.
KINDS = {"text": "string", "integer": "long", "real": "double"}


def version_of(name: Column) -> Column:
    """The number of a migration's file name, null for other files."""
    return F.nullif(F.regexp_extract(name, r"^([0-9]{1,9})_[A-Za-z0-9_\-]+\.sql$", 1), F.lit("")).cast("int")


def discovered(files: DataFrame) -> DataFrame:
    """version, name of the migrations among (name), in the order in which they are applied."""
    return files.select(version_of(F.col("name")).alias("version"), "name").where("version IS NOT NULL").orderBy("version", "name")


def duplicates(found: DataFrame) -> DataFrame:
    """version, files: numbers that more than one file has."""
    return found.groupBy("version").agg(F.count(F.lit(1)).alias("files")).where("files > 1")


def pending(found: DataFrame, applied: DataFrame) -> DataFrame:
    """The migrations whose version the history lacks, in order."""
    return found.join(applied.select("version"), "version", "left_anti").orderBy("version")


def _spark_type(column: str) -> str:
    name, kind = column.split()[:2]
    return f"{name} {KINDS.get(kind.lower(), kind.lower())}"


def changes(text: str, columns: dict[str, str]) -> dict[str, str]:
    """table -> columns after the statements of a migration; columns: as they are before."""
    out: dict[str, str] = {}
    plain = re.sub(r"--[^\n]*", "", text)
    for statement in filter(None, map(str.strip, plain.split(";"))):
        if made := CREATE.fullmatch(statement):
            name, body = made[1], ", ".join(_spark_type(c) for c in made[2].split(","))
            if name in columns or name in out:
                raise EngineError("state_error", f"the table {name} is there already")
            out[name] = body
        elif added := ADD.fullmatch(statement):
            name, column = added[1], _spark_type(added[2])
            before = out.get(name) or columns.get(name)
            if before is None or column.split()[0] in StructType.fromDDL(before).names:
                raise EngineError("state_error", f"the table {name} can't take the column {column.split()[0]}")
            out[name] = f"{before}, {column}"
        else:
            raise EngineError("state_error", "a migration makes tables or adds columns only")
    return out


def apply_all(store: StateStore, folder: str, now: str) -> list[int]:
    """Apply what the history lacks, lowest number first; each with its history row in one commit. Returns the numbers."""
    if not os.path.isdir(folder):
        raise EngineError("not_found", "no such migration folder")
    spark = store.spark
    names = [(n,) for n in os.listdir(folder) if os.path.isfile(os.path.join(folder, n))]
    found = discovered(spark.createDataFrame(names, "name string"))
    if twice := duplicates(found).orderBy("version").first():
        raise EngineError("state_error", f"migration {twice['version']} is there twice")
    done = []
    for row in pending(found, store.table("schema_migrations")).collect():
        with open(os.path.join(folder, row["name"]), encoding="utf-8") as f:
            made = changes(f.read(), TABLES | store.manifest().get("columns", {}))
        with store.transaction(columns=made) as tables:
            tables["schema_migrations"] = append(tables["schema_migrations"], spark.createDataFrame([(row["version"], now)], "version int, applied_at string"))
        done.append(row["version"])
    return done
