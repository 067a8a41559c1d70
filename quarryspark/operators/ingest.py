"""Content-addressed ingest: hash, global dedup, version append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryspark.functions.text import file_kind, media_type
from quarryspark.operators.state import Tables, append


def scanned(files: DataFrame) -> DataFrame:
    """path, content, seq -> name, kind, media type, hash and size; unsupported kinds stay, with a null kind."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    kind = file_kind(F.col("path"))
    return files.select("path", "seq", name.alias("original_filename"), kind.alias("source_kind"), media_type(kind).alias("media_type"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("byte_size"))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def find_by_hash(versions: DataFrame, sources: DataFrame, hashes: DataFrame) -> DataFrame:
    """Existing versions of these hashes, archived sources included."""
    return hashes.select("sha256").distinct().join(versions, "sha256").join(sources.select("source_id", "display_name", "source_kind", "archived_at"), "source_id")


def latest_versions(versions: DataFrame) -> DataFrame:
    """Each source's version of the highest insertion order; one partially aggregated row per source."""
    rest = [c for c in versions.columns if c not in ("source_id", "version_seq")]
    best = versions.groupBy("source_id").agg(F.max(F.struct("version_seq", *rest)).alias("v"))
    return best.select("source_id", "v.*").select(*versions.columns)


def ingest(tables: Tables, files: DataFrame, now: str, new_id) -> tuple[Tables, DataFrame]:
    """files: path, content, seq (import order). Returns the new tables and one result row per file.

    Equal bytes are one version whatever their name; the first in import order gives the version. A name and kind that
    is known gets a further version of its oldest source, else a new source. new_id(prefix, key column) makes ids.
    """
    seen = scanned(files)
    found = find_by_hash(tables["source_versions"], tables["sources"], seen)
    fresh = seen.where("source_kind IS NOT NULL").join(found.select("sha256"), "sha256", "left_anti")
    fresh = first_by(fresh, ["sha256"], F.col("seq"))
    known = first_by(tables["sources"], ["display_name", "source_kind"], F.col("created_at"), F.col("source_id"))
    known = known.select(F.col("display_name").alias("original_filename"), "source_kind", F.col("source_id").alias("known_id"))
    fresh = fresh.join(known, ["original_filename", "source_kind"], "left")
    made = F.coalesce("known_id", new_id("src_", F.concat_ws("\x00", "original_filename", "source_kind")))
    base = tables["source_versions"].agg(F.coalesce(F.max("version_seq"), F.lit(0)).alias("base"))
    fresh = fresh.withColumns({"source_id": made, "source_version_id": new_id("ver_", F.col("sha256"))})
    fresh = fresh.join(F.broadcast(base)).withColumn("version_seq", F.col("base") + 1 + F.col("seq"))  # one row
    text = lambda v: F.lit(v).cast("string")
    sources = first_by(fresh.where("known_id IS NULL"), ["source_id"], F.col("seq")).select("source_id", F.col("original_filename").alias("display_name"), "source_kind", text(now).alias("created_at"), text(None).alias("archived_at"))
    versions = fresh.select("source_version_id", "source_id", "sha256", "original_filename", F.concat_ws("/", F.lit("sources"), "source_id", "source_version_id", "original_filename").alias("stored_path"), "media_type", "byte_size", text(now).alias("imported_at"), "version_seq")
    out = dict(tables)
    out["sources"], out["source_versions"] = append(tables["sources"], sources), append(tables["source_versions"], versions)
    owner = out["source_versions"].select("sha256", "source_id", "source_version_id")
    return out, seen.join(owner, "sha256", "left").join(fresh.select("sha256", F.col("seq").alias("first_seq")), "sha256", "left").select("seq", "path", "source_kind", "sha256", "source_id", "source_version_id", F.col("seq").eqNullSafe(F.col("first_seq")).alias("created"))
