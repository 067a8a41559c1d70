"""Deterministic evidence selection for a concept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.functions.text import has_phrase, match_text
from quarryspark.operators.ingest import latest_versions
from quarryspark.operators.schemas import ConceptSpec, EngineError


def _normal(phrase: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in phrase.lower()).split())


def relevance(name: Column, text: Column, spec: ConceptSpec) -> Column:
    """Presence of each phrase in the normalised name and text, weighed; both already normalised."""
    phrases = [(spec.title, "title"), *((a, "alias") for a in spec.aliases), *((k, "keyword") for k in spec.keywords)]
    score = F.lit(0)
    for phrase, kind in phrases:
        in_name, in_text = spec.weights[kind]
        p = _normal(phrase)
        score = score + F.when(has_phrase(name, p), in_name).otherwise(0) + F.when(has_phrase(text, p), in_text).otherwise(0)
    return score.cast("int")


def ready(status: Column, text: Column) -> Column:
    return status.isin("native", "reviewed") & (text != "")


def missing_of(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted source_ids that are no active source."""
    return wanted.select("source_id").join(sources.where("archived_at IS NULL"), "source_id", "left_anti")


def missing_sources(sources: DataFrame, wanted: list[str]) -> str | None:
    """The smallest wanted id that is no active source."""
    if not wanted:
        return None
    ids = sources.sparkSession.createDataFrame([(w,) for w in wanted], "source_id string")
    return missing_of(sources, ids).agg(F.min("source_id")).first()[0]


def select_evidence(sources: DataFrame, versions: DataFrame, pages: DataFrame, spec: ConceptSpec, only: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """Ready pages of the latest version of active sources with a positive score, best first."""
    if only and (gone := missing_sources(sources, only)):
        raise EngineError("not_found", f"source is missing or archived: {gone}")
    active = sources.where("archived_at IS NULL")
    if only:
        active = active.where(F.col("source_id").isin(only))
    latest = latest_versions(versions).select("source_id", "source_version_id")
    dim = active.select("source_id", "display_name", "source_kind", match_text(F.col("display_name")).alias("sort_name")).join(latest, "source_id")
    found = pages.where(ready(F.col("text_status"), F.col("text"))).join(dim, "source_version_id")
    # a text is normalised once; the generator keeps the planner from copying the expression into every phrase
    once = found.select("*", F.explode(F.array(match_text(F.col("text")))).alias("matched"))
    scored = once.withColumn("score", relevance(F.col("sort_name"), F.col("matched"), spec)).where("score > 0")
    out = scored.select("score", "sort_name", "source_id", "display_name", "source_kind", "source_version_id", "page_number", "page_id", "text", "text_status")
    return out.orderBy(F.desc("score"), "sort_name", "source_id", "page_number", "page_id") if ordered else out
