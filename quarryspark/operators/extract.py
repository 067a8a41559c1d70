"""Page extraction: native text, else OCR, else a failed page; page ids survive re-extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.functions.text import usable_native, visible
from quarryspark.operators.schemas import EngineError


def cascade(pages: DataFrame) -> DataFrame:
    """native_text, ocr_ok, ocr_text -> text, text_status, text_sha256."""
    native = usable_native(F.col("native_text"))
    ocr = F.coalesce(F.col("ocr_ok"), F.lit(False)) & visible(F.col("ocr_text"))
    text = F.when(native, F.col("native_text")).when(ocr, F.col("ocr_text")).otherwise("")
    status = F.when(native, "native").when(ocr, "ocr_unreviewed").otherwise("failed")
    return pages.withColumns({"text": text, "text_status": status}).withColumn("text_sha256", F.sha2("text", 256)).drop("native_text", "ocr_ok", "ocr_text")


def text_pages(versions: DataFrame, contents: DataFrame) -> DataFrame:
    """Markdown and text sources: one native page each, verbatim. contents: source_version_id, content."""
    text = F.col("content").cast("string")
    return versions.join(contents, "source_version_id").select("source_version_id", F.lit(1).alias("page_number"), F.lit(None).cast("string").alias("image_path"), text.alias("text"), F.lit("native").alias("text_status"), F.sha2(text, 256).alias("text_sha256"))


def upsert_pages(old: DataFrame, new: DataFrame, new_id: Column) -> DataFrame:
    """Pages by (version, number): an old page keeps its id and takes the new text; pages that vanished stay."""
    keys = ["source_version_id", "page_number"]
    rest = ["image_path", "text", "text_status", "text_sha256"]
    o = old.select(*keys, F.col("page_id").alias("old_id"), F.struct(*rest).alias("o"))
    n = new.select(*keys, F.struct(*rest).alias("n"), new_id.alias("new_id"))
    joined = o.join(n, keys, "full")
    return joined.select(F.coalesce("old_id", "new_id").alias("page_id"), *keys, *(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest))


def pages_of(pages: DataFrame, version, number: int | None = None) -> DataFrame:
    """A version's pages in their order, or the one page of that number."""
    own = pages.where(F.col("source_version_id") == version)
    return (own if number is None else own.where(F.col("page_number") == number)).orderBy("page_number")


def cited_pages(pages: DataFrame, citations: DataFrame) -> DataFrame:
    return pages.join(citations.select("page_id").distinct(), "page_id", "left_semi")


def run_status(pages: DataFrame) -> DataFrame:
    """Pages and failed pages of each version; a run with a failed page has failed."""
    return pages.groupBy("source_version_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("text_status") == "failed").alias("failed_pages")).withColumn("status", F.when(F.col("failed_pages") > 0, "failed").otherwise("completed"))


def check_page_numbers(pages: DataFrame) -> None:
    """Rendered pages must be 1 .. n without a gap."""
    bad = pages.groupBy("source_version_id").agg(F.max("page_number").alias("last"), F.countDistinct("page_number").alias("n"), F.min("page_number").alias("first")).where("last != n OR first != 1").limit(1).collect()
    if bad:
        raise EngineError("external_failure", "rendered pages are missing or out of order")


def corrected(pages: DataFrame, page_id: str, text: str) -> DataFrame:
    """The page takes a reviewed text."""
    hit = F.col("page_id") == page_id
    return pages.withColumns({"text": F.when(hit, F.lit(text)).otherwise(F.col("text")), "text_status": F.when(hit, "reviewed").otherwise(F.col("text_status")), "text_sha256": F.when(hit, F.sha2(F.lit(text), 256)).otherwise(F.col("text_sha256"))})
