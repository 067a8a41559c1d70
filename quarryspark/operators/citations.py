"""Citations: byte spans, checks against pages, numbering, first-wins insert, set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryspark.functions.text import byte_span, squeeze


def spans(text: Column, quote: Column) -> tuple[Column, Column]:
    """Byte start and end of the quote's first place in the text."""
    start = F.octet_length(F.call_function("substring_index", text, quote, F.lit(1))).cast("long")
    return start, start + F.octet_length(quote)


def issue(page_text: Column, start: Column, end: Column, quote: Column) -> Column:
    """At most one of: page_id, offsets, quote; null when the citation holds."""
    outside = (start < 0) | (start >= end) | (end > F.octet_length(page_text))
    return F.when(page_text.isNull(), "page_id").when(outside, "offsets").when(squeeze(byte_span(page_text, start, end)) != squeeze(quote), "quote")


#: Issue codes, and where below the citation each one points.
BELOW = {"page_id": "/page_id", "offsets": "", "quote": "/quote"}


def checked(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """The citations with ``issue`` and the canonical quote (the span's own text, squeezed, where it can be had)."""
    texts = pages.select("page_id", F.col("text").alias("page_text"))
    problem = issue(F.col("page_text"), F.col("start_char"), F.col("end_char"), F.col("quote"))
    span = squeeze(byte_span(F.col("page_text"), F.col("start_char"), F.col("end_char")))
    joined = citations.join(texts, "page_id", "left").withColumn("issue", problem)
    reachable = F.col("page_text").isNotNull() & ~F.coalesce(F.col("issue") == "offsets", F.lit(False))
    return joined.withColumn("canonical_quote", F.when(reachable, span).otherwise(F.col("quote"))).drop("page_text")


def flatten(proposals: DataFrame) -> DataFrame:
    """proposal_id, p (nested) -> one row per citation in document order, with its block's index.

    Block indexes run on over all sections of a key, and related concepts run on after the blocks of the
    related_concepts sections.
    """
    s = proposals.select("proposal_id", F.posexplode("p.sections").alias("s_pos", "s"))
    b = s.select("proposal_id", "s_pos", F.col("s.key").alias("section_key"), F.posexplode("s.blocks").alias("b_pos", "b"))
    blocks = b.select("proposal_id", "section_key", "s_pos", "b_pos", F.col("b.citations").alias("citations"))
    r = proposals.select("proposal_id", F.posexplode("p.related_concepts").alias("b_pos", "r"))
    related = r.select("proposal_id", F.lit("related_concepts").alias("section_key"), F.lit(2**31 - 1).alias("s_pos"), "b_pos", F.col("r.citations").alias("citations"))
    w = Window.partitionBy("proposal_id", "section_key").orderBy("s_pos", "b_pos")
    numbered = blocks.unionByName(related).withColumn("block_index", F.row_number().over(w) - 1)
    return numbered.select("proposal_id", "section_key", "block_index", F.posexplode("citations").alias("emit", "c")).select("proposal_id", "section_key", "block_index", "emit", "c.*")


def insert_or_ignore(rows: DataFrame) -> DataFrame:
    """The first emitted row of each (proposal, section, block, page, start)."""
    w = Window.partitionBy("proposal_id", "section_key", "block_index", "page_id", "start_char").orderBy("emit")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "emit")


KEY = ["section_key", "block_index", "page_id", "start_char", "end_char", "quote"]


def changed_sets(expected: DataFrame, stored: DataFrame, by: list[str], keys: list[str] = KEY) -> DataFrame:
    """The groups (by) whose sets of keys may differ: all that do, and equal ones whose repeats differ.

    Both sides go through one aggregation, and only digests are compared. Sets that differ have equal digests with a chance of
    about 2^-96.
    """
    side = lambda rows, sign: rows.select(*by, F.lit(sign).alias("side"), F.xxhash64(*keys).alias("a"), F.xxhash64(F.lit("again"), *keys).alias("b"))
    both = side(expected, 1).unionByName(side(stored, -1))
    halves = [F.sum(F.col("side") * h) for h in (F.col("a").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("a", 32))]
    told = both.groupBy(*by).agg(F.sum("side").alias("n"), *(h.alias(f"h{k}") for k, h in enumerate(halves)), F.bit_xor("b").alias("mixed"))
    return told.where("n <> 0 OR h0 <> 0 OR h1 <> 0 OR mixed <> 0").select(*by)


def set_difference(expected: DataFrame, stored: DataFrame, keys: list[str] = KEY, by: list[str] | None = None) -> DataFrame:
    """Keys on one side only, with the side; empty means equal sets. by: compare the groups of these columns each.

    Only groups whose digests differ are compared row by row.
    """
    own = by or ["_all"]
    a, b = ((df if by else df.withColumn("_all", F.lit(1))).select(*own, *(k for k in keys if k not in own)) for df in (expected, stored))
    groups = changed_sets(a, b, own, keys)
    a, b = (df.join(groups, on=[df[c].eqNullSafe(groups[c]) for c in own], how="left_semi").select(*dict.fromkeys([*(by or []), *keys])).distinct() for df in (a, b))
    return a.exceptAll(b).withColumn("side", F.lit("expected")).unionByName(b.exceptAll(a).withColumn("side", F.lit("stored")))


def evidence_of(citations: DataFrame, pages: DataFrame, versions: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations with their page, version and source, in document order."""
    page = pages.select("page_id", "source_version_id", "page_number", "text", "text_status")
    version = versions.select("source_version_id", "source_id", "sha256", "original_filename", "stored_path", "media_type")
    source = sources.select("source_id", "display_name", "source_kind")
    return citations.join(page, "page_id").join(version, "source_version_id").join(source, "source_id").orderBy("section_key", "block_index", "page_id", "start_char")


def article_rows(citations: DataFrame, existing: DataFrame, article_id: str) -> DataFrame:
    """An article's citation rows replaced by the distinct ones of its proposal."""
    kept = existing.where(F.col("article_id") != article_id)
    return kept.unionByName(citations.select(F.lit(article_id).alias("article_id"), "section_key", "block_index", "page_id").distinct())
