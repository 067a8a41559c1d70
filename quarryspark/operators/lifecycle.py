"""Proposal life cycle: pending -> approved -> applied, pending -> rejected, pending or approved -> superseded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.functions.text import ascii_lower


def superseded(proposals: DataFrame, article_id: str | None) -> DataFrame:
    """Open work on the article (or, for a new one, open create proposals) gives way."""
    target = F.col("article_id") == article_id if article_id is not None else F.col("article_id").isNull() & (F.col("operation") == "create_article")
    return proposals.withColumn("status", F.when(F.coalesce(target, F.lit(False)) & F.col("status").isin("pending", "approved"), "superseded").otherwise(F.col("status")))


def supersede_older(proposals: DataFrame, *order: Column) -> DataFrame:
    """Bulk form: of each article's open proposals all but the newest are superseded."""
    open_ = F.col("status").isin("pending", "approved")
    newest = proposals.where(open_).groupBy("article_id").agg(F.max(F.struct(*order)).alias("newest"))
    return proposals.join(newest, "article_id", "left").withColumn("status", F.when(open_ & (F.struct(*order) < F.col("newest")), "superseded").otherwise(F.col("status"))).drop("newest")


def one(proposals: DataFrame, proposal_id) -> DataFrame:
    """The proposal of that id, if there is one."""
    return proposals.where(F.col("proposal_id") == proposal_id).limit(1)


def titled(articles: DataFrame, titles: DataFrame) -> DataFrame:
    """The articles of (wanted) titles, whatever the case of A-Z."""
    wanted = titles.select(ascii_lower(F.col("wanted")).alias("_title")).distinct()
    return articles.join(wanted, ascii_lower(F.col("title")) == F.col("_title"), "left_semi")


def listed(proposals: DataFrame, status: str | None = None) -> DataFrame:
    rows = proposals.where(F.col("status") == status) if status else proposals
    return rows.orderBy(F.desc("created_at"), F.desc("proposal_id"))


