"""Connected components over an edge table: alternating large-star and small-star steps.

Edges stay distributed; each step is a grouped minimum (partially aggregated, so a hub is one
row per task) and a join. A hub that many rows link to is salted in that join: its minimum is
copied to as many salts as its links need, so no task gets more than about ``HUB`` of them. Every round is written to the
shared folder, and then the one before is deleted. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark.llm.common import discard, sized, spill


#: Links of a node that a task joins, about.
HUB = 2_000


def _with_low(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """edges (a, b) and their a's ``low``; low (a, low, n): n links have that a; total: links at most."""
    hubs = low.where(F.col("n") > HUB).select("a", F.ceil(F.col("n") / HUB).cast("int").alias("salts"))
    hubs = sized(hubs, total // HUB)  # no more can be hubs
    salted = edges.join(hubs, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int"))
    copies = low.select("a", "low", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / HUB).cast("int"), F.lit(1)) - 1)).alias("salt"))
    return salted.join(copies, ["a", "salt"]).select("a", "b", "low")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "low").alias("low"), "n")
    return _with_low(both, low, 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
    linked = _with_low(edges, low, total).where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return linked.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame, most: int) -> DataFrame:
    """node, root: for every node that is not the smallest of its component. edges: (a, b) longs, any direction, repeats allowed; those with a null are no edges; most: edges at most."""
    now = spill(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", most)
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
        before, stars = now, spill(_large_star(now, seen[0]), "stars", 2 * seen[0])
        now = spill(_small_star(stars, 2 * seen[0]), "edges", 2 * seen[0])
        discard(before, stars)
