"""Exact dedup with an extendible-hash index on shared files; built-in functions only.

1. Entries: one pass reduces each row to (row, doc_id, h, digest) of its normalised text; rows of
   equal (h, digest) are one entry with their number and smallest doc_id, aggregated by task first.
2. Directory: a slot for each value of the hash's first ``depth`` bits. It starts with one bucket; while
   a bucket holds over ``CAPACITY`` entries it splits by one more bit, and the directory doubles when that
   bucket already uses all of its bits. Splits are worked out from the counts of a finer grid of
   cells, level by level, as tables; the directory is a table too, of slots and their buckets.
3. Owners: an entry finds its bucket through the directory. Owner tasks take ranges of buckets; in each
   bucket the entries of one hash form a chain, in digest order, and get their link's number. The
   owner decides an entry that is alone with its hash and has one row; the other chains' texts
   are compared byte by byte: rows of these chains only come back with their texts, which are
   grouped by bytes, by task first, so that a group of copies is one row before it is shuffled.
4. Each row takes the keeper of its entry. Should two texts share hash and digest, their
   rows find their keeper by the bytes instead.

The index (bucket, h, link, chain, digest, keep_id, n) is written to the shared folder, in bucket order.
A bucket's capacity is the same at every size. Hot groups are one row of a side in every join of short rows, which
is broadcast if counted to be small, and salted for them if not.

Edge cases: a null text counts as empty; the texts need no limit on length; of equal texts
the smallest doc_id stays (rows that repeat that doc_id all stay in ``exact_groups``; ``drop_copies``
keeps one of them); a null doc_id never stays over another; an empty table gives an empty
result; other columns are ignored, and passed on by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryspark.llm.common import discard, keep_one, meet, sized, spill

#: Entries of a bucket, at most, unless they share all bits that are looked at; bits of cells beyond an even spread.
CAPACITY, FINER = 16_384, 4


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; single spaces are left as they stand."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x09-\x0D\x20]*|\x20[\x09-\x0D\x20]+", " ")


def top_bits(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def _right(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


def directory(entries: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, bits) for each slot, and the directory's depth. entries: h."""
    total = entries.count()
    finest = (max(0, total // capacity).bit_length() + FINER) if total > capacity else 0
    cells = entries.groupBy(top_bits(F.col("h"), finest).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    grown = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("bits"))
    levels = grown.groupBy("bits", _right(F.col("cell"), F.lit(finest) - F.col("bits")).alias("bucket")).agg(F.sum("n").alias("n"))
    over = levels.where(F.col("n") > capacity).select((F.col("bits") + 1).alias("bits"), F.col("bucket").alias("up"))
    fits = levels.where((F.col("n") <= capacity) | (F.col("bits") == finest))
    # a bucket is as wide as it can be: the one that it was split from was overfull
    split = fits.where("bits > 0").withColumn("up", _right(F.col("bucket"), F.lit(1))).join(over, ["bits", "up"], "left_semi").select("bits", "bucket")
    buckets = fits.where("bits = 0").select("bits", "bucket").unionByName(split)
    depth = buckets.agg(F.max("bits")).first()[0] or 0
    spare = F.lit(depth) - F.col("bits")
    first = F.call_function("shiftleft", F.col("bucket"), spare)
    slots = buckets.select(first.alias("bucket"), "bits", F.explode(F.sequence(first, first + F.call_function("shiftleft", F.lit(1).cast("long"), spare) - 1)).alias("slot"))
    return spill(slots, "directory", 1 << depth), depth


def build_index(keys: DataFrame, total: int, capacity: int = CAPACITY) -> DataFrame:
    """bucket, bits, h, link, chain, digest, keep_id, n: entries by owner task. keys: h, digest, doc_id; total: rows of it."""
    entries = spill(keys.groupBy("h", "digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "entries", total)
    slots, depth = directory(entries, capacity)
    placed = entries.withColumn("slot", top_bits(F.col("h"), depth)).join(sized(slots), "slot")
    owned = placed.repartitionByRange("bucket", "h")
    chain = Window.partitionBy("bucket", "h")
    owned = owned.withColumns({"link": F.row_number().over(chain.orderBy("digest")), "chain": F.count(F.lit(1)).over(chain)})
    index = spill(owned.sortWithinPartitions("bucket", "h", "link").select("bucket", "bits", "h", "link", "chain", "digest", "keep_id", "n"), "index", total)
    discard(entries, slots)
    return index


def exact_groups(df: DataFrame, capacity: int = CAPACITY, key: Column | None = None, digest: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of (doc_id, text).

    key and digest (of the normalised text, column ``t``): other hashes; tests pass weak ones to make collisions.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("t"))
    h = F.xxhash64("t") if key is None else key
    sha = F.sha2("t", 256)
    weak = digest is not None
    keys = spill(rows.select("doc_id", h.alias("h"), (digest if weak else sha).alias("digest"), *([sha.alias("sha")] if weak else [])), "keys")
    total = keys.count()
    index = build_index(keys, total, capacity)

    # chains of more than one row have their bytes compared, under whatever digest
    contested = index.where("n > 1 OR chain > 1")
    texts = rows.withColumn("h", h).join(sized(contested.select("h").distinct()), "h", "left_semi")
    by_bytes = texts.groupBy("h", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = spill(by_bytes.select("h", (digest if weak else sha).alias("digest"), "keep_id", "n"), "groups", total)
    told = groups.groupBy("h", "digest").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    clash = told.where("texts > 1").select("h", "digest")
    alone = told.where("texts = 1 AND n > 1").select("h", "digest", "keep_id", "n")
    out = meet(keys, alone, ["h", "digest"])
    out = out.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.col("sha" if weak else "digest").alias("text_sha256"), "h", "digest")
    if clash.isEmpty():
        out = out.drop("h", "digest")
    else:
        shared = spill(clash, "clash", total)
        again = rows.withColumns({"h": h, "digest": digest if weak else sha}).join(sized(shared), ["h", "digest"], "left_semi")
        owners = again.groupBy("h", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        resolved = again.join(owners, ["h", "t"]).select("doc_id", "keep_id", "group_size", sha.alias("text_sha256"))
        out = out.join(shared, ["h", "digest"], "left_anti").drop("h", "digest").unionByName(resolved)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that stay: one of each group of equal texts. By id and text, as ids can be null or repeat."""
    named = exact_groups(df).select("doc_id", F.col("text_sha256").alias("sha"), F.col("kept").alias("keep"))
    return keep_one(df, named, F.sha2(normalised(df["text"]), 256), df.count())


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
