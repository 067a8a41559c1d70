"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspark.llm import ann, bpe, exact_dedup, langid, mixing, pack, periodic, quality, simhash, toxicity, url_filter, whiten, window_pack
from quarryspark.llm.common import held_out, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), tokenizer_path(), row_len=2048, pad_id=49407)


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return url_filter.judge(table(spark, sf_dir, "pages"), labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(F.col("label_id")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_texts(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"), words=3, radius=3)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(F.col("label_id")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "keep")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"), components=32)


def op12_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = window_pack.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, row_len=4096)
    return placed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def echoed(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document in ten, by its id: the words from a place that the id names are those from there, again and again."""
    own, turn = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if doc_id is None or turn or not n:
        return None
    first, place = own % n, np.arange(n)
    period = 1 + (n - first) // (3 + own % 8)
    return np.where(place < first, place, first + (place - first) % period)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf_dir, "documents"), least=24, power=3, rewrite=echoed)
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period)), "")
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"), best.period.alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_pack_tokens, op2_url_reputation, op3_toxicity, op4_mix_sources, op5_bpe_codec, op6_language_id, op7_exact_dedup, op8_simhash, op9_quality, op10_nearest, op11_whitening, op12_pack_windows, op13_periodic_runs)}

ORACLE_SQL = {"op2_url_reputation": url_filter.oracle(), "op4_mix_sources": mixing.oracle(), "op7_exact_dedup": exact_dedup.ORACLE}
