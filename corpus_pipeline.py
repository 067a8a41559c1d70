"""A training corpus from raw documents: quality, exact copies, near copies, mixture, token ids.

Every stage takes what its predecessor kept and returns the columns of ``documents``; the last
returns each kept document's token digests. ``run`` writes each stage to the shared folder, and deletes
it when its successor is written. A stage's table has a bounded number of files a core, however many
small splits it was read from.

Edge cases: null texts count as empty and null metadata as a value of its own in every stage; rows without a
doc_id are judged, compared and drawn like others; of rows that repeat doc_id and text one stays; texts of any
length are read whole; ties go as the operators say (smallest doc_id, then smallest hash); extra columns pass
through the first four stages; an empty table gives empty tables. What a document is given depends on its own
row, the statistics of all rows that its stage reads, and the labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspark.llm import bpe, exact_dedup, mixing, quality, queries, simhash
from quarryspark.llm.common import compact, discard, held_out, spill, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return compact(quality.keep_good(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("label_id"))))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return compact(exact_dedup.drop_copies(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return compact(simhash.drop_near_copies(docs, words=5, similarity=0.8))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return compact(mixing.keep_sampled(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # smaller pieces: the executors still hold what the stages before have grown to
    return compact(bpe.digest_texts(docs, queries.tokenizer_path(), piece=1 << 20))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("source_mixing", mixture),
    ("bpe_encoding", token_ids),
]

#: The classifier and the fingerprints have no SQL form; a brute-force version tests the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, spill(stage(spark, docs, sf_dir), name)
        if k:
            discard(before)
    return docs
