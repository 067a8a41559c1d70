"""Toxicity: boosted trees over dense text features, calibrated by isotonic regression.

The features of a whole text are densities of a learned lexicon (plain and after undoing
character swaps), hits near second-person words, capitals, punctuation and obfuscation rates
and shape statistics. The lexicon is learned from document frequencies in one part of the
labelled sample, the trees from another and the calibration from a third, so that none of
them sees rows it was tuned on. The sample is bounded by ``SAMPLE`` rows; scoring reads
every row.

Edge cases: null texts count as empty and get a score like any other text; rows without a
label teach nothing; without labels of both kinds the score is the base rate; long texts are
read whole; repeated rows, repeated labels and extra columns change nothing else; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.llm.common import released, short_batches, spill
from quarryspark.llm.gbt import Boosted, Isotonic

#: Labelled rows to fit on, about, at most; lexicon entries, at most.
SAMPLE, LEXICON = 20_000, 256
#: Second-person words of the languages at hand; characters that stand in for letters.
SECOND_PERSON = frozenset("you your yours u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú usted ustedes vosotros tus".split())
SWAPS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t", "€": "e"})
EDGES = ".,;:!?\"'()[]{}<>|*_#%&$/\\-+=~`^"
MIXED = re.compile(r"[^\W\d_][0-9@$!*.\-_]+[^\W\d_]")
NEAR = 4
N_FEATURES = 18


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, label: str, most: int = SAMPLE) -> DataFrame:
    """The columns of docs and y for about ``most`` labelled doc_ids, chosen by a hash; one row of each, the smallest."""
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("label_id").isNotNull())
    known = known.where(learn).groupBy("label_id").agg(F.max("y").alias("y"))
    known = spill(known, "labels", labels.count())
    share = min(1.0, most / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("label_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
    # at most about ``most`` pairs of numbers: a proven bound
    found = docs.join(F.broadcast(chosen), docs["doc_id"].cast("long") == chosen["label_id"])
    return found.groupBy("label_id", "y").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*", "y")


def lexicon(sample: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """word -> cautious log odds of label 1, from document frequencies."""
    n, pos = sample.agg(F.count(F.lit(1)), F.sum("y")).first()
    pos = pos or 0
    if not pos or pos == n:
        return {}
    words = sample.select("y", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where("word != ''")
    seen = words.groupBy("word").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).where(F.col("p") >= max(3, math.ceil(0.01 * pos)))
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (n - pos + 1)) - 2 / F.sqrt(F.col("p"))
    return {r["word"]: r["odds"] for r in seen.select("word", odds.alias("odds")).where("odds > 1").orderBy(F.desc("odds"), "word").limit(most).collect()}


def features(text: str | None, weights: dict[str, float]) -> list[float]:
    text = text or ""
    tokens = text.lower().split()
    n = max(1, len(tokens))
    distinct = set(tokens)
    plain, swapped = {}, {}
    for w in distinct:
        bare = w if w in weights else w.strip(EDGES)
        if bare in weights:
            plain[w] = weights[bare]
        elif not bare.isalpha() and len(bare) < 40:
            bare = bare.translate(SWAPS)
            bare = bare if bare in weights else "".join(filter(str.isalpha, bare))
            if bare in weights:
                swapped[w] = weights[bare]
    hits = near = obfuscated = 0
    total = 0.0
    if plain or swapped:
        both = plain | swapped
        at = [i for i, w in enumerate(tokens) if w in both]
        hits, total = len(at), sum(both[tokens[i]] for i in at)
        obfuscated = sum(tokens[i] in swapped for i in at)
        near = sum(any(w.strip(EDGES) in SECOND_PERSON for w in tokens[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
    count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    capitals, letters = int(count[65:91].sum()), int(count[65:91].sum() + count[97:123].sum() + count[0xC0:].sum())
    size = max(1, int(count.sum()))
    signs = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    return [
        hits, len(plain) + len(swapped), hits / n, total, total / n, max([0.0, *plain.values(), *swapped.values()]), obfuscated, len(MIXED.findall(text)) / n if signs else 0.0, near,
        capitals / max(1, letters), int(count[33]) / n, int(count[63]) / n, signs / size, int(count[35:39].sum() + count[42] + count[64] + count[124]) / size, int(count[48:58].sum()) / size,
        math.log1p(len(tokens)), letters / n, len(distinct) / n,
    ]


def feature_rows(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    import pyarrow as pa

    short_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            x = [[float(v) for v in features(t, weights)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    return df.select("doc_id", "y", "text").mapInArrow(released(run), "doc_id long, y int, x array<double>")


def fit(sample: DataFrame) -> tuple[dict[str, float], Boosted, Isotonic]:
    """Lexicon, trees and calibration from (doc_id, text, y)."""
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(5))
    sample = spill(sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "y", part.alias("part")), "sample")
    weights = lexicon(sample.where("part < 2"))
    rows = feature_rows(sample.where("part >= 2"), weights).withColumn("part", part).toPandas()  # bounded by SAMPLE
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), N_FEATURES)
    y, last = rows["y"].to_numpy(float), rows["part"].to_numpy() == 4
    trees = Boosted().fit(x[~last], y[~last])
    return weights, trees, Isotonic().fit(trees.raw(x[last]), y[last])


def score(df: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id, score, predicted of every row of (doc_id, text). learn: on labels' ``label_id``, the rows to learn from."""
    import pyarrow as pa

    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = df.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, learn, "toxic")))
    short_batches(df.sparkSession)

    def run(batches):
        weights, trees, calibrate = model.value
        for batch in batches:
            x = np.array([features(t, weights) for t in batch.column("text").to_pylist()], float).reshape(-1, N_FEATURES)
            p = calibrate(trees.raw(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(released(run), "doc_id long, score double, predicted int")
