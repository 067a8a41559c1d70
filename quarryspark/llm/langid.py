"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 of its own, made from its code point. An n-gram's vector
binds (multiplies) its letters' vectors, each permuted (rolled) by its place; a text's vector bundles (adds)
those of all of its letter n-grams; a language's prototype bundles the unit vectors of the training rows. The mean of
all prototypes, which the languages share, is taken from prototypes and texts alike, and a text gets the
language with the largest cosine.

Bundling is linear, so prototypes are summed by task and language as vectors and a text's vector
is its counts of distinct n-grams times their vectors. Whole texts count: they are read a piece at a
time, and the letters beside a cut belong to the n-grams on both sides.

Score: the cosine's margin over the runner-up, put through 1 / (1 + exp(-5 m)); 0.5 is a tie.

Bounds: a prototype is DIM numbers and a language, whatever the table's size.

Edge cases: null texts and texts without a letter are ``und`` with score 0; letters count in lower case and composed
(NFC); ties go to the language that sorts first; rows without lang teach nothing; with no languages at all
everything is ``und``; with one it is that; an empty table gives an empty result; repeated rows get equal
results; null doc_ids stay null; other columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.llm.common import released, short_batches

#: Letters of an n-gram, its vector's length (a multiple of 64).
GRAM, DIM = 3, 1024
#: Characters of a text that are looked at together.
PIECE = 1 << 20


def letter_table() -> np.ndarray:
    """The lower-case letter of each code point; 0 for what is not a letter."""
    table = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = ord(unicodedata.normalize("NFC", c.lower())[0])
    return table


def letter_vectors(letters: np.ndarray, seed: int) -> np.ndarray:
    """The letters' vectors, from the bits of a hash; 0 stands for the edge of a word."""
    with np.errstate(over="ignore"):
        x = letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, DIM // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)
    return (bits.astype(np.int8) << 1) - 1


class Space:
    """The vectors of n-grams."""

    def __init__(self, table: np.ndarray, seed: int = 5):
        self.table, self.seed = table, seed

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """grams: rows of GRAM letters."""
        letters, place = np.unique(grams, return_inverse=True)
        own, place = letter_vectors(letters, self.seed), place.reshape(grams.shape)
        out = own[place[:, -1]]
        for i in range(GRAM - 1):
            out = out * np.roll(own, GRAM - 1 - i, axis=1)[place[:, i]]
        return out

    def bundle(self, text: str | None, piece: int = PIECE) -> np.ndarray | None:
        """The text's vector; None without a letter."""
        text = text or ""
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        total, some = np.zeros(DIM, np.float32), False
        for at in range(0, len(text), piece):
            beside = text[max(0, at - 1) : at + piece + 1]
            s = self.table[np.frombuffer(beside.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
            s = np.concatenate([[0] * (at == 0), s, [0] * (at + piece >= len(text))]).astype(np.int64)
            code = ((s[:-2] << 42) | (s[1:-1] << 21) | s[2:])[s[1:-1] > 0]
            if not len(code):
                continue
            code.sort()
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            found, n = code[first], np.diff(np.append(first, len(code)))
            grams = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], 1)
            for k in range(0, len(grams), 4096):
                total += n[k : k + 4096].astype(np.float32) @ self.vectors(grams[k : k + 4096]).astype(np.float32)
            some = True
        return total if some else None


def prototypes(df: DataFrame, space) -> dict[str, np.ndarray]:
    """Language -> bundle of its texts' unit vectors, over all rows of (text, lang). space: a broadcast Space."""
    import pyarrow as pa

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                v = space.value.bundle(text)
                if v is not None and (size := float(np.linalg.norm(v))):
                    sums.setdefault(lang, np.zeros(DIM))[:] += v / size
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    sums = df.select("text", "lang").mapInArrow(released(run), "lang string, v array<double>")
    parts = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    # languages x DIM numbers, whatever the input's size
    rows = parts.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).collect()
    return {r["lang"]: np.array(r["v"]) for r in rows}


class Profiles:
    """The languages' centred prototypes."""

    def __init__(self, known: dict[str, np.ndarray]):
        self.names = sorted(known)
        p = np.stack([known[n] / np.linalg.norm(known[n]) for n in self.names]) if known else np.zeros((0, DIM))
        self.mean = p.mean(0) if len(p) > 1 else np.zeros(DIM)
        p = p - self.mean
        self.p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)

    def predict(self, v: np.ndarray | None) -> tuple[str, float]:
        if v is None or not self.names:
            return "und", 0.0
        u = v / max(float(np.linalg.norm(v)), 1e-12) - self.mean
        cos = self.p @ u / max(float(np.linalg.norm(u)), 1e-12)
        best = int(np.argmax(cos))
        margin = float(cos[best] - np.max(np.delete(cos, best))) if len(cos) > 1 else 1.0
        return self.names[best], 1.0 / (1.0 + np.exp(-5 * margin))


def identify(df: DataFrame, learn: Column) -> DataFrame:
    """doc_id, lang_pred, score of every row of (doc_id, text, lang); learns from the rows where ``learn`` holds."""
    import pyarrow as pa

    spark = df.sparkSession
    short_batches(spark)
    space = spark.sparkContext.broadcast(Space(letter_table()))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    profiles = Profiles(prototypes(rows.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()), space))

    def run(batches):
        for batch in batches:
            found = [profiles.predict(space.value.bundle(t)) for t in batch.column("text").to_pylist()]
            pred, score = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.select("doc_id", "text").mapInArrow(released(run), "doc_id long, lang_pred string, score double")
