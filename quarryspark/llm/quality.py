"""Quality by co-training: a text-content and a page-metadata classifier teach each other.

Both views start from the labelled sample. In each round every view scores all rows without a label, and
those beyond the quantiles of all scores that ``SHARE`` and the labelled share suggest, and surer than ``SURE``, get
pseudo-labels, which are handed to the other view. After the last round both are calibrated on
labelled rows that neither saw, and a logistic combination of the calibrated log odds, fitted there
too, scores all rows. A view that says little so gets little weight.

Features of a row are computed once and written to the shared folder, so a round reads short rows only; scores, quantiles
and pseudo-labels cover all of them. The metadata view is given the page's record alone, the text view the text alone.

Bounds: a view is fitted on about ``SAMPLE`` labelled rows, one of each doc_id, and a hash sample of ``GIVEN``
pseudo-labelled rows a class and round; every row is scored.

Edge cases: null texts count as empty, null metadata is a value of its own; rows whose doc_id has a label,
held out or not, get no pseudo-label; without labels of both kinds all rows get the base rate; with no row left to
teach the views are those of the sample; equal scores share a side of a quantile; long texts are read whole; repeated
rows get equal scores; extra columns are ignored (and passed on by ``keep_good``); an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.llm.common import discard, released, short_batches, sized, spill
from quarryspark.llm.gbt import Boosted, Isotonic
from quarryspark.llm.toxicity import labelled_sample

#: Labelled rows to fit on, about, at most; pseudo-labels a class, view and round to fit on, about; rounds.
SAMPLE, GIVEN, ROUNDS = 12_000, 400, 3
#: Share of the rows without a label that a view labels a round; log odds that it must be sure of.
SHARE, SURE = 0.1, 2.0
#: Slots that language and source names are hashed to.
LANGS, SOURCES = 6, 24
TEXT_FEATURES, META_FEATURES = 17, 2 + LANGS + SOURCES


def text_view(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(count.sum()))
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    by = Counter(words)
    common = by.most_common(3)
    lines = [x for x in text.split("\n") if x]
    repeats = sum(a == b for a, b in zip(words, words[1:])) / n
    signs = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    return [
        float(lens.mean()), float(lens.std()), float(lens.max()), len(by) / n, common[0][1] / n if common else 0.0, sum(c for _, c in common) / n, repeats, signs / size,
        int(count[35:39].sum() + count[42] + count[64]) / n, int(count[124]) / n, int(count[46] + count[33] + count[63]) / n, int(count[44]) / n, int(count[48:58].sum()) / size, int(count[65:91].sum()) / size,
        len(set(lines)) / max(1, len(lines)), math.log1p(len(words)), int(count[128:].sum()) / size,
    ]


def meta_view(lang, source, n_chars) -> list[float]:
    """What a page's record tells: names and stated size; nothing of the text."""
    out = [math.log1p(max(0, n_chars or 0)), float(n_chars is None)]
    for value, slots in ((lang, LANGS), (source, SOURCES)):
        hot = [0.0] * slots
        hot[0 if value is None else 1 + zlib.crc32(str(value).encode()) % (slots - 1)] = 1.0
        out += hot
    return out


def _columns(df: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, n_chars; what is missing is null."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


def _views(batch) -> tuple[np.ndarray, np.ndarray]:
    text, lang, source, n_chars = (batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars"))
    a = np.array([text_view(t) for t in text], float).reshape(-1, TEXT_FEATURES)
    return a, np.array([meta_view(*r) for r in zip(lang, source, n_chars)], float).reshape(-1, META_FEATURES)


def _arrays(x: np.ndarray):
    import pyarrow as pa

    return pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32()))


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def feature_rows(df: DataFrame) -> DataFrame:
    """row (an ordinal), doc_id, a, b: both views of every row, in the shared folder."""
    import pyarrow as pa

    short_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            a, b = _views(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _arrays(a), _arrays(b)], ["doc_id", "a", "b"])

    made = _columns(df).mapInArrow(released(run), "doc_id long, a array<float>, b array<float>")
    return spill(made.select(F.monotonically_increasing_id().alias("row"), "doc_id", "a", "b"), "features")


class CoTrained:
    """The two views, calibrated, and their combination. labelled: (text view, meta view) matrices."""

    def __init__(self, labelled, y):
        self.held = np.arange(len(y)) % 3 == 2
        self.base = float((y.sum() + 1) / (len(y) + 2))
        self.taught = [[x[~self.held], y[~self.held], np.ones((~self.held).sum())] for x in labelled]
        self.labelled, self.y = labelled, y
        self.weights, self.calibrated = np.array([0.0, 0.5, 0.5]), []
        self.two_sided = bool(len(y)) and y.min() < y.max()
        self._fit()

    def _fit(self) -> None:
        self.views = [Boosted(trees=40).fit(*t) for t in self.taught]

    def teach(self, view: int, x: np.ndarray, y: np.ndarray) -> None:
        """Pseudo-labelled rows for a view, with half the weight of labelled ones."""
        t = self.taught[view]
        self.taught[view] = [np.concatenate([t[0], x]), np.concatenate([t[1], y]), np.concatenate([t[2], np.full(len(y), 0.5)])]

    def finish(self) -> CoTrained:
        held = [x[self.held] for x in self.labelled]
        self.calibrated = [Isotonic().fit(v.raw(x), self.y[self.held]) for v, x in zip(self.views, held)]
        self._combine(self._odds(held), self.y[self.held])
        del self.taught, self.labelled, self.y, self.held
        return self

    def _odds(self, views) -> np.ndarray:
        p = [np.clip(c(v.raw(x)), 0.002, 0.998) for c, v, x in zip(self.calibrated, self.views, views)]
        return np.stack([np.ones(len(p[0])), *(np.log(q / (1 - q)) for q in p)], 1)

    def _combine(self, z: np.ndarray, y: np.ndarray) -> None:
        w = np.array([0.0, 0.5, 0.5])
        for _ in range(25):  # Newton steps of a ridge logistic regression
            p = 1 / (1 + np.exp(-z @ w))
            g = z.T @ (y - p) - 1.0 * (w - np.array([0.0, 0.5, 0.5]))
            w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(3), g)
        self.weights = w

    def __call__(self, views) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._odds(views) @ self.weights, -30, 30)))


def _scored(rows: DataFrame, model: CoTrained) -> DataFrame:
    """row, a, b and both views' log odds s0, s1."""
    import pyarrow as pa

    views = rows.sparkSession.sparkContext.broadcast(model.views)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("a"), TEXT_FEATURES), _matrix(batch.column("b"), META_FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "a", "b")), *(pa.array(v.raw(m)) for v, m in zip(views.value, x))], ["row", "a", "b", "s0", "s1"])

    return rows.select("row", "a", "b").mapInArrow(released(run), "row long, a array<float>, b array<float>, s0 double, s1 double")


def exchange(model: CoTrained, pool: DataFrame, total: int, seed: int) -> int:
    """One round: each view labels what it is surest of among all rows of pool, for the other view. Returns how many rows taught."""
    up, down = SHARE * model.base, SHARE * (1 - model.base)
    scored = _scored(pool, model)
    cuts = scored.agg(*(F.percentile_approx(s, [down, 1 - up], 1000).alias(s) for s in ("s0", "s1"))).first()
    sides = [(view, good, (F.col(s) >= max(cuts[s][1], SURE)) if good else (F.col(s) <= min(cuts[s][0], -SURE))) for view, s in enumerate(("s0", "s1")) for good in (1, 0)]
    drawn = lambda share: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 20)) < int(min(1.0, GIVEN / max(1.0, share * total)) * (1 << 20))
    found = [scored.where(c & drawn(up if good else down)).select(F.lit(view).alias("view"), F.lit(good).alias("y"), "row", "a", "b") for view, good, c in sides]
    # at most GIVEN / SHARE rows and a view, when all scores are equal; about GIVEN otherwise
    rows = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).toPandas().sort_values(["view", "y", "row"])
    for view, column, width in ((0, "b", META_FEATURES), (1, "a", TEXT_FEATURES)):
        own = rows[rows["view"] == view]
        model.teach(1 - view, np.array(own[column].tolist(), float).reshape(len(own), width), own["y"].to_numpy(float))
    model._fit()
    return len(rows)


def train(features: DataFrame, labels: DataFrame, learn: Column) -> CoTrained:
    """The model, from the rows of ``feature_rows``. learn: on labels' ``label_id``, the rows to learn from."""
    rows = labelled_sample(features, labels, learn, "quality", SAMPLE).toPandas().sort_values("doc_id", kind="stable")  # bounded by SAMPLE
    views = [np.array(rows[c].tolist(), float).reshape(len(rows), k) for c, k in (("a", TEXT_FEATURES), ("b", META_FEATURES))]
    model = CoTrained(views, rows["y"].to_numpy(float))
    known = labels.select(F.col("doc_id").cast("long").alias("label_id")).where("label_id IS NOT NULL").distinct()
    pool = features.join(sized(known), F.col("doc_id") == F.col("label_id"), "left_anti")
    if model.two_sided and (total := pool.count()):
        for r in range(ROUNDS):
            if not exchange(model, pool, total, r):
                break
    return model.finish()


def score(df: DataFrame, labels: DataFrame, learn: Column, least: float = 0.5) -> DataFrame:
    """doc_id, score (probability of good quality), keep of every row."""
    import pyarrow as pa

    features = feature_rows(df)
    model = df.sparkSession.sparkContext.broadcast(train(features, labels, learn))

    def run(batches):
        for batch in batches:
            p = model.value([_matrix(batch.column("a"), TEXT_FEATURES), _matrix(batch.column("b"), META_FEATURES)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array(p >= least)], ["doc_id", "score", "keep"])

    return features.mapInArrow(released(run), "doc_id long, score double, keep boolean")


def keep_good(df: DataFrame, labels: DataFrame, learn: Column, least: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose score reaches ``least``, with all of their columns, without a join."""
    import pyarrow as pa

    features = feature_rows(df)
    model = df.sparkSession.sparkContext.broadcast(train(features, labels, learn))
    discard(features)
    names = df.columns

    def run(batches):
        for batch in batches:
            p = model.value([x.astype(np.float32).astype(float) for x in _views(batch)])
            yield batch.select(names).filter(pa.array(p >= least))

    missing = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c not in names]
    return df.withColumns({c: F.lit(None).cast("string") for c in missing}).mapInArrow(released(run), df.schema) if missing else df.mapInArrow(released(run), df.schema)
