"""Whitening of embeddings: Welford's rank-one updates, merged by the parallel formula, and a symmetric QR eigen-solve.

1. An entry c is taken as x = floor(64 c) + 1000000. What follows works on x - 1000000, whose deviations are the same and
   whose sums stay short.
2. Each task streams its rows through Welford's update M2 += (x_k - mean_(k-1)) (x_k - mean_k)^T. A batch's updates are one
   product of two matrices, of the means before and after each row: the same series of rank-one updates, and centred before
   it is multiplied. A task returns one row (n, sums, M2).
3. Tasks' rows meet by the parallel formula, M2 = Ma + Mb + d d^T na nb / (na + nb), FAN of them in a task, until FAN are left
   for the driver: d x d numbers each, whatever the table's size.
4. The driver reduces V = M2 / n to a tridiagonal matrix by reflections and that by QR steps with Wilkinson's shift.
5. Tasks project their rows on the components; a second series of updates, over the whitened rows, measures how far their
   covariance is from the identity.

Edge cases: vectors that are null, empty or hold null or non-finite entries are dropped, and vectors of another length than
the commonest one (the longest of equally common ones): a covariance needs one length. Null and repeated ids stay as often as
they stand, and repeated rows weigh as often. Components without variance (equal rows, one row, more dimensions than
distinct rows: e at or below 1e-12 of the largest) can't be scaled to one and are left out. Components of equal variance are
some basis of their space. An empty table, or one without variance, gives no rows. Other columns are ignored. ``deviation``
must fit a long, as its contract says; larger ones, and entries of 2^40 or more, raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.llm.common import short_batches

#: The grid of an entry, and its offset, which cancels in every deviation.
GRID, OFFSET = 64, 1_000_000
#: Partial results that one task, or the driver, puts together.
FAN = 64
#: A component's variance against the largest, below which it counts as none.
NO_VARIANCE = 1e-12
PARTIAL = "n long, sums array<long>, mean array<double>, m2 array<double>"
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Moments:
    """n, mean and M2 (sum of products of deviations) of the rows seen."""

    def __init__(self, dims: int):
        self.n, self.mean, self.m2 = 0, np.zeros(dims), np.zeros((dims, dims))

    def stream(self, x: np.ndarray) -> None:
        """Welford's update for each row of ``x``, in order."""
        counts = np.arange(self.n + 1, self.n + len(x) + 1)[:, None]
        after = self.mean + np.cumsum(x - self.mean, axis=0) / counts
        before = np.vstack([self.mean[None], after[:-1]])
        self.m2 += (x - before).T @ (x - after)
        self.n, self.mean = int(counts[-1, 0]), after[-1]

    def merge(self, n: int, mean: np.ndarray, m2: np.ndarray) -> None:
        """The parallel formula."""
        if not n:
            return
        total, apart = self.n + n, mean - self.mean
        self.m2 = self.m2 + m2 + np.outer(apart, apart) * (self.n * n / total)
        self.mean = self.mean + apart * (n / total)
        self.n = total

    def covariance(self) -> np.ndarray:
        return (self.m2 + self.m2.T) / (2 * self.n)


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with v = q t q^T, by a reflection a column."""
    a, d = v.astype(float).copy(), len(v)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        norm = np.sqrt(x @ x)
        if not norm:
            continue
        x[0] += norm if x[0] >= 0 else -norm
        u = x / np.sqrt(x @ x)
        # a = h a h and q = q h for the reflection h = 1 - 2 u u^T
        own = a[k + 1 :, k:]
        own -= 2 * np.outer(u, u @ own)
        own = a[k:, k + 1 :]
        own -= 2 * np.outer(own @ u, u)
        own = q[:, k + 1 :]
        own -= 2 * np.outer(own @ u, u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix: shifted QR steps on its tridiagonal form."""
    main, off, q = tridiagonal(v)
    z, last = q.T.copy(), len(main) - 1  # rows of z are turned: they lie together in memory
    eps = np.finfo(float).eps
    while last > 0:
        small = np.abs(off[:last]) <= eps * (np.abs(main[:last]) + np.abs(main[1 : last + 1]))
        off[:last][small] = 0.0
        if small[last - 1]:
            last -= 1
            continue
        cuts = np.flatnonzero(small)
        first = int(cuts[-1]) + 1 if len(cuts) else 0
        gap = (main[last - 1] - main[last]) / 2
        turn = abs(gap) + np.hypot(gap, off[last - 1])
        shift = main[last] - off[last - 1] ** 2 / (turn if gap >= 0 else -turn)
        x, bulge = main[first] - shift, off[first]
        for k in range(first, last):  # a rotation for each entry, which pushes the bulge down
            r = np.hypot(x, bulge)
            c, s = (x / r, bulge / r) if r else (1.0, 0.0)
            if k > first:
                off[k - 1] = r
            p, t, o = main[k], main[k + 1], off[k]
            main[k] = c * c * p + 2 * c * s * o + s * s * t
            main[k + 1] = s * s * p - 2 * c * s * o + c * c * t
            off[k] = c * s * (t - p) + (c * c - s * s) * o
            if k + 1 < last:
                x, bulge = off[k], s * off[k + 1]
                off[k + 1] *= c
            z[[k, k + 1]] = c * z[k] + s * z[k + 1], c * z[k + 1] - s * z[k]
    order = np.argsort(-main, kind="stable")
    return main[order], z[order].T


def _entries(column, dims: int) -> np.ndarray:
    """The x - OFFSET of a batch of vectors of equal length, as a matrix of longs."""
    scaled = np.floor(GRID * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(scaled).max() >= GRID * 2.0**40:
        raise OverflowError("an entry is too large")
    return scaled.astype(np.int64).reshape(-1, dims)


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def usable_vectors(df: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows that take part, and the length of their vectors (0: there are none)."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector")).where(_usable(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = common["d"] if common else 0
    return rows.where(F.size("vector") == dims), dims


def _partials(rows: DataFrame, dims: int, ready) -> DataFrame:
    """One row of PARTIAL for each task that has rows. ready(longs): the numbers that are streamed."""
    import pyarrow as pa

    schema = _schema(PARTIAL)

    def run(batches) -> Iterator:
        held, sums = None, np.zeros(dims, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _entries(batch.column("vector"), dims)
            sums += x.sum(axis=0)
            y = ready(x)
            held = held or Moments(y.shape[1])
            held.stream(y)
        if held:
            yield pa.RecordBatch.from_pydict({"n": [held.n], "sums": [sums.tolist()], "mean": [held.mean.tolist()], "m2": [held.m2.ravel().tolist()]}, schema=schema)

    return rows.mapInArrow(run, PARTIAL)


def _schema(text: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(text))


def _merged(rows) -> tuple[Moments, np.ndarray]:
    total, sums = None, 0
    for n, own, mean, m2 in rows:
        mean = np.asarray(mean, float)
        total = total or Moments(len(mean))
        total.merge(n, mean, np.asarray(m2, float).reshape(len(mean), -1))
        sums = sums + np.asarray(own, np.int64)
    return total, sums


def gathered(partials: DataFrame, tasks: int) -> tuple[Moments, np.ndarray] | None:
    """All partial results as one, FAN at a time in tasks, the last FAN here. Null if there are none. tasks: how many there are."""
    import pyarrow as pa

    schema = _schema(PARTIAL)

    def run(batches) -> Iterator:
        found = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        if found:
            held, sums = _merged(found)
            yield pa.RecordBatch.from_pydict({"n": [held.n], "sums": [sums.tolist()], "mean": [held.mean.tolist()], "m2": [held.m2.ravel().tolist()]}, schema=schema)

    while tasks > FAN:
        tasks = -(-tasks // FAN)
        partials = partials.repartition(tasks).mapInArrow(run, PARTIAL)
    found = partials.collect()
    return _merged(found) if found else None


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """OUT: each remaining row's whitened coordinates on the first components, one row each."""
    import pyarrow as pa

    spark = df.sparkSession
    short_batches(spark)
    rows, dims = usable_vectors(df, id_column, vector)
    nothing = spark.createDataFrame([], OUT)
    if not dims:
        return nothing
    tasks = rows.rdd.getNumPartitions()
    fitted, sums = gathered(_partials(rows, dims, lambda x: x.astype(np.float64)), tasks)
    n, v = fitted.n, fitted.covariance()
    values, vectors = symmetric_qr(v)
    keep = int(np.count_nonzero(values[:components] > NO_VARIANCE * max(values[0], 0.0)))
    if not keep:
        return nothing
    values, trace = values[:keep], float(np.trace(v))
    # the mean as a whole part and a rest, so that the rest of a deviation is exact where the deviation is
    whole = sums // n
    rest = (sums - whole * n) / n
    scaled = vectors[:, :keep] / np.sqrt(values)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - whole) - rest) @ scaled

    white, _ = gathered(_partials(rows, dims, project), tasks)
    error = float(np.abs(white.covariance() - np.eye(keep)).max())
    explained, schema = values / trace, _schema(OUT)

    def run(batches) -> Iterator:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _entries(batch.column("vector"), dims)
            if ((n * x.astype(np.float64) - sums) ** 2).sum(axis=1).max() >= 2.0**63 * (1 - 1e-9):
                raise OverflowError("a deviation does not fit a long")
            apart = n * x - sums
            size, ids = len(x), np.repeat(np.arange(len(x)), keep)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(ids)),
                    pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * keep, n, np.int64)),
                    pa.array(np.repeat((apart * apart).sum(axis=1), keep)),
                    pa.array(project(x).ravel()),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * keep, error)),
                ],
                schema=schema,
            )

    return rows.mapInArrow(run, OUT)
