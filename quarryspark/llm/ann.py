"""Nearest neighbours by inner product with collision counting over single projections.

Inner product becomes nearness: candidates get one more component, sqrt(M^2 - |x|^2) with M
the largest norm, queries get 0, which leaves products as they are and makes the largest
product the nearest point. Each of ``projections`` random lines keeps one sorted array of the
block's projected vectors. A query's window on a line is centred on its own projection and
reaches ``width`` radii to both sides; the radius grows by ``ratio`` a round, which is the whole of virtual
rehashing: nothing is hashed again, and a round reads only the places that its windows
have gained. Each place read is a collision of its vector.

Threshold. A vector as near as the radius lies in a window with probability p = 2 Phi(width) - 1, so its
collisions over all lines are binomial, and it reaches p less ``slack`` standard deviations of the lines with
probability Phi(slack), 0.93 at 1.5; farther ones do more rarely. Vectors that reach the threshold are verified: their exact
products are taken in double precision. A query is done when the radius has come to the distance
of its k-th best verified vector. The ``SEEDS`` places on both sides of the query on each line are
verified first; their k-th best bounds the radius that will be needed, so rounds begin ``STEPS`` steps
below it.

Blocks. Every row is indexed; rows are dealt to blocks by a hash of their ordinal, so a vec_id or vector
that repeats a third of all rows is spread evenly. Queries are dealt to blocks of their own and
each pair of blocks is one group; a group's size is bounded by the two block sizes, which do not
grow with the table. Blocks return k rows a query, and the k best of all blocks remain.

Edge cases: vectors that are null, empty, zero, or with null or non-finite components take no part,
as queries or candidates; of vectors of several lengths, the shorter count as filled up with
zeros; rows that repeat a vec_id are candidates, and queries, of their own (their answers share
query_id and rank); ties go to the smaller vec_id; fewer than k candidates give all of them; rows
without a vec_id take no part, as nothing could name them; an empty table gives an empty result; other
columns are ignored; vectors of any length are used whole.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryspark.llm.common import spill

#: Vectors in a block, queries in a block.
BLOCK, QUERIES = 8_192, 2_048
#: Places beside a query that are verified on each line at first, on each side; rounds that lead up to the radius they tell.
SEEDS, STEPS = 2, 2


class ProjectedBlock:
    """One block's vectors and, for each line, their numbers in the order of their projections."""

    def __init__(self, vectors: np.ndarray, largest: float, projections: int, seed: int, width: float, slack: float):
        self.x, self.width, self.spare = vectors, width, largest**2
        spare = np.sqrt(np.maximum(0.0, self.spare - (vectors**2).sum(1)))
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, projections))
        placed = (vectors @ self.lines[:-1] + spare[:, None] * self.lines[-1]).T
        self.order = np.argsort(placed, axis=1, kind="stable")
        self.sorted = np.take_along_axis(placed, self.order, 1)
        p = math.erf(width / math.sqrt(2))
        self.threshold = max(1, math.ceil(projections * p - slack * math.sqrt(projections * p * (1 - p))))
        self.read = self.verified = 0  # places read from the arrays, vectors verified

    def _places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The vectors at places low to high (without high) of each line."""
        lines, times = list(self.order), len(low) // len(self.order)
        found = np.concatenate([o[a:b] for o, a, b in zip(lines * times, low.tolist(), high.tolist())])
        self.read += len(found)
        return found

    def _left_of(self, at: np.ndarray, side: str) -> np.ndarray:
        """For each query and line, the number of places left of a value."""
        return np.stack([np.searchsorted(line, at[:, j], side) for j, line in enumerate(self.sorted)], 1)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, ratio: float):
        """(numbers, products) of the vectors verified for each query; own: the number that is the query itself, or -1."""
        for first in range(0, len(queries), 64):
            yield from self._search(queries[first : first + 64], own[first : first + 64], k, ratio)

    def _search(self, queries, own, k, ratio):
        n, some = self.order.shape[1], np.arange(len(queries))
        at, size = queries @ self.lines[:-1], (queries**2).sum(1) + self.spare
        low = self._left_of(at, "left")
        high, count = low.copy(), np.zeros((len(queries), n), np.int64)
        known, score = np.zeros((len(queries), n), bool), np.full((len(queries), n), -np.inf)
        known[some[own >= 0], own[own >= 0]] = True  # and never looked at
        left_out, best = n - (own >= 0), [np.zeros(0)] * len(queries)
        kth, bound, radius = (np.full(len(queries), v) for v in (np.inf, np.inf, -1.0))

        def verify(q, found):
            found = found[~known[q, found]]
            known[q, found] = True
            got = score[q, found] = self.x[found] @ queries[q]
            self.verified += len(found)
            left_out[q] -= len(found)
            best[q] = np.concatenate([best[q], got])
            if len(best[q]) >= k:  # distance of the k-th best so far; without k of them the windows open wide
                best[q] = np.partition(best[q], len(best[q]) - k)[len(best[q]) - k :]
                kth[q] = math.sqrt(max(0.0, size[q] - 2 * float(best[q][0])))

        for q in some:
            verify(q, np.unique(self._places(np.maximum(low[q] - SEEDS, 0), np.minimum(low[q] + SEEDS, n))))
        bound[:], step = kth, -STEPS
        while len(some := some[(radius[some] < kth[some]) & (left_out[some] > 0)]):
            radius[some] = bound[some] * ratio ** min(step, 0)
            half = (self.width * radius[some])[:, None]
            left, right = np.minimum(self._left_of(at[some] - half, "left"), low[some]), np.maximum(self._left_of(at[some] + half, "right"), high[some])
            for i, q in enumerate(some):
                count[q] += np.bincount(self._places(np.concatenate([left[i], high[q]]), np.concatenate([low[q], right[i]])), minlength=n)
                verify(q, np.flatnonzero(count[q] >= self.threshold))
            low[some], high[some] = left, right
            step += 1
        for q in range(len(queries)):
            found = np.flatnonzero(known[q])
            found = found[found != own[q]]
            yield found, score[q, found]


def usable(vector: Column) -> Column:
    """Finite, not zero."""
    v = vector.cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(df: DataFrame, is_query: Column, k: int = 20, projections: int = 64, width: float = 0.9, ratio: float = 1.05, slack: float = 1.5, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score for the queries among (vec_id, embedding)."""
    found = df.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = spill(found.where(usable(F.col("v")) & F.col("vec_id").isNotNull()), "vectors")  # the ordinals are fixed from here
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, n_queries, largest, dim = rows.agg(F.count(F.lit(1)), F.count_if("q"), F.max(norm), F.max(F.size("v"))).first()
    top, dim = float(largest or 1.0), dim or 1
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))))
    blocks, parts = max(1, -(-n // block)), max(1, -(-n_queries // QUERIES))
    spread = lambda count, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(count))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    vectors = rows.select(spread(blocks, 1).alias("block"), each(parts).alias("part"), "row", "vec_id", "v")
    queries = rows.where("q").select(spread(parts, 2).alias("part"), each(blocks).alias("block"), "row", "vec_id", "v")

    def search(key, own, asked):
        import pandas as pd

        out = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0),)]
        if len(own) and len(asked):
            own = own.sort_values(["vec_id", "row"], kind="stable")
            ids, row, x = own["vec_id"].to_numpy(), own["row"].to_numpy(), np.stack(own["v"].to_numpy())
            place = {r: i for i, r in enumerate(row.tolist())}
            index = ProjectedBlock(x, top, projections, seed, width, slack)
            known = np.array([place.get(r, -1) for r in asked["row"].tolist()])
            for q_row, q_id, (hit, score) in zip(asked["row"].tolist(), asked["vec_id"].tolist(), index.search(np.stack(asked["v"].to_numpy()), known, k, ratio)):
                if len(hit) > k:
                    best = np.flatnonzero(score >= np.partition(score, len(hit) - k)[len(hit) - k])
                    hit, score = hit[best], score[best]
                best = np.lexsort((hit, -score))[:k]  # numbers are in the order of vec_id
                hit = hit[best]
                out.append((np.full(len(hit), q_row), np.full(len(hit), q_id), ids[hit], row[hit], score[best]))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("query", "query_id", "vec_id", "row", "score"), zip(*out))})

    found = vectors.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInPandas(search, "query long, query_id long, vec_id long, row long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
