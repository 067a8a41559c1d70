"""Periodic runs of words by Kolpakov and Kucherov: factors from a suffix automaton, Main's search at their borders, copies inside.

A run is a stretch of words with smallest period q (words q apart are equal) of at least ``least`` words and ``power`` periods
that neither neighbour extends. For one sequence of words:

1. A suffix automaton with the first end of each state's words gives the LZ factorisation: each factor is the longest
   stretch that also begins earlier, or one new word.
2. A run that lies across a border between factors, or ends at a factor's end, is found there (Main): for a border c of
   factors v and u and each period q, common suffixes and prefixes of what lies left and right of c, moved by q, tell how
   far period q reaches. As factors are longest, such a run begins after the start of v less q, so (power - 1) q < |v| + |u|
   and all borders together look at a number of words in proportion to the text.
3. A run strictly inside a factor is the copy of a run at the factor's earlier place, which is known by then.

Before that, words that can't lie in a run are set aside: with k the least value of max(least, power q) - 2q + 1 over all q
(9 for runs of 24 words and 3 periods), each k words in a row of a run stand in it twice, q apart. So every run lies within
one stretch covered by k-word shingles that its document has at least twice, and its neighbours there, or the stretch's end,
don't extend it. Shingles are compared by 64-bit hashes: equal hashes of different shingles only make stretches longer.

Each row is judged by itself, within the task that reads it; a few MB of texts, or one text if it is longer, are in memory.

Edge cases: null and empty texts, and texts of white space, have no words and no runs; null ids are kept; repeated rows come
as often as they stand; texts of any length are read whole; of equally strong runs the one with the smallest start, then
period, counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark.llm.common import larger, released, short_batches

RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string"
#: Multiplier of the shingles' polynomial hash.
ODD = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """All stretches of a sequence, and where each one first ends. A state's first step is kept in arrays, others in a dict."""

    def __init__(self, words):
        self.link, self.length, self.first_end = array("q", [-1]), array("q", [0]), array("q", [-1])
        self.symbol, self.target, self.more = array("q", [-1]), array("q", [0]), {}
        last = 0
        for i, c in enumerate(words):
            last = self._extend(last, c, i)

    def step(self, state: int, c: int) -> int | None:
        if self.symbol[state] == c:
            return self.target[state]
        more = self.more.get(state)
        return more.get(c) if more else None

    def _point(self, state: int, c: int, to: int) -> None:
        if self.symbol[state] in (-1, c):
            self.symbol[state], self.target[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _state(self, length: int, first_end: int, symbol: int = -1, target: int = 0) -> int:
        for column, value in ((self.link, 0), (self.length, length), (self.first_end, first_end), (self.symbol, symbol), (self.target, target)):
            column.append(value)
        return len(self.link) - 1

    def _extend(self, last: int, c: int, i: int) -> int:
        new, at, to = self._state(i + 1, i), last, None
        while at >= 0 and (to := self.step(at, c)) is None:
            self._point(at, c, new)
            at = self.link[at]
        if at >= 0:
            if self.length[to] != self.length[at] + 1:
                copy = self._state(self.length[at] + 1, self.first_end[to], self.symbol[to], self.target[to])
                if to in self.more:
                    self.more[copy] = dict(self.more[to])
                self.link[copy], self.link[to] = self.link[to], copy
                old = to
                while at >= 0 and self.step(at, c) == old:
                    self._point(at, c, copy)
                    at = self.link[at]
                to = copy
            self.link[new] = to
        return new


def factors(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, end, earlier start) of each factor; the last is -1 for a new word."""
    known, i, n = SuffixAutomaton(words), 0, len(words)
    while i < n:
        state, j = 0, i
        while j < n and known.first_end[to := known.step(state, words[j])] < j:
            state, j = to, j + 1
        yield (i, j, known.first_end[state] - (j - i) + 1) if j > i else (i, i + 1, -1)
        i = max(j, i + 1)


def common_prefixes(x: list[int]) -> list[int]:
    """For each place of x, how many words from there equal x's first ones (Z-values)."""
    n = len(x)
    z, a, b = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(b - i, z[i - a]) if i < b else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    return z


def _at_border(w: list[int], p: int, c: int, d: int, least: int, power: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of runs with start <= c < end <= d, for factors [p, c) and [c, d). Multiples of a period may come too."""
    size, n = d - p, len(w)
    most = min((size - 1) // (power - 1), c + size)
    lo = max(0, p - most)
    if (d - lo) < least:
        return
    left, right = w[lo:c], w[c:d]
    back = left[::-1]
    ends = common_prefixes(back)  # [q]: common suffix of w[:c] and w[:c - q]
    begins = common_prefixes([*right, -1, *w[lo:d]])  # [|u| + 1 + k]: common prefix of u and w[lo + k:]
    moved_ends = common_prefixes([*back, -1, *w[lo:d][::-1]])  # [|left| + 1 + d - e]: common suffix of w[:c] and w[:e]
    inner = common_prefixes(right)  # [q]: common prefix of u and u[q:]
    for q in range(1, most + 1):
        need = max(least, power * q)
        if q <= len(left):
            reach = begins[len(right) + 1 + len(left) - q]
            behind = ends[q] if q < len(left) else 0
            if reach and behind + q + reach >= need:
                yield from _ending(w, c - q - behind, c + reach, q, d, n)
        if q <= len(right):
            reach = inner[q] if q < len(right) else 0
            behind = moved_ends[len(left) + 1 + d - c - q] if left else 0
            if behind + q + reach >= need:
                yield from _ending(w, c - behind, c + q + reach, q, d, n)


def _ending(w, s, e, q, d, n) -> Iterator[tuple[int, int, int]]:
    """The run, unless it goes on behind d, where a later border finds it."""
    if e < d or d == n or w[d] != w[d - q]:
        yield s, e, q


def _at_end(w: list[int], c: int, d: int, least: int, power: int) -> Iterator[tuple[int, int, int]]:
    """Runs with c < start and end = d, for a factor [c, d)."""
    if d - c <= least:
        return
    ends = common_prefixes(w[c:d][::-1])
    for q in range(1, (d - c) // power + 1):
        s = d - q - ends[q]
        if s > c and d - s >= max(least, power * q):
            yield from _ending(w, s, d, q, d, len(w))


def runs_of(words: list[int], least: int, power: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, by start, then end."""
    found, p = [], 0
    for c, d, earlier in factors(words):
        new: dict[tuple[int, int], int] = {}
        for s, e, q in (*_at_border(words, p, c, d, least, power), *_at_end(words, c, d, least, power)):
            new[s, e] = min(q, new.get((s, e), q))
        for (s, e), q in new.items():
            insort(found, (s, e, q))
        if earlier >= 0 and d - c > least:
            # copies can be copied again where a factor overlaps its earlier place: they are taken by start
            move, at = c - earlier, bisect_right(found, (earlier, len(words) + 1, 0))
            while at < len(found) and found[at][0] + move < d:
                s, e, q = found[at]
                if e + move < d:
                    insort(found, (s + move, e + move, q))
                at += 1
        p = c
    return found


def shingle_width(least: int, power: int) -> int:
    """Words in a row that stand twice in any run."""
    return min(max(least, power * q) - 2 * q + 1 for q in range(1, least + 1))


def stretches(codes: np.ndarray, offsets: np.ndarray, width: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(document, start, end) of the stretches of at least ``least`` words covered by shingles that their document has twice.

    codes: numbers that stand for words; offsets: where documents begin in them, and the end.
    """
    n = len(codes)
    if n < width:
        return
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * ODD
    mixed ^= mixed >> np.uint64(29)
    hashed = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        hashed *= ODD
        hashed += mixed[k : n - width + 1 + k]
    whose = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    hashed ^= hashed >> np.uint64(31)
    hashed *= whose[: len(hashed)].astype(np.uint64) * np.uint64(2) + np.uint64(0xBF58476D1CE4E5B9)
    places = np.flatnonzero(whose[: len(hashed)] == whose[width - 1 :])
    places = places[np.argsort(hashed[places], kind="stable")]
    same = (hashed[places][1:] == hashed[places][:-1]) & (whose[places][1:] == whose[places][:-1])
    twice = places[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(places) else places
    if not len(twice):
        return
    # covered words, by counting shingles that open and close
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + width, -1)
    covered = np.cumsum(change[:-1]) > 0
    edge = covered[1:] != covered[:-1]
    edge |= whose[1:] != whose[:-1]
    cuts = np.concatenate([[0], np.flatnonzero(edge) + 1, [n]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if covered[a] and b - a >= least:
            yield int(whose[a]), a, b


def document_runs(codes: np.ndarray, offsets: np.ndarray, least: int, power: int) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period), by start, then period, of each document that has runs; starts are counted in it."""
    out: dict[int, list] = {}
    for doc, a, b in stretches(codes, offsets, shingle_width(least, power), least):
        first = a - int(offsets[doc])
        for s, e, q in runs_of(np.unique(codes[a:b], return_inverse=True)[1].tolist(), least, power):
            out.setdefault(doc, []).append((first + s, e - s, q))
    return {k: sorted(v, key=lambda r: (r[0], r[2])) for k, v in out.items()}


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with most periods; of equal ones the first, then that of the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def surplus(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Whether each of n words stands in a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def find_runs(df: DataFrame, least: int = 24, power: int = 3, rewrite: Callable[[int | None, int], np.ndarray | None] | None = None, piece: int = 1 << 22) -> DataFrame:
    """SCHEMA of each row of (doc_id, text): its runs, the strongest one, and its words without what runs repeat.

    rewrite(doc_id, number of words): which word stands at each place instead, or None. piece: bytes of text, about, that a
    worker looks at together. power is at least 2.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    if power < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    short_batches(df.sparkSession)
    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        for batch in larger(batches, piece):
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id")
            split = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
            coded = split.flatten().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
            # white space at a text's ends leaves empty words behind
            word = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
            offsets = np.concatenate([[0], np.cumsum(word)])[offsets]
            codes = codes[word]
            if rewrite is not None:
                for doc, a, b in zip(ids.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    if (index := rewrite(doc, b - a)) is not None:
                        codes[a:b] = codes[a:b][index]
            found = document_runs(codes, offsets, least, power)
            kept = np.ones(len(codes), bool)
            for doc, own in found.items():
                kept[offsets[doc] : offsets[doc + 1]] = ~surplus(own, int(offsets[doc + 1] - offsets[doc]))
            ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.dictionary.take(pa.array(codes[kept])))
            rows = [[dict(zip(("start", "length", "period"), r)) for r in found.get(k, ())] for k in range(len(ids))]
            best = [dict(zip(("start", "length", "period"), strongest(found[k]))) if k in found else None for k in range(len(ids))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), pa.array(rows, schema.field("runs").type), pa.array(best, schema.field("strongest").type), pc.binary_join(lists, " ")], schema=schema)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), SCHEMA)
