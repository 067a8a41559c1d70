"""Packing token ids into windows by non-negative least squares over shallow combinations of lengths.

1. A document's ids, with an end id behind them, are cut into full windows (sequences of their own), a head of whole units
   (64 ids) and a tail shorter than a unit. So there are 63 lengths of heads and 63 of tails, whatever the texts' lengths.
2. For each of the two, all combinations of at most three lengths that fill a window exactly are enumerated (a unit for tails,
   64 units for heads; 374 combinations). Non-negative least squares finds how often to repeat each so that the lengths used
   come close to the histogram. Repeats are rounded down, and no length is used more often than it is there.
3. Residuals are packed greedily, longest first, end to end, and cut where a window is full. Units filled by tails are then
   heads of one unit.
4. What is left at the end is less than a window; it goes to sequences of falling powers of two, which need no padding.

Each task packs what it reads, a buffer of ``shard_tokens`` ids (about a thousand windows) at a time, against that buffer's
histogram: every piece is in one, no id is shuffled, memory is bounded by the buffer and the longest text's ids, and a shard
leaves at most 12 sequences shorter than a window. A task that runs again gives the same rows.

Output, one row a piece: ``doc_id``, ``start`` (its document's ids before it), ``length``, ``doc_tokens`` (with the end id),
``sequence_id``, ``offset`` (its place in the sequence, gapless from 0) and ``ids`` (little-endian, 4 bytes each).

Edge cases: null and empty texts are their end id alone, so every row has a piece; null and repeated doc_ids stay as often as
they stand, each row a document of its own; texts of any length are read in pieces; of equal lengths the one read first comes
first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark.llm.common import larger, released, short_batches

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Lengths in a combination, at most.
DEPTH = 3
#: Ids of one Arrow batch of results, about.
BATCH_IDS = 1 << 19


@functools.cache
def combinations(window: int, depth: int = DEPTH) -> tuple[tuple[int, ...], ...]:
    """All falling lists of at most ``depth`` lengths below ``window`` that fill it."""

    def parts(left: int, most: int, deep: int):
        if not left:
            yield ()
        elif deep and most * deep >= left:
            for first in range(min(left, most), 0, -1):
                yield from ((first, *rest) for rest in parts(left - first, first, deep - 1))

    return tuple(parts(window, window - 1, depth))


@functools.cache
def usage(window: int, depth: int = DEPTH) -> np.ndarray:
    """How often each combination (column) uses each length (row, from 1)."""
    found = combinations(window, depth)
    a = np.zeros((window - 1, len(found)))
    for k, lengths in enumerate(found):
        for n in lengths:
            a[n - 1, k] += 1
    return a


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets: the variable of steepest descent enters, those that turn negative leave."""
    square, right = a.T @ a, a.T @ b
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    least = 1e-9 * max(1.0, np.abs(right).max(initial=0))
    for _ in range(3 * a.shape[1]):
        slope = np.where(free, -np.inf, right - square @ x)
        k = int(np.argmax(slope)) if len(slope) else 0
        if not len(slope) or slope[k] <= least:
            break
        free[k] = True
        while free.any():
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(square[np.ix_(at, at)], right[at], rcond=None)[0]
            if z.min() > 0:
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            x[at[low & (x[at] <= 1e-12 * max(1.0, x.max()))]] = 0
            free &= x > 0
    return x


def repeats(histogram: np.ndarray, window: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, how often) that the histogram (of lengths from 1) holds, most frequent first."""
    x, left, out = non_negative_least_squares(usage(window, depth), histogram.astype(float)), histogram.copy(), []
    for k in np.argsort(-x, kind="stable"):
        times = int(x[k] + 1e-6)
        if not times:
            break
        lengths, uses = np.unique(combinations(window, depth)[k], return_counts=True)
        times = min(times, int((left[lengths - 1] // uses).min()))
        if times:
            left[lengths - 1] -= times * uses
            out.append((combinations(window, depth)[k], times))
    return out


class Pieces:
    """Pieces of a shard: whose they are, where they begin in it, how long they are, and where they were put.

    Lengths are counted in ``unit`` ids.
    """

    def __init__(self, doc: np.ndarray, start: np.ndarray, length: np.ndarray, unit: int):
        self.doc, self.start, self.length, self.unit = doc, start, length, unit
        self.place, self.offset = np.full(len(doc), -1, np.int64), np.zeros(len(doc), np.int64)

    def fill(self, window: int) -> tuple[int, list[int]]:
        """Put all pieces into windows, numbered from 0, and what is left into shorter ones. (full windows, lengths of the shorter)."""
        order = np.argsort(self.length, kind="stable")
        bounds = np.searchsorted(self.length[order], np.arange(1, window + 1))
        taken, made = bounds[:-1].copy(), 0
        for lengths, times in repeats(np.diff(bounds), window):
            at = 0
            for n in lengths:
                own = order[taken[n - 1] : taken[n - 1] + times]
                taken[n - 1] += times
                self.place[own], self.offset[own] = made + np.arange(times), at
                at += n
            made += times
        rest = np.flatnonzero(self.place < 0)
        rest = rest[np.argsort(-self.length[rest], kind="stable")]
        total = int(self.length[rest].sum())
        full, short = total // window, _powers(total % window)
        stops = np.concatenate([np.arange(1, full + 1) * window, full * window + np.cumsum(short)]).astype(np.int64)
        self._lay(rest, stops, made)
        return made + full, short

    def _lay(self, rest: np.ndarray, stops: np.ndarray, first: int) -> None:
        """Lay pieces end to end, cut at ``stops``; what lies before the k-th stop goes to window first + k."""
        if not len(rest):
            return
        ends = np.cumsum(self.length[rest])
        cuts = np.union1d(ends, stops)  # ends of what lies there
        begins = np.concatenate([[0], cuts[:-1]])
        whose = np.searchsorted(ends, begins, "right")
        window = np.searchsorted(stops, begins, "right")
        own, inside = rest[whose], begins - (ends - self.length[rest])[whose]
        offset = begins - np.concatenate([[0], stops])[window]
        keep = np.setdiff1d(np.arange(len(self.doc)), rest)
        join = lambda old, new: np.concatenate([old[keep], new])
        self.place, self.offset = join(self.place, first + window), join(self.offset, offset)
        self.doc, self.start, self.length = join(self.doc, self.doc[own]), join(self.start, self.start[own] + inside * self.unit), join(self.length, cuts - begins)


def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def place(sizes: np.ndarray, row_len: int, unit: int) -> tuple[np.ndarray, ...]:
    """Documents of these sizes, cut and placed: arrays doc, start, length, sequence and offset, by document and start."""
    window, docs, whole = row_len // unit, np.arange(len(sizes)), sizes // row_len
    full = np.repeat(docs, whole)
    nth = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
    rest = sizes % row_len
    tail = np.flatnonzero(rest % unit)
    tails = Pieces(tail, sizes[tail] - rest[tail] % unit, rest[tail] % unit, 1)
    blocks, crumbs = tails.fill(unit)
    head = np.flatnonzero(rest // unit)
    # filled units are pieces of no document (-1); their start is their number
    heads = Pieces(np.concatenate([head, np.full(blocks, -1)]), np.concatenate([whole[head] * row_len, np.arange(blocks)]), np.concatenate([rest[head] // unit, np.ones(blocks, np.int64)]), unit)
    made, short = heads.fill(window)
    is_block = heads.doc < 0
    seat = np.zeros((2, blocks + len(crumbs)), np.int64)
    seat[:, heads.start[is_block]] = heads.place[is_block], heads.offset[is_block] * unit
    seat[0, blocks:] = made + len(short) + np.arange(len(crumbs))
    first = made + len(short) + len(crumbs)
    out = [
        np.concatenate(c)
        for c in (
            (full, heads.doc[~is_block], tails.doc),
            (nth * row_len, heads.start[~is_block], tails.start),
            (np.full(len(full), row_len), heads.length[~is_block] * unit, tails.length),
            (first + np.arange(len(full)), heads.place[~is_block], seat[0, tails.place]),
            (np.zeros(len(full), np.int64), heads.offset[~is_block] * unit, seat[1, tails.place] + tails.offset),
        )
    ]
    order = np.lexsort((out[1], out[0]))
    return tuple(c[order] for c in out)


def pack(df: DataFrame, tokenizer_path: str, end_id: int, row_len: int = 4096, unit: int = 64, shard_tokens: int = 4_000_000, piece: int = 1 << 22) -> DataFrame:
    """Encode the texts of (doc_id, text), ``piece`` bytes at a time, and place their ids in windows of ``row_len``.

    row_len and unit are powers of two, unit the smaller.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    from quarryspark.llm.bpe import shipped
    from quarryspark.llm.pack import texts_ids

    if row_len & (row_len - 1) or unit & (unit - 1) or not 2 <= unit <= row_len // 2:
        raise ValueError("row_len and unit must be powers of two, unit the smaller")
    short_batches(df.sparkSession)
    spec = shipped(df.sparkSession, tokenizer_path)
    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        from pyspark import TaskContext

        codec = spec.value.codec()
        first = TaskContext.get().partitionId() << 33
        made = 0

        def flush(docs, held):
            nonlocal made
            sizes = np.array([len(x) for x in held], np.int64)
            doc, start, length, sequence, offset = place(sizes, row_len, unit)
            total = np.concatenate([[0], np.cumsum(length)])
            ids = pa.array(docs, pa.int64())
            at = 0
            while at < len(doc):
                stop = max(at + 1, int(np.searchsorted(total, total[at] + BATCH_IDS, "right")) - 1)
                own = slice(at, stop)
                parts = [held[d][a : a + n].astype("<u4").tobytes() for d, a, n in zip(doc[own].tolist(), start[own].tolist(), length[own].tolist())]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[own])), *(pa.array(c) for c in (start[own], length[own], sizes[doc[own]], first + made + sequence[own], offset[own])), pa.array(parts, pa.binary())], schema=schema)
                at = stop
            made += int(sequence.max()) + 1

        docs, held, size = [], [], 0
        for batch in larger(batches, piece):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), texts_ids(codec, batch.column("text"), piece)):
                docs.append(doc)
                held.append(np.append(ids, ids.dtype.type(end_id)))
                size += len(ids) + 1
                if size >= shard_tokens:
                    yield from flush(docs, held)
                    docs, held, size = [], [], 0
        if docs:
            yield from flush(docs, held)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), SCHEMA)
