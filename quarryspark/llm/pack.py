"""Packing token ids into fixed rows: best-fit decreasing with a segment tree over capacities.

Each task packs what it reads, a buffer of ``shard_tokens`` ids at a time, so nothing is
shuffled and memory is bounded whatever the table's size; a shard leaves at most a few
rows part-filled. Within a shard the pieces go, longest first, to the fullest row that
still takes them; a segment tree over the possible free capacities finds that row in
log(row length) steps. A text longer than a row is split into full rows and a rest, and
(doc_id, piece) gives its order back, so every id is kept.

Output, one row per packed row of the id matrix: ``pack_id``, ``n_tokens``, ``doc_ids``
and ``pieces`` of its segments, ``cu_seqlens`` (0, then cumulative segment lengths),
``input_ids`` (little-endian, ``row_len`` ids, padded; uint16 or uint32 by the vocabulary) and
``position_ids`` (uint16 or uint32 by the row length; they start again at 0 in each segment and in
the padding). ``write`` puts them into a folder with their layout, ``matrices`` reads such a folder
back as NumPy matrices.

Edge cases: null and empty texts are segments of length 0, at most ``row_len`` of them in a row, so
every row of the table is in some packed row; null doc_ids stay null; long texts are read in pieces;
repeated rows are packed as often as they stand; of pieces of equal length the one read first comes
first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspark.llm.common import larger, released, short_batches

SCHEMA = "pack_id long, n_tokens int, n_segments int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class CapacityTree:
    """Rows by free capacity; ``fit(n)`` takes the row with the least free capacity of at least n."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, leaf: int, by: int) -> None:
        i = leaf + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def fit(self, need: int) -> tuple[int, int] | None:
        """(free capacity, row), taken out of the tree; None when no row has room."""
        i, count = need + self.size, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a right neighbour has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        free = i - self.size
        self._add(free, -1)
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: list[int], row_len: int) -> list[list[int]]:
    """Piece numbers by row. Longer pieces first; of equal ones the earlier first. Empty ones fill up to row_len of a row."""
    tree, rows = CapacityTree(row_len), []
    for k in sorted((k for k, n in enumerate(lengths) if n), key=lambda k: (-lengths[k], k)):
        free, row = tree.fit(lengths[k]) or (row_len, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(k)
        tree.put(free - lengths[k], row)
    at = 0
    for k in (k for k, n in enumerate(lengths) if not n):
        while at < len(rows) and len(rows[at]) >= row_len:
            at += 1
        if at == len(rows):
            rows.append([])
        rows[at].append(k)
    return rows


def position_type(row_len: int) -> np.dtype:
    return np.dtype("<u2" if row_len <= 1 << 16 else "<u4")


def id_type(ids: int) -> np.dtype:
    return np.dtype("<u2" if ids <= 1 << 16 else "<u4")


def texts_ids(codec, column, piece: int) -> Iterator[np.ndarray]:
    """The ids of each text of a column, in its order."""
    from quarryspark.llm.bpe import Runs, long_run, pieces, ragged

    dtype, row, parts = id_type(codec.table.size), 0, []
    for rows, texts in pieces(column, piece):
        if long_run(texts):
            ids, cuts = np.fromiter(codec.stream_run(texts[0].as_py()), dtype), None
            cuts = [0, len(ids)]
        else:
            runs = Runs(texts)
            starts, counts, flat = codec.encode_runs(runs.distinct)
            ids = flat[ragged(starts[runs.codes], counts[runs.codes])].astype(dtype)
            cuts = np.concatenate([[0], np.cumsum(runs.counted(counts))]).tolist()
        for k, a, b in zip(rows, cuts, cuts[1:]):
            if k != row:
                yield np.concatenate(parts)
                row, parts = k, []
            parts.append(ids[a:b])
    if parts:
        yield np.concatenate(parts)


def pack(df: DataFrame, tokenizer_path: str, row_len: int = 2048, pad_id: int = 0, shard_tokens: int = 4_000_000, piece: int = 1 << 22) -> DataFrame:
    """Encode the texts of (doc_id, text), ``piece`` bytes at a time, and pack their ids."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    from quarryspark.llm.bpe import shipped

    short_batches(df.sparkSession)
    spec = shipped(df.sparkSession, tokenizer_path)
    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        from pyspark import TaskContext

        codec = spec.value.codec()
        dtype, places = id_type(codec.table.size), np.arange(row_len, dtype=position_type(row_len))
        first = TaskContext.get().partitionId() << 33
        made = 0

        def flush(pieces):
            nonlocal made
            rows = best_fit_decreasing([len(x) for _, _, x in pieces], row_len)
            for at in range(0, len(rows), 256):
                out = {k: [] for k in schema.names}
                for row in rows[at : at + 256]:
                    own = [pieces[k] for k in row]
                    ids, positions, cu = np.full(row_len, pad_id, dtype), np.empty_like(places), [0]
                    for _, _, x in own:
                        end = cu[-1] + len(x)
                        ids[cu[-1] : end], positions[cu[-1] : end] = x, places[: len(x)]
                        cu.append(end)
                    positions[cu[-1] :] = places[: row_len - cu[-1]]
                    for k, v in zip(schema.names, (first + made, cu[-1], len(own), [d for d, _, _ in own], [p for _, p, _ in own], cu, ids.tobytes(), positions.tobytes())):
                        out[k].append(v)
                    made += 1
                yield pa.RecordBatch.from_pydict(out, schema=schema)

        pieces, held = [], 0
        for batch in larger(batches, piece):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), texts_ids(codec, batch.column("text"), piece)):
                for k in range(max(1, -(-len(ids) // row_len))):
                    pieces.append((doc, k, ids[k * row_len : (k + 1) * row_len]))
                held += len(ids) + 1
                if held >= shard_tokens:
                    yield from flush(pieces)
                    pieces, held = [], 0
        yield from flush(pieces)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), SCHEMA)


def write(packed: DataFrame, path: str, row_len: int, ids: int, pad_id: int = 0) -> None:
    """Write packed rows below ``path``: ``rows`` (Parquet) and ``layout`` (one line of JSON). ids: size of the vocabulary."""
    packed.write.mode("errorifexists").parquet(f"{path}/rows")
    layout = {"row_len": row_len, "pad_id": pad_id, "input_ids": id_type(ids).str, "position_ids": position_type(row_len).str}
    packed.sparkSession.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.text(f"{path}/layout")


def matrices(spark: SparkSession, path: str, rows: int = 4096) -> Iterator[tuple[np.ndarray, list[list[int]], np.ndarray]]:
    """(ids, cumulative segment lengths, positions) of up to ``rows`` packed rows at a time, in the order of pack_id."""
    layout = json.loads(spark.read.text(f"{path}/layout").first()[0])
    shape = lambda column, kind: np.frombuffer(b"".join(column), kind).reshape(-1, layout["row_len"])
    found = spark.read.parquet(f"{path}/rows").orderBy("pack_id").select("input_ids", "cu_seqlens", "position_ids").toLocalIterator()
    while block := [r for r, _ in zip(found, range(rows))]:
        a, b, c = zip(*block)
        yield shape(a, layout["input_ids"]), list(b), shape(c, layout["position_ids"])
