"""Window packing: least squares against projected gradients, placement on any sizes, and the whole query against the library."""

import collections
import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarryspark.llm import queries, window_pack

DOC = "doc_id long, text string, ids string, start int"


def test_combinations_are_all():
    for window, depth in ((2, 3), (4, 3), (8, 3), (8, 2), (16, 4)):
        want = {tuple(sorted(c, reverse=True)) for n in range(1, depth + 1) for c in itertools.product(range(1, window), repeat=n) if sum(c) == window}
        assert sorted(window_pack.combinations(window, depth)) == sorted(want)


@given(st.integers(1, 6), st.integers(1, 9), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_least_squares_is_optimal(rows, columns, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 3, (rows, columns)).astype(float), rng.integers(-3, 9, rows).astype(float)
    x = window_pack.non_negative_least_squares(a, b)
    slope = a.T @ (a @ x - b)
    assert (x >= 0).all()
    assert (slope >= -1e-6).all() and np.abs(slope * x).max(initial=0) < 1e-5  # the conditions of an optimum


@given(st.lists(st.integers(0, 60), min_size=7, max_size=7))
@settings(max_examples=60, deadline=None)
def test_repeats_stay_within_the_histogram(counts):
    used = np.zeros(7, int)
    for lengths, times in window_pack.repeats(np.array(counts), 8):
        assert sum(lengths) == 8 and times > 0 and len(lengths) <= 3
        for n in lengths:
            used[n - 1] += times
    assert (used <= counts).all()


def test_a_histogram_of_combinations_is_solved_wholly():
    counts = np.zeros(63, int)
    for lengths, times in (((40, 24), 30), ((32, 16, 16), 50), ((63, 1), 7)):
        for n in lengths:
            counts[n - 1] += times
    assert sum(times * len(c) for c, times in window_pack.repeats(counts, 64)) >= 0.95 * counts.sum()


def check_places(sizes, placed, row_len):
    """Every id in one piece, every sequence gapless and full or a power of two."""
    filled, read = collections.defaultdict(list), np.zeros(len(sizes), np.int64)
    for doc, start, length, sequence, offset in zip(*(c.tolist() for c in placed)):
        assert length > 0 and start == read[doc]
        read[doc] += length
        filled[sequence].append((offset, length))
    assert (read == sizes).all()
    assert sorted(filled) == list(range(len(filled)))
    short = 0
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= row_len and at & (at - 1) == 0
        short += at < row_len
    assert short <= 2 * row_len.bit_length()


@given(st.lists(st.one_of(st.integers(1, 40), st.integers(1, 600)), min_size=1, max_size=80), st.sampled_from([(64, 8), (64, 2), (16, 4), (256, 16)]))
@settings(max_examples=150, deadline=None)
def test_places(sizes, shape):
    sizes = np.array(sizes, np.int64)
    check_places(sizes, window_pack.place(sizes, *shape), shape[0])


def test_places_of_equal_and_of_spread_sizes():
    rng = np.random.default_rng(3)
    for sizes in (np.full(500, 2600), np.full(1, 1), np.full(300, 4096), rng.lognormal(6, 1.5, 2000).astype(np.int64) + 1):
        placed = window_pack.place(sizes, 4096, 64)
        check_places(sizes, placed, 4096)
        if len(sizes) == 2000:  # few cuts besides the two that each document's own length asks for
            own = (sizes // 4096).sum() + (sizes % 4096 >= 64).sum() + (sizes % 64 > 0).sum()
            assert own <= len(placed[0]) <= 1.1 * own


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def check_rows(rows, texts, library, row_len):
    """rows: (doc_id, start, length, crc, doc_tokens, sequence_id, offset)."""
    want = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    read, filled = dict.fromkeys(want, 0), collections.defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in sorted(rows, key=lambda r: (r[0], r[1])):
        assert total == len(want[doc]) and start == read[doc]
        assert crc == zlib.crc32(want[doc][start : start + length].tobytes())
        read[doc] += length
        filled[sequence].append((offset, length))
    assert read == {k: len(v) for k, v in want.items()}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= row_len and at & (at - 1) == 0


def test_query_equals_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op12_pack_windows"](spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    check_rows([tuple(r) for r in got.collect()], texts, library, 4096)


def test_odd_texts_and_many_shards(spark, library):
    texts = {1: None, 2: "", 3: " \n", 4: "same words", 5: "same words", 6: "Ünïcödé <|endoftext|> !", 7: "long words " * 9000, 8: "x" * 70_000}
    df = spark.createDataFrame([(k, t, "x", 0) for k, t in texts.items()], DOC).coalesce(1)
    rows = window_pack.pack(df, queries.tokenizer_path(), end_id=2, row_len=256, unit=16, shard_tokens=1000, piece=4096).collect()
    check_rows([(r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in rows], texts, library, 256)
    assert {r.doc_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}


def test_null_and_repeated_ids_and_no_rows(spark, library):
    df = spark.createDataFrame([(None, "a b", "", 0), (None, "a b", "", 0), (7, "c", "", 0), (7, "c", "", 0)], DOC)
    rows = window_pack.pack(df, queries.tokenizer_path(), end_id=2).collect()
    assert collections.Counter((r.doc_id, sum(1 for _ in r.ids) // 4) for r in rows if r.start == 0 and r.length == r.doc_tokens)
    assert sum(r.length for r in rows) == 3 + 3 + 2 + 2
    assert {(r.doc_id, r.doc_tokens) for r in rows} == {(None, 3), (7, 2)}
    assert window_pack.pack(df.limit(0), queries.tokenizer_path(), end_id=2).collect() == []
    with pytest.raises(ValueError, match="powers of two"):
        window_pack.pack(df, queries.tokenizer_path(), end_id=2, row_len=1000)
