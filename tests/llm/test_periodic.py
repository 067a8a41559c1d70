"""Periodic runs against their definition, and the whole query against a plain version."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryspark.llm import periodic, queries

DOC = "doc_id long, text string, runs string, start int"


def plain_runs(w, least, power):
    """(start, end, period) by comparing all words q apart, for every q."""
    found = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, power * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def plain_row(doc_id, text, change=True):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if change and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(((s, e - s, q) for s, e, q in plain_runs(w, 24, 3)), key=lambda r: (r[0], r[2]))
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2] or r[1] * best[2] == best[1] * r[2] and (r[0], r[2]) < (best[0], best[2]):
            best = r
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


@st.composite
def sequences(draw):
    parts = draw(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=7), st.integers(1, 7)), max_size=5))
    return [c for base, times in parts for c in base * times]


@given(sequences(), st.sampled_from([(2, 2), (5, 3), (8, 3), (7, 4), (24, 3)]))
@settings(max_examples=500, deadline=None)
def test_runs_equal_their_definition(w, shape):
    want = plain_runs(w, *shape)
    assert periodic.runs_of(w, *shape) == want
    found = periodic.document_runs(np.array(w, np.int64), np.array([0, len(w)]), *shape).get(0, [])
    assert sorted((s, s + n, q) for s, n, q in found) == want


@given(st.lists(sequences(), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_documents_do_not_meet(texts):
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = periodic.document_runs(np.array([c for t in texts for c in t], np.int64), offsets, 5, 3)
    for k, t in enumerate(texts):
        assert sorted((s, s + n, q) for s, n, q in found.get(k, [])) == plain_runs(t, 5, 3)


@given(sequences())
@settings(max_examples=150, deadline=None)
def test_factors_are_longest(w):
    at = 0
    for start, end, earlier in periodic.factors(w):
        assert start == at
        longest = max((n for n in range(len(w) - start + 1) if any(w[k : k + n] == w[start : start + n] for k in range(start))), default=0)
        assert end - start == max(longest, 1)
        assert w[earlier : earlier + end - start] == w[start:end] and earlier < start if longest else earlier == -1
        at = end
    assert at == len(w)


def test_shingles_of_a_run_stand_twice():
    assert periodic.shingle_width(24, 3) == 9
    for least, power in ((24, 3), (5, 3), (8, 2), (7, 4)):
        k = periodic.shingle_width(least, power)
        for q in range(1, 40):
            n = max(least, power * q)
            assert all(j + q + k <= n or j >= q for j in range(n - k + 1))


def test_query_equals_plain_version(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op13_periodic_runs"](spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(plain_row(*r) for r in texts)
    assert sum(r[1] > 0 for r in rows) > 5


def test_odd_texts(spark):
    texts = [
        None, "", " \n\t", "one", "a " * 23, "a " * 24, " x\x0by\x0cz\r\n" * 9, "a b c d e f g h i j " * 3, "Ünï cödé x\x1c " * 30,
        "a b " * 20 + "q " + "a b " * 20, "a a b " * 12 + "c " + "a a b " * 12, "start " + "x y z " * 400, "k" * 200_000 + " l" * 30, "p q r " * 8 + "p q",
    ]
    rows = [(k, t, "clash", 0) for k, t in enumerate(texts)] + [(3, "a " * 30, "", 0)] * 2
    df = spark.createDataFrame(rows, DOC)
    key = lambda r: (r[0], r[7])
    by_piece = [periodic.find_runs(df.coalesce(1), piece=p) for p in (1, 1 << 22)]
    for found in by_piece:
        got = []
        for r in found.collect():
            best = r.strongest
            listed = "".join(f"{x.start},{x.length},{x.period}\n" for x in r.runs)
            got.append((r.doc_id, len(r.runs), *(best or (None,) * 3), best and 1000 * best.length // best.period, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(r.collapsed.encode()).hexdigest()))
        assert sorted(got, key=key) == sorted((plain_row(k, t, change=False) for k, t, *_ in rows), key=key)
    assert by_piece[0].where("doc_id = 11").first().n_words == 1201


def test_long_text(spark):
    df = spark.createDataFrame([(1, "start " + "x y z " * 100_000, "", 0)], DOC)
    found = periodic.find_runs(df).first()
    assert [tuple(r) for r in found.runs] == [tuple(found.strongest)] == [(1, 300_000, 3)]
    assert (found.n_words, found.collapsed) == (300_001, "start x y z")


def test_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a " * 30, "", 0), (None, None, "", 0)], DOC)
    rows = periodic.find_runs(df, rewrite=queries.echoed).collect()
    assert sorted((len(r.runs), r.collapsed) for r in rows) == [(0, ""), (1, "a")]
    assert periodic.find_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="two periods"):
        periodic.find_runs(df, power=1)
