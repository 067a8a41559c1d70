"""Every registered query with SQL equals DuckDB's result on the smallest tables."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
from quarryspark.plans import concepts, logs, registry, searching, workflow  # noqa: F401 - add their queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([None if v != v else v for v in r]) for r in frame.where(frame.notna(), None).values.tolist())


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, db, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), db.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_event_and_title_is_looked_at(spark, sf_dir, db):
    for name, table, key in (("json_strict_keys", "events", "event_id"), ("title_nocase_lookup", "part", "p_partkey")):
        got = sorted(r[key] for r in registry.QUERIES[name](spark, sf_dir).collect())
        assert got == [r[0] for r in db.execute(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()]


def test_cascade_hashes_whole_texts(spark, sf_dir, db):
    got = {r["doc_id"]: (r["text_status"], r["text_sha256"]) for r in registry.QUERIES["extraction_cascade"](spark, sf_dir).collect()}
    texts = db.execute("SELECT doc_id, sha256(text) FROM documents").fetchall()
    assert len(got) == len(texts)
    for k, sha in texts:
        assert got[k] == (("native", sha) if k % 4 == 0 else ("ocr_unreviewed", sha) if k % 8 in (2, 3, 5) else ("failed", hashlib.sha256(b"").hexdigest()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
