"""Full-text search against SQLite's FTS5: matches, scores, phrases, snippets; blocks are skipped without a change of results."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from quarryspark.operators import search
from quarryspark.plans.registry import views

WORDS = ["a", "b", "c", "dé", "Ee", "f1", "g", "h", "étà", "zz"]
GAPS = [" "] * 8 + [". ", ": ", ".", "\n", ":\n\t", "—", " - ", ".  ", ", "]


def some_text(rng, n):
    words = WORDS[: rng.choice([3, 10, 10])]
    return rng.choice(["", " ", ". ", "("]) + "".join(rng.choice(words) + rng.choice(GAPS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    docs = [(k, some_text(rng, rng.randrange(4)), some_text(rng, rng.randrange(4)), some_text(rng, rng.choice([0, 3, 10, 24, 25, 30, 60, 200]))) for k in range(150)]
    word = lambda: rng.choice(WORDS) if rng.random() < 0.7 else "—".join(rng.choice(WORDS) for _ in range(rng.choice([2, 2, 3])))
    queries = [(k, " ".join(word() for _ in range(rng.choice([1, 1, 2, 2, 3])))) for k in range(30)] + [(30, "a a—a A"), (31, "nowhere a")]
    articles = spark.createDataFrame(docs, "article_id long, title string, aliases string, body string")
    return docs, dict(queries), articles, search.stored(search.build_index(articles)), search.phrases_of(spark.createDataFrame(queries, "query_id int, query string"))


@pytest.fixture(scope="module")
def fts(corpus):
    docs, queries = corpus[:2]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, title, aliases, body, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", docs)
    out = {}
    for k, q in queries.items():
        match = " AND ".join(f'"{w}"' for w in re.findall("[A-Za-z0-9\u0080-\U0010ffff]+", q))
        for doc, score, snippet in db.execute("SELECT id, bm25(f, 0, 10, 5, 1), snippet(f, 3, '[', ']', ' ... ', 24) FROM f WHERE f MATCH ?", (match,)):
            out[k, doc] = score, snippet
    return out


def test_scores_and_snippets_equal_fts(corpus, fts):
    docs, queries, articles, index, asked = corpus
    ranking = search.Ranking(index, asked, 100)
    found = ranking.scores(ranking.blocks)
    got = {(r.query_id, r.article_id): -r.score for r in found.collect()}
    assert got.keys() == fts.keys() and len(got) > 1000
    assert all(abs(got[k] - fts[k][0]) < 1e-8 for k in got)
    shown = {(r.query_id, r.article_id): r.snippet for r in search.cut(articles, index, asked, found.select("query_id", "article_id")).collect()}
    assert shown == {k: v[1] for k, v in fts.items()}
    for k in list(fts)[::7]:
        assert search.snippet(docs[k[1]][3], search.literal_terms(queries[k[0]])) == fts[k][1]


@pytest.mark.parametrize("limit", [3, 100])
def test_best_ones_equal_exhaustive_scoring(corpus, fts, limit):
    docs, queries, articles, index, asked = corpus
    ranking = search.Ranking(index, asked, limit)
    got = {k: [] for k in queries}
    for r in sorted(ranking.top(articles).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r)
    for k in queries:
        lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
        want = sorted((float(f"{s:.12g}"), lower(docs[d][1]), d) for (q, d), (s, _) in fts.items() if q == k)[:limit]
        assert [r["rank"] for r in got[k]] == list(range(1, len(want) + 1))
        assert all(abs(r.relevance - s) < 1e-8 for r, (s, _, _) in zip(got[k], want))
        if len({s for s, _, _ in want}) == len(want):
            assert [r.article_id for r in got[k]] == [d for _, _, d in want]
    if limit == 3:
        told = ranking.skipping().agg(F.sum("blocks"), F.sum("blocks_read"), F.sum("postings"), F.sum("postings_read")).first()
        assert told[1] < 0.5 * told[0] and told[3] < 0.6 * told[2]


def test_blocks_are_skipped_on_documents(spark):
    """One large query over many documents: the same best ones, from a part of the blocks."""
    v = views(spark, "/root/testdata/sf0.01")
    asked = search.phrases_of(spark.createDataFrame([(0, "that"), (1, "the and"), (2, "of"), (3, "die")], "query_id int, query string"))
    ranking = search.Ranking(v.stored_index, asked, 10)
    told = ranking.skipping().collect()
    assert all(r.blocks_read <= r.blocks for r in told) and sum(r.blocks_read for r in told) < 0.6 * sum(r.blocks for r in told)
    want = ranking._best(ranking.scores(ranking.blocks).join(v.index.select("article_id", "title"), "article_id"), 10, F.desc(F.format_string("%.11e", "score").cast("double")), F.lower("title"), F.col("article_id"))
    key = lambda rows, place: sorted((r.query_id, r[place], r.article_id) for r in rows.collect())
    assert key(ranking.top(v.index), "rank") == key(want, "nth")


def test_phrases_read_only_their_terms(spark, corpus):
    articles, index = corpus[2:4]
    found = search.search(articles, "a—b", index=index)
    plan = found._jdf.queryExecution().toString()
    assert "IN (term, [.,a,b])" in plan.replace("In(term", "IN (term") or re.search(r"In\(term, \[\.,\s*a,\s*b\]\)", plan)


def test_queries_that_are_refused(spark):
    queries = spark.createDataFrame([(1, "fine"), (2, "--- !"), (3, None), (4, "x" * 5000), (5, "é"), (6, "—")], "query_id int, query string")
    assert {(r.query_id, r.issue) for r in search.refused(queries).collect()} == {(2, "query has no searchable terms"), (3, "query has no searchable terms"), (4, "query is too long")}
    assert {r.query_id: r.tokens for r in search.phrases_of(queries).collect()} == {1: ["fine"], 5: ["e"], 6: []}


def test_odd_articles(spark):
    rows = [(None, "t", None, "a b"), (1, None, None, None), (2, "", "", ""), (3, "a", "a", "á á A"), (4, "", "", "́ ... !")]
    articles = spark.createDataFrame(rows, "article_id long, title string, aliases string, body string")
    index = search.stored(search.build_index(articles))
    assert sorted((r.article_id or 0, r.dl) for r in index.lengths.collect()) == [(0, 3), (1, 0), (2, 0), (3, 5), (4, 0)]
    assert [r.article_id for r in search.search(articles, "a", index=index).collect()] == [3]  # rows without an id are no results
    empty = articles.limit(0)
    assert search.search(empty, "a").collect() == []


def test_folding_equals_fts_on_old_letters(spark):
    """Every letter and digit of the scripts below U+0500 and of U+1E00-U+1FFF that both Unicode tables know."""
    import unicodedata

    letters = [c for c in (*range(0x30, 0x500), *range(0x1E00, 0x2000)) if unicodedata.ucd_3_2_0.category(chr(c))[0] in "LN"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61 remove_diacritics 2')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(c, f"x{chr(c)}y") for c in letters])
    want = dict(db.execute("SELECT doc, term FROM v"))
    got = {r.c: r.k for r in spark.createDataFrame([(c, f"x{chr(c)}y") for c in letters], "c int, t string").select("c", search.tokens(F.col("t")).alias("k")).collect()}
    other = {chr(c) for c in letters if got[c] != [want[c]]}
    assert other <= set("Ǡǡ")  # a letter with two marks, which the other table lacks
    assert all(search.fold_py(f"x{chr(c)}y") == got[c][0] for c in letters)
