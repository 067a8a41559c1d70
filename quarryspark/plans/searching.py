"""Queries of full-text search over the driver tables: many searches at once, phrases, snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark.operators import search
from quarryspark.plans.registry import query, views

_TOK = r"list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_COLUMNS = (("source", 10.0), ("lang", 5.0), ("text", 1.0))
#: Each token of each column: its weight, its place and the article's statistics.
_TOKENS = (
    "t AS ("
    + " UNION ALL ".join(f"SELECT doc_id, {k} AS c, {w} AS w, unnest(x) AS term, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {_TOK.format(col)} AS x FROM documents)" for k, (col, w) in enumerate(_COLUMNS))
    + "), dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY 1), n AS (SELECT (SELECT count(*) FROM documents) AS N, (SELECT sum(dl) FROM dl)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl)"
)
_RANKED = """u AS (SELECT query_id, f.doc_id, count(*) AS c, sum(times * CASE WHEN ln((N - n_t + 0.5) / (n_t + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - n_t + 0.5) / (n_t + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS r
  FROM q JOIN f USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = f.doc_id, n GROUP BY ALL),
s AS (SELECT query_id, doc_id, c, -round(r * pow(10, 11 - floor(log10(r)))) / pow(10, 11 - floor(log10(r))) AS r FROM u)
SELECT query_id, rank, article_id, title, round(r, 6) AS relevance FROM (SELECT s.query_id, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY r, lower(d.source), s.doc_id) AS INTEGER) AS rank, s.doc_id AS article_id, d.source AS title, r
  FROM s JOIN (SELECT query_id, count(*) AS k FROM q GROUP BY 1) k ON k.query_id = s.query_id AND k.k = s.c JOIN documents d ON d.doc_id = s.doc_id) WHERE rank <= 20"""


def _listed(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "article_id", "title", F.round("relevance", 6).alias("relevance"))


def _words_sql(asked: str) -> str:
    return f"WITH {_TOKENS}, f AS (SELECT doc_id, term, sum(w)::DOUBLE AS f FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS n_t FROM f GROUP BY 1), q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({asked}) AS term FROM benchmark) GROUP BY ALL), {_RANKED}"


@query(_words_sql(_TOK.format("text")))
def search_many(spark, sf_dir):
    """Every benchmark passage as a search: the 20 best documents that hold all of its words."""
    v = views(spark, sf_dir)
    asked = v.read("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _listed(search.search_many(v.index, asked, 20, index=v.stored_index))


def _pairs(v: views) -> DataFrame:
    return v.read("benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(search.tokens(F.col("text")), 1, 2), " ").alias("query"))


@query(_words_sql(f"({_TOK.format('text')})[1:2]"))
def search_pairs(spark, sf_dir):
    """The first two words of every benchmark passage as a search."""
    v = views(spark, sf_dir)
    return _listed(search.search_many(v.index, _pairs(v), 20, index=v.stored_index))


@query(f"""WITH {_TOKENS}, w AS (SELECT item_id AS query_id, {_TOK.format('text')} AS x FROM benchmark), q AS (SELECT query_id, x[1] || ' ' || x[2] || ' ' || x[3] AS term, x[1] AS a, x[2] AS b, x[3] AS d, 1 AS times FROM w),
p AS (SELECT DISTINCT term, a, b, d FROM q), f AS (SELECT t.doc_id, p.term, sum(t.w)::DOUBLE AS f FROM p JOIN t ON t.term = p.a JOIN t u ON u.doc_id = t.doc_id AND u.c = t.c AND u.i = t.i + 1 AND u.term = p.b JOIN t v ON v.doc_id = t.doc_id AND v.c = t.c AND v.i = t.i + 2 AND v.term = p.d GROUP BY ALL),
df AS (SELECT term, count(*) AS n_t FROM f GROUP BY 1), {_RANKED}""")
def search_phrases(spark, sf_dir):
    """The first three words of every benchmark passage as one phrase."""
    v = views(spark, sf_dir)
    words = F.slice(search.tokens(F.col("text")), 1, 3)
    asked = v.read("benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, "—").alias("query"))
    return _listed(search.search_many(v.index, asked, 20, index=v.stored_index))


_CHUNKS = r"regexp_extract_all(text, '[^\p{L}\p{N}]*[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*')"


@query(f"""WITH d AS (SELECT doc_id, text, {_CHUNKS} AS chunks FROM documents), t AS (SELECT doc_id, unnest(x) AS term, generate_subscripts(x, 1) - 1 AS i FROM (SELECT doc_id, {_TOK.format('text')} AS x FROM documents)),
h AS (SELECT doc_id, i, CASE term WHEN 'that' THEN 0 ELSE 1 END AS k FROM t WHERE term IN ('that', 'with')), m AS (SELECT doc_id FROM h GROUP BY 1 HAVING count(DISTINCT k) = 2),
e AS (SELECT doc_id, i FROM (SELECT doc_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) - 1 AS i FROM d) WHERE i = 0 OR regexp_matches(chunk, '[.:][ \\t\\n\\r]+[\\p{{L}}\\p{{N}}]')),
o AS (SELECT h.doc_id, h.i, max(e.i) AS sentence FROM h JOIN m USING (doc_id) JOIN e ON e.doc_id = h.doc_id AND e.i <= h.i GROUP BY ALL),
a AS (SELECT o.doc_id, o.i, o.sentence, 999 * count(DISTINCT h.k) + count(*) AS score, max(h.i) + 1 AS ends FROM o JOIN h ON h.doc_id = o.doc_id AND h.i BETWEEN o.i AND o.i + 23 GROUP BY ALL),
b AS (SELECT o.doc_id, o.i, 999 * count(DISTINCT h.k) + count(*) + CASE WHEN o.sentence = 0 THEN 120 ELSE 100 END AS score FROM o JOIN h ON h.doc_id = o.doc_id AND h.i BETWEEN o.sentence AND o.sentence + 23 GROUP BY o.doc_id, o.i, o.sentence),
c AS (SELECT a.doc_id, a.i, 1 AS kind, a.score, greatest(least(a.i - (24 - (a.ends - a.i)) // 2, len(d.chunks) - 24), 0) AS p FROM a JOIN d USING (doc_id)
  UNION ALL SELECT a.doc_id, a.i, 0, b.score, a.sentence FROM a JOIN b USING (doc_id, i) JOIN d USING (doc_id) WHERE len(d.chunks) > 24 AND a.sentence < a.i),
g AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i, kind DESC) AS r FROM c) WHERE r = 1),
w AS (SELECT doc_id, p, unnest(range(p, least(p + 24, len(chunks)))) AS i, chunks FROM g JOIN d USING (doc_id)),
y AS (SELECT w.doc_id, w.i, w.p, chunks[w.i + 1] AS chunk, regexp_extract(chunks[w.i + 1], '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{Mn}}]*$') AS word, h.i IS NOT NULL AS hit FROM w LEFT JOIN h ON h.doc_id = w.doc_id AND h.i = w.i)
SELECT y.doc_id AS article_id, CASE WHEN any_value(y.p) > 0 THEN ' ... ' ELSE '' END || string_agg(CASE WHEN y.i = y.p AND y.p > 0 THEN '' ELSE left(chunk, length(chunk) - length(word)) END || CASE WHEN hit THEN '[' || word || ']' ELSE word END, '' ORDER BY y.i)
  || CASE WHEN any_value(y.p) + 24 >= any_value(len(d.chunks)) THEN any_value(substr(d.text, 1 + length(array_to_string(d.chunks, '')))) ELSE ' ... ' END AS snippet FROM y JOIN d USING (doc_id) GROUP BY 1""")
def search_snippets(spark, sf_dir):
    """The snippet of every document that holds both words, best or not."""
    v = views(spark, sf_dir)
    asked = search.phrases_of(spark.createDataFrame([(0, "that with")], "query_id int, query string"))
    ranking = search.Ranking(v.stored_index, asked, 100)
    return search.cut(v.index, v.stored_index, asked, ranking.scores(ranking.blocks).select("query_id", "article_id")).select("article_id", "snippet")


@query()
def search_skipping(spark, sf_dir):
    """How many of the blocks and postings that hold two words are read for their best document. Equal results are tested."""
    v = views(spark, sf_dir)
    return search.Ranking(v.stored_index, search.phrases_of(_pairs(v)), 1).skipping()
