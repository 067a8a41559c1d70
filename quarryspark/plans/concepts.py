"""Evidence for a table of concepts over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark.functions import text as T
from quarryspark.operators import concepts
from quarryspark.plans.registry import MATCH, query, views, with_views

#: A passage is a concept: its first words are the title, the next an alias, beside a source's name; single words and the
#: first eight are keywords.
_PHRASES = """(SELECT item_id AS concept_id, array_to_string(x[1:2], ' ') AS k, 1000 AS a, 800 AS b FROM w UNION ALL SELECT item_id, array_to_string(x[3:5], ' '), 600, 400 FROM w
  UNION ALL SELECT item_id, 'src' || item_id % 20, 600, 400 FROM w UNION ALL SELECT item_id, unnest(x[6:8]), 40, 20 FROM w UNION ALL SELECT item_id, array_to_string(x[1:8], ' '), 40, 20 FROM w)"""


def table_of_concepts(v: views) -> DataFrame:
    words = F.split(T.match_text(F.col("text")), " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    name = F.concat(F.lit("SRC"), (F.col("item_id") % 20).cast("string"))
    return v.read("benchmark").select(F.col("item_id").alias("concept_id"), part(1, 2).alias("title"), F.array(part(3, 3), name).alias("aliases"), F.concat(F.slice(words, 6, 3), F.array(part(1, 8))).alias("keywords"))


@query(with_views(
    f"""SELECT concept_id, page_id, sort_name, CAST(sum(CASE WHEN contains(' ' || sort_name || ' ', ' ' || k || ' ') THEN a ELSE 0 END + CASE WHEN contains(t, ' ' || k || ' ') THEN b ELSE 0 END) AS INTEGER) AS score
FROM (SELECT p.page_id, {MATCH.format('s.display_name')} AS sort_name, ' ' || {MATCH.format('p.text')} || ' ' AS t FROM v_pages p JOIN v_versions v ON v.source_version_id = p.source_version_id JOIN v_sources s ON s.source_id = v.source_id
  WHERE s.archived_at IS NULL AND p.text_status IN ('native', 'reviewed') AND p.text <> '') e
JOIN (SELECT * FROM (WITH w AS (SELECT item_id, string_split({MATCH.format('text')}, ' ') AS x FROM benchmark) SELECT * FROM {_PHRASES}) WHERE k <> '') q ON contains(t, ' ' || k || ' ') OR contains(' ' || sort_name || ' ', ' ' || k || ' ')
GROUP BY ALL HAVING score > 0""",
    "v_sources", "v_versions", "v_pages",
))
def evidence_many(spark, sf_dir):
    """The evidence of every concept, each document a source of its own."""
    v = views(spark, sf_dir)
    own = F.concat_ws(":", "source_id", "source_version_id").alias("source_id")
    versions = v.versions.select(own, "source_version_id", "version_seq")
    sources = v.versions.select("source_id", "source_version_id").join(v.sources, "source_id").select(own, "display_name", "source_kind", "archived_at")
    found = concepts.select_for_all(sources, versions, v.pages, concepts.phrases_of(table_of_concepts(v)))
    return found.select("concept_id", "page_id", "sort_name", "score")
