"""More queries over the driver tables: validation, requests, migrations, runs and search results by the product's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark.functions import text as T
from quarryspark.operators import extract, lifecycle, migrations, search, state, validate
from quarryspark.operators.evidence import select_evidence
from quarryspark.plans.registry import CONCEPT, _evidence_sql, query, views, with_views

#: A ULID and a value that is none, alike in Spark and DuckDB: the last digits are a number's.
GOOD, BAD = "01ARZ3NDEKTSV4RRFFQ", "01ARZ3NDEKTSV4RRFFU"


@query(_evidence_sql("AND s.source_id IN ('src1', 'src2', 'src3') AND v.version_seq = (SELECT max(version_seq) FROM v_versions w WHERE w.source_id = v.source_id)"))
def evidence_only_sources(spark, sf_dir):
    v = views(spark, sf_dir)
    return select_evidence(v.sources, v.versions, v.pages, CONCEPT, ["src1", "src2", "src3"]).select("score", "sort_name", "source_id", "source_version_id", "page_number", "page_id")


@query("SELECT doc_id AS source_version_id, 1 AS page_number, 'native' AS text_status, sha256(text) AS text_sha256, length(text) AS n FROM documents")
def whole_file_pages(spark, sf_dir):
    d = views(spark, sf_dir).read("documents")
    made = extract.text_pages(d.select(F.col("doc_id").alias("source_version_id")), d.select(F.col("doc_id").alias("source_version_id"), F.col("text").cast("binary").alias("content")))
    return made.select("source_version_id", "page_number", "text_status", "text_sha256", F.length("text").cast("long").alias("n"))


@query(with_views("SELECT page_id, CASE WHEN page_id = 7 THEN 'reviewed' ELSE text_status END AS text_status, sha256(CASE WHEN page_id = 7 THEN 'seen ü' ELSE text END) AS sha FROM v_pages", "v_pages"))
def corrected_page(spark, sf_dir):
    pages = views(spark, sf_dir).pages.withColumn("text_sha256", F.sha2("text", 256))
    return extract.corrected(pages, 7, "seen ü").select("page_id", "text_status", F.col("text_sha256").alias("sha"))


_OPEN = "(SELECT proposal_id, status, CASE WHEN proposal_id % 5 > 0 THEN article_id END AS article_id, CASE WHEN proposal_id % 5 = 0 THEN 'create_article' ELSE 'update_article' END AS operation FROM v_proposals)"


def _open(v: views) -> DataFrame:
    k = F.col("proposal_id") % 5
    return v.proposals.withColumns({"article_id": F.when(k > 0, F.col("article_id")), "operation": F.when(k == 0, "create_article").otherwise("update_article")})


@query(with_views(f"SELECT proposal_id, CASE WHEN article_id IS NULL AND status IN ('pending', 'approved') THEN 'superseded' ELSE status END AS status FROM {_OPEN}", "v_proposals"))
def supersede_creates(spark, sf_dir):
    return lifecycle.superseded(_open(views(spark, sf_dir)), None).select("proposal_id", "status")


@query(with_views(f"SELECT proposal_id, CASE WHEN article_id = 7 AND status IN ('pending', 'approved') THEN 'superseded' ELSE status END AS status FROM {_OPEN}", "v_proposals"))
def supersede_updates(spark, sf_dir):
    return lifecycle.superseded(_open(views(spark, sf_dir)), 7).select("proposal_id", "status")


@query("SELECT event_id AS run_id, CASE WHEN event_id % 4 < 3 THEN CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END ELSE 'running' END AS status, CASE WHEN event_id % 4 < 3 AND event_type = 'error' THEN 'did not finish' END AS error_message FROM events")
def runs_finished(spark, sf_dir):
    """Runs that began, then took their ends by id; a null of the change counts as a value."""
    e = views(spark, sf_dir).read("events")
    runs = e.select(F.col("event_id").alias("run_id"), F.lit("running").alias("status"), F.lit("old").alias("error_message"))
    failed = F.col("event_type") == "error"
    ends = e.where("event_id % 4 < 3").select(F.col("event_id").alias("run_id"), F.when(failed, "failed").otherwise("completed").alias("status"), F.when(failed, "did not finish").alias("error_message"))
    return state.overlay(runs.withColumn("error_message", F.lit(None).cast("string")), "run_id", ends)


_JSON = """(SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"page_id":"p","start_char":1,"end_char":2,"quote":"q"}' WHEN 1 THEN '{"page_id":"p","start_char":1,"end_char":2}' WHEN 2 THEN '{"page_id":"p","start_char":1,"end_char":2,"quote":"q","' || event_type || '":1}'
 WHEN 3 THEN '{"page_id":"p","start_char":-1,"end_char":2,"quote":"q"}' WHEN 4 THEN '{"page_id":7,"start_char":1,"end_char":2,"quote":"q"}' ELSE '{"page_id"' END AS doc, event_type FROM events)"""


@query(f"SELECT event_id, CASE event_id % 6 WHEN 1 THEN '/quote' WHEN 2 THEN '/' || event_type WHEN 3 THEN '/start_char' WHEN 4 THEN '/page_id' WHEN 5 THEN '' END AS structure_path, CASE event_id % 6 WHEN 1 THEN 'is required' WHEN 2 THEN 'is not allowed' WHEN 3 THEN 'must be a non-negative integer' WHEN 4 THEN 'must be a string' WHEN 5 THEN 'must be valid JSON' END AS structure_message FROM {_JSON}")
def strict_documents(spark, sf_dir):
    """Sound, lacking a key, with an unknown key, with wrong kinds of values, and no JSON."""
    e, k = views(spark, sf_dir).read("events"), F.col("event_id") % 6
    head = '{"page_id":"p","start_char":1,"end_char":2'
    doc = F.when(k == 0, head + ',"quote":"q"}').when(k == 1, head + "}").when(k == 2, F.concat(F.lit(head + ',"quote":"q","'), "event_type", F.lit('":1}')))
    doc = doc.when(k == 3, '{"page_id":"p","start_char":-1,"end_char":2,"quote":"q"}').when(k == 4, '{"page_id":7,"start_char":1,"end_char":2,"quote":"q"}').otherwise('{"page_id"')
    return validate.strict_structure(e.select("event_id", doc.alias("doc")), "doc", "citation").select("event_id", "structure_path", "structure_message")


@query("""SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN '/type' WHEN user_id < 50 THEN '/user' WHEN event_id % 50 = 0 THEN '/props/page' END AS structure_path,
 CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'is not a known value' WHEN user_id < 50 THEN 'must be a non-negative integer' WHEN event_id % 50 = 0 THEN 'is not allowed' END AS structure_message FROM events""")
def strict_events(spark, sf_dir):
    """Every event as a document around its own properties, against a shape with an enumeration and a nested object."""
    e = views(spark, sf_dir).read("events")
    props = F.when(F.col("event_id") % 50 == 0, F.regexp_replace("props", r"\}$", ', "page": 1}')).otherwise(F.col("props"))
    doc = F.concat(F.lit('{"props": '), props, F.lit(', "user": '), (F.col("user_id") - 50).cast("string"), F.lit(', "type": "'), "event_type", F.lit('"}'))
    shape = {"type": ("view", "click", "purchase"), "user": int, "props": {"k": int}}
    return validate.strict_structure(e.select("event_id", doc.alias("doc")), "doc", shape).select("event_id", "structure_path", "structure_message")


@query("""WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CASE WHEN text IS NULL THEN 'heading' WHEN role <> 'user' THEN 'key' END AS bad FROM conversations),
f AS (SELECT conv_id, min(i) AS i, arg_min(bad, i) AS bad FROM s WHERE bad IS NOT NULL GROUP BY 1)
SELECT c.conv_id, '/sections/' || i || '/' || bad AS structure_path, CASE bad WHEN 'key' THEN 'is not a known value' WHEN 'heading' THEN 'is required' END AS structure_message FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON f.conv_id = c.conv_id""")
def strict_payloads(spark, sf_dir):
    """Every conversation as a stored proposal whose sections are its turns: null texts are left out, other roles are no section's key."""
    t = views(spark, sf_dir).read("conversations")
    section = F.struct(F.when(F.col("role") == "user", "example").otherwise(F.col("role")).alias("key"), F.col("text").alias("heading"), F.array().cast("array<string>").alias("blocks"))
    turns = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", section.alias("s")))).alias("s"))
    article = F.struct(F.lit("T").alias("title"), F.lit("t").alias("slug"))
    payload = F.struct(F.lit(1).alias("schema_version"), F.lit("create_article").alias("operation"), article.alias("article"), F.transform("s", lambda x: x["s"]).alias("sections"), F.array().cast("array<string>").alias("related_concepts"))
    return validate.strict_structure(turns.select("conv_id", F.to_json(payload).alias("payload_json")), "payload_json").select("conv_id", "structure_path", "structure_message")


def _ulid(prefix: str, good, n) -> F.Column:
    return F.concat(F.lit(prefix), F.when(good, GOOD).otherwise(BAD), F.lpad(n.cast("string"), 7, "0"))


def _sql_ulid(prefix: str, good: str, n: str) -> str:
    return f"'{prefix}' || CASE WHEN {good} THEN '{GOOD}' ELSE '{BAD}' END || lpad(CAST({n} AS VARCHAR), 7, '0')"


_EMPTY = "must not be empty"


@query(f"""WITH p AS (SELECT doc_id AS k, text FROM documents), i AS (
 SELECT k, '/schema_version' AS path, 'must equal 1' AS message FROM p WHERE k % 2 = 1
 UNION ALL SELECT k, '/article/title', '{_EMPTY}' FROM p WHERE k % 3 = 0
 UNION ALL SELECT k, '/article/slug', 'must be a lowercase kebab-case slug' FROM p WHERE k % 5 = 0
 UNION ALL SELECT k, '/article/article_id', 'must be an art_ ULID' FROM p WHERE k % 7 = 1
 UNION ALL SELECT k, '/article/aliases', 'must contain unique values' FROM p WHERE k % 4 = 0
 UNION ALL SELECT k, '/sections', 'must contain at least one section' FROM p WHERE k % 11 = 0
 UNION ALL SELECT k, '/sections/0/blocks/0/text', '{_EMPTY}' FROM p WHERE k % 11 > 0 AND text = ''
 UNION ALL SELECT k, '/sections/0/blocks/1/text', '{_EMPTY}' FROM p WHERE k % 11 > 0 AND k % 6 = 0
 UNION ALL SELECT k, '/sections/0/blocks/1/citations', 'must contain at least one citation' FROM p WHERE k % 11 > 0
 UNION ALL SELECT k, '/related_concepts/0/citations', 'must contain at least one citation' FROM p
 UNION ALL SELECT k, '/sections/0/blocks/0/citations/0/page_id', 'must be a pg_ ULID' FROM p WHERE k % 11 > 0 AND k % 13 = 0
 UNION ALL SELECT k, '/sections/0/blocks/0/citations/0/end_char', 'must be greater than start_char' FROM p WHERE k % 11 > 0 AND k % 9 = 0
 UNION ALL SELECT k, '/sections/0/blocks/0/citations/0/quote', '{_EMPTY}' FROM p WHERE k % 11 > 0 AND k % 8 = 0
 UNION ALL SELECT k, '/operation', 'asked for create_article' FROM p WHERE k % 10 = 3
 UNION ALL SELECT k, '/article/title', 'asked for T' FROM p WHERE k % 3 = 0)
SELECT k AS proposal_id, path, message FROM i""")
def proposal_rules(spark, sf_dir):
    """Every semantic rule of a proposal, and its agreement with the request, over one proposal a document."""
    k, nil = F.col("doc_id"), F.lit(None).cast("string")
    cite = F.struct(_ulid("pg_", k % 13 != 0, k).alias("page_id"), F.lit(2).cast("long").alias("start_char"), F.when(k % 9 == 0, 2).otherwise(5).cast("long").alias("end_char"), F.when(k % 8 == 0, "").otherwise("q").alias("quote"))
    none = F.array().cast("array<struct<page_id:string,start_char:long,end_char:long,quote:string>>")
    blocks = F.array(F.struct(F.lit("paragraph").alias("kind"), F.col("text").alias("text"), F.array(cite).alias("citations")), F.struct(F.lit("bullet").alias("kind"), F.when(k % 6 == 0, "").otherwise("b").alias("text"), none.alias("citations")))
    section = F.struct(F.lit("key_ideas").alias("key"), F.lit("h").alias("heading"), blocks.alias("blocks"))
    sections = F.filter(F.array(section), lambda _: k % 11 > 0)
    article_id = F.when(k % 7 == 1, _ulid("art_", F.lit(False), k)).when(k % 7 == 2, _ulid("art_", F.lit(True), k))
    article = F.struct(article_id.alias("article_id"), F.when(k % 3 == 0, "").otherwise("T").alias("title"), F.when(k % 5 == 0, "No Slug").otherwise("a-slug").alias("slug"), F.array(F.lit("a"), F.when(k % 4 == 0, "a").otherwise("b")).alias("aliases"))
    related = F.array(F.struct(F.lit("R").alias("title"), F.lit("").alias("reason"), none.alias("citations")))
    p = F.struct(F.when(k % 2 == 1, 2).otherwise(1).alias("schema_version"), F.when(k % 10 == 3, "update_article").otherwise("create_article").alias("operation"), article.alias("article"), sections.alias("sections"), related.alias("related_concepts"))
    proposals = views(spark, sf_dir).read("documents").select(k.alias("proposal_id"), p.alias("p"))
    target = F.struct(F.lit("create_article").alias("operation"), F.lit("T").alias("title"), F.col("p.article.slug").alias("slug"), F.col("p.article.article_id").alias("article_id"))
    pages = spark.createDataFrame([], "page_id string, text string")
    rules = validate.response_issues(proposals, pages, target)
    return rules.where(~F.col("message").rlike("^(page_id|offsets|quote) pg_"))  # proposal_issues has those


_PAGES = f"(SELECT doc_id, source AS request_id, doc_id // 2 AS twin, {_sql_ulid('pg_', 'doc_id % 14 > 1', 'doc_id // 2')} AS page_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)"


@query(f"""WITH p AS {_PAGES}, r AS (SELECT DISTINCT source AS request_id, CAST(substr(source, 4) AS INTEGER) AS n FROM documents), i AS (
 SELECT request_id, '/article_id' AS path, 'create_article of ' || {_sql_ulid('art_', 'false', 'n')} AS message FROM r WHERE n % 4 = 0
 UNION ALL SELECT request_id, '/article_id', 'update_article of no article' FROM r WHERE n % 4 = 1
 UNION ALL SELECT request_id, '/article_id', 'must be an art_ ULID' FROM r WHERE n % 4 = 0
 UNION ALL SELECT 'none', '/pages', 'pages 0'
 UNION ALL SELECT request_id, '/pages/' || i || '/page_id', 'must be a pg_ ULID' FROM p WHERE doc_id % 14 <= 1
 UNION ALL SELECT request_id, '/pages/' || i || '/source_version_id', 'must be a ver_ ULID' FROM p WHERE doc_id % 15 = 0
 UNION ALL SELECT request_id, '/pages/' || i || '/page_number', 'must be at least 1' FROM p WHERE doc_id % 16 = 0
 UNION ALL SELECT request_id, '/pages/' || i || '/image_path', 'must be project-relative' FROM p WHERE doc_id % 17 = 0
 UNION ALL SELECT request_id, '/pages/' || i || '/language', '{_EMPTY}' FROM p WHERE doc_id % 18 = 0
 UNION ALL SELECT request_id, '/pages/' || i || '/text_status', 'text_status ocr_unreviewed' FROM p WHERE doc_id % 19 = 0
 UNION ALL SELECT request_id, '/pages/' || i || '/text_status', 'text_status failed' FROM p WHERE doc_id % 19 = 1
 UNION ALL SELECT request_id, '/pages/' || i || '/page_id', 'page of index ' || first FROM (SELECT *, min(i) OVER (PARTITION BY request_id, page_id) AS first FROM p) WHERE i > first)
SELECT request_id, path, message FROM i""")
def request_rules(spark, sf_dir):
    """Requests by source, each with its documents as pages; two documents in a row share a page id."""
    from pyspark.sql import Window

    d, k = views(spark, sf_dir).read("documents"), F.col("doc_id")
    n = F.substring("request_id", 4, 9).cast("int")
    requests = d.select(F.col("source").alias("request_id")).distinct()
    article = F.when(n % 4 == 0, _ulid("art_", F.lit(False), n)).when(n % 4 == 2, _ulid("art_", F.lit(True), n))
    requests = requests.select("request_id", F.when(n % 2 == 0, F.when(n % 4 == 0, "create_article").otherwise("update_article")).when(n % 4 == 1, "update_article").otherwise("create_article").alias("operation"), article.alias("article_id"))
    requests = requests.unionByName(spark.sql("SELECT 'none' AS request_id, 'create_article' AS operation, CAST(NULL AS STRING) AS article_id"))
    pages = d.select(
        F.col("source").alias("request_id"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("index"),
        _ulid("pg_", k % 14 > 1, F.floor(k / 2)).alias("page_id"), _ulid("ver_", k % 15 != 0, k).alias("source_version_id"), F.when(k % 16 == 0, 0).otherwise(1).alias("page_number"),
        F.when(k % 17 == 0, "../out.png").when(k % 17 == 1, "in/page.png").alias("image_path"), F.when(k % 18 == 0, "").otherwise("en").alias("language"),
        F.when(k % 19 == 0, "ocr_unreviewed").when(k % 19 == 1, "failed").otherwise("native").alias("text_status"),
    )
    return validate.request_issues(requests, pages)


@query("""SELECT doc_id AS proposal_id, CASE WHEN contains(text || CASE WHEN doc_id % 5 = 0 THEN '<!-- m:start x -->' ELSE '' END, '<!-- m:') THEN 'marker' WHEN doc_id % 7 = 0 OR contains(lang, chr(10)) THEN 'heading' WHEN doc_id % 9 = 0 THEN 'related' END AS found
 FROM documents WHERE doc_id % 5 = 0 OR contains(text, '<!-- m:') OR doc_id % 7 = 0 OR doc_id % 9 = 0""")
def unrenderable_proposals(spark, sf_dir):
    k = F.col("doc_id")
    sections = F.array(F.struct(F.when(k % 14 == 0, "").when(k % 7 == 0, "two\nlines").otherwise(F.col("lang")).alias("heading")))
    related = F.array(F.struct(F.when(k % 18 == 0, "a [[b").when(k % 9 == 0, "").otherwise("R").alias("title")))
    text = F.concat("text", F.when(k % 5 == 0, "<!-- m:start x -->").otherwise(""))
    p = views(spark, sf_dir).read("documents").select(k.alias("proposal_id"), text.alias("payload_json"), F.struct(sections.alias("sections"), related.alias("related_concepts")).alias("p"))
    bad = validate.unrenderable(p, "<!-- m:start x -->", "<!-- m:end x -->", "<!-- m:")
    return bad.select("proposal_id", F.when(F.col("message").contains("marker"), "marker").when(F.col("message").contains("heading"), "heading").otherwise("related").alias("found"))


_FILES = "(SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') || '_' || replace(p_name, ' ', '-') || '.sql' WHEN 1 THEN p_partkey // 8 || '_again.sql' WHEN 2 THEN p_partkey || '.sql' ELSE p_name END AS name FROM part)"
_NUMBER = r"CAST(nullif(regexp_extract(name, '^([0-9]{1,9})_[A-Za-z0-9_\-]+\.sql$', 1), '') AS INTEGER)"


def _migrations(v: views) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lpad(k.cast("string"), F.greatest(F.lit(3), F.length(k.cast("string"))), F.lit("0")), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".sql")))
    name = name.when(k % 4 == 1, F.concat(F.floor(k / 8).cast("string"), F.lit("_again.sql"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(".sql"))).otherwise(F.col("p_name"))
    return v.read("part").select("p_partkey", name.alias("name"))


_FILES = _FILES.replace("lpad(CAST(p_partkey AS VARCHAR), 3, '0')", "lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(3, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0')")


@query(f"SELECT p_partkey, CAST({_NUMBER} AS VARCHAR) AS version FROM {_FILES}")
def migration_names(spark, sf_dir):
    return _migrations(views(spark, sf_dir)).select("p_partkey", migrations.version_of(F.col("name")).cast("string").alias("version"))


@query(f"SELECT version, count(*) AS files FROM (SELECT {_NUMBER} AS version FROM {_FILES}) WHERE version IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def migration_duplicates(spark, sf_dir):
    return migrations.duplicates(migrations.discovered(_migrations(views(spark, sf_dir))))


@query(f"SELECT version, name FROM (SELECT {_NUMBER} AS version, name FROM {_FILES}) WHERE version IS NOT NULL AND version NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def migrations_pending(spark, sf_dir):
    v = views(spark, sf_dir)
    applied = v.read("part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("version"))
    return migrations.pending(migrations.discovered(_migrations(v)), applied)


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 's-v.pdf' WHEN 1 THEN 's-v.Text' ELSE 's-v.md' END AS file, page_id % 2 = 0 AS broken FROM pages")
def vault_names(spark, sf_dir):
    k = F.col("page_id") % 3
    name, kind = F.when(k == 1, "a.b.Text").otherwise("plain"), F.when(k == 0, "pdf").when(k == 1, "text").otherwise("markdown")
    title = F.concat(F.lit("a"), F.when(F.col("page_id") % 4 == 0, "\n").when(F.col("page_id") % 4 == 2, "\r").otherwise(" "), F.lit("b"))
    return views(spark, sf_dir).read("pages").select("page_id", T.vault_filename(F.lit("s"), F.lit("v"), name, kind).alias("file"), T.has_line_break(title).alias("broken"))


@query("SELECT doc_id AS article_id, 'notes/' || doc_id || '.md' AS vault_path, doc_id % 5 <> 0 AS safe FROM documents WHERE doc_id % 3 < 2".replace("'notes/' || doc_id", "CASE doc_id % 5 WHEN 0 THEN '../' ELSE 'notes/' END || doc_id"))
def search_result_paths(spark, sf_dir):
    """Results take their article's path, which must be a safe relative one; results without an article are none."""
    d, k = views(spark, sf_dir).read("documents"), F.col("doc_id")
    found = d.select(k.alias("article_id"), F.col("source").alias("title"), (-k).cast("double").alias("relevance"))
    articles = d.where(k % 3 < 2).select(k.alias("article_id"), F.concat(F.when(k % 5 == 0, "../").otherwise("notes/"), k.cast("string"), F.lit(".md")).alias("vault_path"))
    return search.with_paths(found, articles).select("article_id", "vault_path", "safe")


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS articles, count(*) AS occurrences FROM t GROUP BY 1""".replace("\\\\", "\\"))
def postings_statistics(spark, sf_dir):
    d = views(spark, sf_dir).index.withColumns({"title": F.lit(""), "aliases": F.lit("")})
    postings = search.build_index(d).postings.where(F.col("term") != search.SENTENCE)
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("articles"), F.sum(F.size("places")).alias("occurrences"))


@query(with_views("SELECT page_id, page_number, text_status FROM v_pages WHERE source_version_id = 7", "v_pages"))
def pages_of_version(spark, sf_dir):
    return extract.pages_of(views(spark, sf_dir).pages, 7).select("page_id", "page_number", "text_status")


@query("SELECT doc_id AS page_id, doc_id % 10 + 1 AS page_number FROM documents WHERE doc_id // 10 = 3 AND doc_id % 10 = 4")
def page_by_number(spark, sf_dir):
    k = F.col("doc_id")
    pages = views(spark, sf_dir).read("documents").select(k.alias("page_id"), F.floor(k / 10).alias("source_version_id"), (k % 10 + 1).alias("page_number"))
    return extract.pages_of(pages, 3, 5).select("page_id", "page_number")


@query(with_views("SELECT proposal_id, article_id, status FROM v_proposals WHERE proposal_id = 11", "v_proposals"))
def proposal_by_id(spark, sf_dir):
    return lifecycle.one(views(spark, sf_dir).proposals, 11).select("proposal_id", "article_id", "status")


@query("SELECT p_partkey AS article_id, p_name AS title FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_partkey % 2 = 0)")
def articles_by_title(spark, sf_dir):
    part = views(spark, sf_dir).read("part")
    articles = part.select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("title"))
    return lifecycle.titled(articles, part.where("p_partkey % 2 = 0").select(F.upper("p_name").alias("wanted")))


@query("SELECT p_partkey AS article_id, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_brand ELSE p_name END AS title FROM part UNION ALL SELECT -1 - p_partkey, 'made' FROM part WHERE p_partkey % 5 = 0")
def article_rows_replaced(spark, sf_dir):
    part, k = views(spark, sf_dir).read("part"), F.col("p_partkey")
    old = part.select(k.alias("article_id"), F.col("p_name").alias("title"))
    new = part.where(k % 3 == 0).select(k.alias("article_id"), F.concat(F.lit("new "), "p_brand").alias("title"))
    return state.replace_rows(old, "article_id", new.unionByName(part.where(k % 5 == 0).select((-1 - k).alias("article_id"), F.lit("made").alias("title"))))


@query("SELECT page_id, page_id % 5 = 0 AS fits FROM pages")
def file_names(spark, sf_dir):
    k = F.col("page_id") % 5
    title = F.when(k == 0, "A title: ü.").when(k == 1, "a/b").when(k == 2, "..").when(k == 3, "a\nb").otherwise("")
    return views(spark, sf_dir).read("pages").select("page_id", T.is_file_name(title).alias("fits"))


@query("SELECT conv_id AS proposal_id, string_agg('/' || role || '/' || turn || ': of ' || length(text), '; ' ORDER BY '/' || role || '/' || turn || ': of ' || length(text)) AS issues FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def issue_lines(spark, sf_dir):
    t = views(spark, sf_dir).read("conversations").where("text IS NOT NULL")  # an issue has a message
    issues = t.select(F.col("conv_id").alias("proposal_id"), F.concat(F.lit("/"), "role", F.lit("/"), F.col("turn").cast("string")).alias("path"), F.concat(F.lit("of "), F.length("text").cast("string")).alias("message"))
    return validate.formatted(issues)


_STORED = '{"schema_version":1,"operation":"create_article","article":{"title":"T","slug":"t"},"sections":[],"related_concepts":[]'


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'damaged: : must be valid JSON' WHEN 2 THEN 'names another operation' WHEN 3 THEN 'damaged: /' || event_type || ': is not allowed' END AS issue FROM events""")
def stored_payloads(spark, sf_dir):
    k = F.col("event_id") % 4
    text = F.when(k == 1, _STORED).when(k == 3, F.concat(F.lit(_STORED + ',"'), "event_type", F.lit('":1}'))).otherwise(_STORED + "}")
    rows = views(spark, sf_dir).read("events").select("event_id", text.alias("payload_json"), F.when(k == 2, "update_article").otherwise("create_article").alias("operation"))
    return validate.stored_issue(rows).select("event_id", "issue")


@query("""SELECT conv_id, turn, '{"schema_version":1,"operation":"create_article","article":{"title":' || to_json(text) || ',"slug":"s","aliases":[' || to_json(role) || ']},"sections":[],"related_concepts":[]}' AS payload FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM conversations)""")
def payload_round_trip(spark, sf_dir):
    """A stored payload, parsed and written again, is the same text."""
    value = lambda c: F.expr(f"substring(to_json(struct({c} AS v)), 6, length(to_json(struct({c} AS v))) - 6)")
    doc = F.concat(F.lit('{"schema_version":1,"operation":"create_article","article":{"title":'), value("text"), F.lit(',"slug":"s","aliases":['), value("role"), F.lit(']},"sections":[],"related_concepts":[]}'))
    t = views(spark, sf_dir).turns.select("conv_id", "turn", doc.alias("payload_json"))
    return validate.parsed(t).select("conv_id", "turn", F.to_json("p").alias("payload"))


@query("SELECT event_id, true AS well_formed FROM events")
def time_stamps(spark, sf_dir):
    return views(spark, sf_dir).read("events").select("event_id", T.utc_now().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("well_formed"))
