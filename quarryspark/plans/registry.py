"""Name -> query over the driver tables, and the DuckDB SQL of the same result.

The engine's own tables are views of the driver's: a document is a text source's version with one
page, labels give page status, benchmark passages are quotes, events are proposals, conversation
turns are blocks. ``views`` and ``CTE`` define them alike for Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspark.functions import text as T
from quarryspark.operators import citations as C
from quarryspark.operators import extract, ids, ingest, lifecycle, passages, render, search, state, validate
from quarryspark.operators.evidence import missing_of, ready, select_evidence
from quarryspark.operators.schemas import ConceptSpec, schema

QUERIES: dict = {}
_INDEXES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: A concept whose phrases occur in the tables at hand.
CONCEPT = ConceptSpec("of the", ("and the",), ("in the", "to the"))
STATUS = {"view": "pending", "click": "approved", "error": "rejected", "purchase": "applied", "signup": "superseded"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


class views:
    """The derived tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    @property
    def sources(self) -> DataFrame:
        s = self.read("documents").select(F.col("source").alias("source_id")).distinct()
        return s.select("source_id", F.col("source_id").alias("display_name"), F.lit("text").alias("source_kind"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.when(F.col("source_id").isin("src6", "src13"), "2024-02-01T00:00:00Z").alias("archived_at"))

    @property
    def versions(self) -> DataFrame:
        d = self.read("documents")
        return d.select(F.col("doc_id").alias("source_version_id"), F.col("source").alias("source_id"), F.sha2("text", 256).alias("sha256"), T.byte_length(F.col("text")).alias("byte_size"), F.col("doc_id").alias("version_seq"))

    @property
    def pages(self) -> DataFrame:
        d = self.read("documents").select(F.col("doc_id").alias("page_id"), F.col("doc_id").alias("source_version_id"), F.lit(1).alias("page_number"), "text")
        l = self.read("labels").select(F.col("doc_id").alias("page_id"), "quality", "toxic")  # noqa: E741
        status = F.when(F.col("quality").isNull() | (F.col("quality") == 1) & (F.col("toxic") == 1), "native").when(F.col("quality") == 1, "reviewed").when(F.col("toxic") == 0, "ocr_unreviewed").otherwise("failed")
        return d.join(l, "page_id", "left").select("page_id", "source_version_id", "page_number", "text", status.alias("text_status"))

    @property
    def turns(self) -> DataFrame:
        return self.read("conversations").fillna("", "text")

    @property
    def citations(self) -> DataFrame:
        # fixture discovery: every passage's first place in every document
        d, b = self.read("documents").select(F.col("doc_id").alias("page_id"), "text"), self.read("benchmark").select("item_id", "text")
        return passages.found(d, b)

    @property
    def proposals(self) -> DataFrame:
        status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("event_type"))
        return self.read("events").select(F.col("event_id").alias("proposal_id"), F.col("user_id").alias("article_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), status.alias("status"))

    @property
    def index(self) -> DataFrame:
        return self.read("documents").select(F.col("doc_id").alias("article_id"), F.col("source").alias("title"), F.col("lang").alias("aliases"), F.col("text").alias("body"))

    @property
    def stored_index(self) -> search.Index:
        """The full-text index of ``index``: written once in a session and directory, then searched by every query."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _INDEXES:
            _INDEXES[key] = search.stored(search.build_index(self.index))
        return _INDEXES[key]


CTE = {
    "v_sources": "SELECT DISTINCT source AS source_id, source AS display_name, 'text' AS source_kind, CASE WHEN source IN ('src6', 'src13') THEN '2024-02-01T00:00:00Z' END AS archived_at FROM documents",
    "v_versions": "SELECT doc_id AS source_version_id, source AS source_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS byte_size, doc_id AS version_seq FROM documents",
    "v_pages": "SELECT d.doc_id AS page_id, d.doc_id AS source_version_id, 1 AS page_number, d.text, CASE WHEN l.quality IS NULL OR (l.quality = 1 AND l.toxic = 1) THEN 'native' WHEN l.quality = 1 THEN 'reviewed' WHEN l.toxic = 0 THEN 'ocr_unreviewed' ELSE 'failed' END AS text_status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "v_citations": "SELECT d.doc_id AS page_id, b.item_id, CAST(octet_length(encode(substr(d.text, 1, instr(d.text, b.text) - 1))) AS BIGINT) AS start_char, CAST(octet_length(encode(substr(d.text, 1, instr(d.text, b.text) - 1))) + octet_length(encode(b.text)) AS BIGINT) AS end_char, b.text AS quote FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0",
    "v_bad": "SELECT CASE WHEN (page_id + item_id) % 4 = 0 THEN -1 - page_id ELSE page_id END AS page_id, page_id AS cited_by, item_id, start_char, CASE WHEN (page_id + item_id) % 4 = 1 THEN end_char + 10000000 ELSE end_char END AS end_char, CASE WHEN (page_id + item_id) % 4 = 2 THEN quote || ' altered' ELSE quote END AS quote FROM v_citations",
    "v_proposals": "SELECT event_id AS proposal_id, user_id AS article_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STATUS.items()) + " END AS status FROM events",
}
SQUEEZE = r"trim(regexp_replace({0}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
MATCH = "trim(translate(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"


def with_views(sql: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names) + " " + sql


def _evidence_sql(where: str = "") -> str:
    def has(col: str, p: str) -> str:
        return f"contains(' ' || {col} || ' ', ' {p} ')"

    phrases = [(CONCEPT.title, "title"), *((a, "alias") for a in CONCEPT.aliases), *((k, "keyword") for k in CONCEPT.keywords)]
    score = " + ".join(f"CASE WHEN {has('sort_name', p)} THEN {CONCEPT.weights[k][0]} ELSE 0 END + CASE WHEN {has('t', p)} THEN {CONCEPT.weights[k][1]} ELSE 0 END" for p, k in phrases)
    return with_views(
        f"""SELECT CAST(score AS INTEGER) AS score, sort_name, source_id, source_version_id, page_number, page_id FROM (
  SELECT *, {score} AS score FROM (
    SELECT {MATCH.format('s.display_name')} AS sort_name, {MATCH.format('p.text')} AS t, s.source_id, p.source_version_id, p.page_number, p.page_id
    FROM v_pages p JOIN v_versions v ON v.source_version_id = p.source_version_id JOIN v_sources s ON s.source_id = v.source_id
    WHERE s.archived_at IS NULL AND p.text_status IN ('native', 'reviewed') AND p.text <> '' {where}))
WHERE score > 0""",
        "v_sources", "v_versions", "v_pages",
    )


def _evidence(spark, sf_dir, only=None) -> DataFrame:
    v = views(spark, sf_dir)
    # each document is a source of its own here, so that more than one page per source can be evidence
    versions = v.versions.select(F.concat_ws(":", "source_id", "source_version_id").alias("source_id"), "source_version_id", "version_seq")
    sources = v.versions.select("source_id", "source_version_id").join(v.sources, "source_id").select(F.concat_ws(":", "source_id", "source_version_id").alias("source_id"), "display_name", "source_kind", "archived_at")
    if only:
        sources = sources.where(F.col("display_name").isin(only))
    out = select_evidence(sources, versions, v.pages, CONCEPT)
    return out.select("score", "sort_name", F.substring_index("source_id", ":", 1).alias("source_id"), "source_version_id", "page_number", "page_id")


@query(_evidence_sql())
def evidence_select(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query(_evidence_sql("AND s.source_id IN ('src1', 'src2', 'src3')"))
def evidence_filtered_sources(spark, sf_dir):
    return _evidence(spark, sf_dir, ["src1", "src2", "src3"])


@query(_evidence_sql("AND v.version_seq = (SELECT max(version_seq) FROM v_versions w WHERE w.source_id = v.source_id)"))
def evidence_latest_only(spark, sf_dir):
    v = views(spark, sf_dir)
    return select_evidence(v.sources, v.versions, v.pages, CONCEPT).select("score", "sort_name", "source_id", "source_version_id", "page_number", "page_id")


@query(with_views("SELECT w AS source_id FROM (VALUES ('src1'), ('src6'), ('nowhere')) t(w) WHERE w NOT IN (SELECT source_id FROM v_sources WHERE archived_at IS NULL)", "v_sources"))
def missing_sources_anti(spark, sf_dir):
    wanted = spark.sql("SELECT * FROM VALUES ('src1'), ('src6'), ('nowhere') AS t(source_id)")
    return missing_of(views(spark, sf_dir).sources, wanted)


_LATEST = with_views("SELECT source_id, source_version_id, sha256, byte_size FROM v_versions v WHERE version_seq = (SELECT max(version_seq) FROM v_versions w WHERE w.source_id = v.source_id)", "v_versions")


@query(_LATEST)
def latest_version(spark, sf_dir):
    return ingest.latest_versions(views(spark, sf_dir).versions).select("source_id", "source_version_id", "sha256", "byte_size")


@query(_LATEST)
def latest_version_correlated(spark, sf_dir):
    return spark.sql("SELECT source_id, source_version_id, sha256, byte_size FROM {v} v WHERE version_seq = (SELECT max(version_seq) FROM {v} w WHERE w.source_id = v.source_id)", v=views(spark, sf_dir).versions)


def _files(v: views) -> DataFrame:
    """Documents as files of two kinds; several share a name."""
    name = F.concat(F.lit("in/"), F.col("source"), F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".md"))
    return v.read("documents").select(name.alias("path"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("seq"))


def _imported(v: views) -> tuple[state.Tables, DataFrame]:
    """Even documents are imported first, then the odd ones; the tables after both, and the results of both."""
    made = lambda prefix, key: F.concat(F.lit(prefix), F.sha2(key, 256))
    tables = {n: v.spark.createDataFrame([], schema(n)) for n in ("sources", "source_versions")}
    out = None
    for batch in (0, 1):
        tables, found = ingest.ingest(tables, _files(v).where(F.col("seq") % 2 == batch), f"2024-0{batch + 1}-01T00:00:00Z", made)
        out = found if out is None else out.unionByName(found)
    return tables, out


_FILES = "f AS (SELECT doc_id AS seq, source || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.md' END AS name, CASE WHEN doc_id % 3 = 0 THEN 'text' ELSE 'markdown' END AS kind, sha256(text) AS sha256, doc_id % 2 AS batch FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY batch, seq) = 1 AS created, first(name || chr(0) || kind) OVER (PARTITION BY sha256 ORDER BY batch, seq) AS owner FROM f)"


@query(f"WITH {_FILES} SELECT seq, sha256, created, 'src_' || sha256(owner) AS source_id, 'ver_' || sha256(sha256) AS source_version_id FROM o")
def dedup_assignment(spark, sf_dir):
    return _imported(views(spark, sf_dir))[1].select("seq", "sha256", "created", "source_id", "source_version_id")


@query(f"WITH {_FILES} SELECT sha256, min(seq) FILTER (WHERE created) AS first_seq, count(*) AS copies FROM o GROUP BY sha256")
def dedup_by_hash(spark, sf_dir):
    return _imported(views(spark, sf_dir))[1].groupBy("sha256").agg(F.min(F.when(F.col("created"), F.col("seq"))).alias("first_seq"), F.count(F.lit(1)).alias("copies"))


@query(f"WITH {_FILES}, base AS (SELECT max(seq) + 1 AS base FROM o WHERE batch = 0 AND created) SELECT 'ver_' || sha256(sha256) AS source_version_id, 'src_' || sha256(owner) AS source_id, name AS original_filename, CASE WHEN batch = 0 THEN seq + 1 ELSE base + 1 + seq END AS version_seq, CASE WHEN batch = 0 THEN '2024-01-01T00:00:00Z' ELSE '2024-02-01T00:00:00Z' END AS imported_at FROM o, base WHERE created")
def imported_versions(spark, sf_dir):
    return _imported(views(spark, sf_dir))[0]["source_versions"].select("source_version_id", "source_id", "original_filename", "version_seq", "imported_at")


@query(f"WITH {_FILES} SELECT 'src_' || sha256(owner) AS source_id, split_part(owner, chr(0), 1) AS display_name, split_part(owner, chr(0), 2) AS source_kind, min(CASE WHEN batch = 0 THEN '2024-01-01T00:00:00Z' ELSE '2024-02-01T00:00:00Z' END) AS created_at FROM o WHERE created GROUP BY ALL")
def imported_sources(spark, sf_dir):
    return _imported(views(spark, sf_dir))[0]["sources"].select("source_id", "display_name", "source_kind", "created_at")


@query("SELECT source_kind, media_type, count(*) AS files FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'markdown' WHEN 2 THEN 'markdown' WHEN 3 THEN 'text' END AS source_kind, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/markdown' WHEN 3 THEN 'text/plain' END AS media_type FROM documents) GROUP BY ALL")
def format_detect(spark, sf_dir):
    d = views(spark, sf_dir).read("documents")
    ext = F.element_at(F.array(*(F.lit(x) for x in (".PDF", ".md", ".Markdown", ".txt", ".rtf"))), (F.col("doc_id") % 5 + 1).cast("int"))
    kind = T.file_kind(F.concat(F.lit("in/"), F.col("source"), F.lit(".v1/"), F.col("doc_id").cast("string"), ext))
    return d.groupBy(kind.alias("source_kind"), T.media_type(kind).alias("media_type")).agg(F.count(F.lit(1)).alias("files"))


_USABLE = r"(octet_length(encode(regexp_replace(native_text, '[ \t\n\x0B\f\r]+', '', 'g'))) >= 4 AND octet_length(encode(regexp_replace(native_text, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', '', 'g'))) >= 2)"
_OCR = r"(ocr_ok AND regexp_matches(ocr_text, '[^ \t\n\x0B\f\r]'))"


_WHOLE = r"(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '[^ \t\n\x0B\f\r]', '.', 'g') WHEN 2 THEN regexp_replace(text, '[^ \t\n\x0B\f\r]', ' ', 'g') ELSE '' END AS native_text, doc_id % 8 < 6 AS ocr_ok, CASE WHEN doc_id % 8 = 1 THEN regexp_replace(text, '[^ \t\n\x0B\f\r]', ' ', 'g') ELSE text END AS ocr_text FROM documents)"


@query(f"SELECT doc_id, CASE WHEN {_USABLE} THEN 'native' WHEN {_OCR} THEN 'ocr_unreviewed' ELSE 'failed' END AS text_status, sha256(CASE WHEN {_USABLE} THEN native_text WHEN {_OCR} THEN ocr_text ELSE '' END) AS text_sha256 FROM {_WHOLE}")
def extraction_cascade(spark, sf_dir):
    """Over whole texts, blanked ones where a text must be of no use."""
    k = F.col("doc_id")
    blanked = lambda by: F.regexp_replace("text", r"[^ \t\n\x0B\f\r]", by)
    native = F.when(k % 4 == 0, F.col("text")).when(k % 4 == 1, blanked(".")).when(k % 4 == 2, blanked(" ")).otherwise("")
    ocr = F.when(k % 8 == 1, blanked(" ")).otherwise(F.col("text"))
    pages = views(spark, sf_dir).read("documents").select("doc_id", native.alias("native_text"), (k % 8 < 6).alias("ocr_ok"), ocr.alias("ocr_text"))
    return extract.cascade(pages).select("doc_id", "text_status", "text_sha256")


@query(f"SELECT doc_id, {_USABLE.replace('native_text', 'text')} AS usable, regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]') AS visible FROM documents")
def usable_native_text(spark, sf_dir):
    return views(spark, sf_dir).read("documents").select("doc_id", T.usable_native(F.col("text")).alias("usable"), T.visible(F.col("text")).alias("visible"))


@query(with_views("SELECT v.source_id, count(*) AS pages, count(*) FILTER (WHERE text_status = 'failed') AS failed_pages, CASE WHEN count(*) FILTER (WHERE text_status = 'failed') > 0 THEN 'failed' ELSE 'completed' END AS status FROM v_pages p JOIN v_versions v USING (source_version_id) GROUP BY 1", "v_pages", "v_versions"))
def extraction_status_counts(spark, sf_dir):
    v = views(spark, sf_dir)
    pages = v.pages.join(v.versions.select("source_version_id", "source_id"), "source_version_id").select(F.col("source_id").alias("source_version_id"), "text_status")
    return extract.run_status(pages).withColumnRenamed("source_version_id", "source_id")


@query("""SELECT coalesce(o.page_id, 'new' || n.doc_id) AS page_id, coalesce(o.v, n.v) AS source_version_id, coalesce(o.p, n.p) AS page_number, coalesce(n.h, o.h) AS text_sha256 FROM
 (SELECT 'old' || doc_id AS page_id, doc_id // 10 AS v, CAST(doc_id % 10 AS INTEGER) AS p, sha256(text) AS h FROM documents WHERE doc_id % 10 < 7) o FULL JOIN
 (SELECT doc_id, doc_id // 10 AS v, CAST(doc_id % 10 AS INTEGER) AS p, sha256(lang || text) AS h FROM documents WHERE doc_id % 10 > 3) n ON o.v = n.v AND o.p = n.p""")
def page_upsert(spark, sf_dir):
    d = views(spark, sf_dir).read("documents")
    k = F.col("doc_id")

    def pages(rows, text):
        return rows.select(F.concat(F.lit("old"), k.cast("string")).alias("page_id"), F.floor(k / 10).alias("source_version_id"), (k % 10).cast("int").alias("page_number"), F.lit(None).cast("string").alias("image_path"), text.alias("text"), F.lit("native").alias("text_status"), F.sha2(text, 256).alias("text_sha256"))

    old, new = pages(d.where(k % 10 < 7), F.col("text")), pages(d.where(k % 10 > 3), F.concat("lang", "text"))
    made = F.concat(F.lit("new"), (F.col("source_version_id") * 10 + F.col("page_number")).cast("string"))
    return extract.upsert_pages(old, new, made).select("page_id", "source_version_id", "page_number", "text_sha256")


@query(with_views("SELECT page_id, text_status FROM v_pages WHERE page_id IN (SELECT page_id FROM v_citations)", "v_pages", "v_citations"))
def cited_page_guard(spark, sf_dir):
    v = views(spark, sf_dir)
    return extract.cited_pages(v.pages, v.citations).select("page_id", "text_status")


@query(with_views("SELECT page_id, text_status FROM v_pages WHERE page_id NOT IN (SELECT page_id FROM v_citations)", "v_pages", "v_citations"))
def uncited_pages(spark, sf_dir):
    v = views(spark, sf_dir)
    return v.pages.join(v.citations.select("page_id").distinct(), "page_id", "left_anti").select("page_id", "text_status")


@query(with_views("SELECT p.page_id, count(c.page_id) AS citations FROM v_pages p LEFT JOIN v_citations c ON c.page_id = p.page_id GROUP BY 1", "v_pages", "v_citations"))
def citation_counts(spark, sf_dir):
    v = views(spark, sf_dir)
    n = v.citations.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return v.pages.select("page_id").join(n, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("citations"))


@query(with_views("SELECT page_id, item_id, start_char, end_char FROM v_citations", "v_citations"))
def citation_spans(spark, sf_dir):
    return views(spark, sf_dir).citations.select("page_id", "item_id", "start_char", "end_char")


@query(with_views(f"SELECT c.page_id, item_id, {SQUEEZE.format('decode(encode(p.text)[c.start_char + 1 : c.end_char])')} AS canonical_quote FROM v_citations c JOIN v_pages p ON p.page_id = c.page_id", "v_citations", "v_pages"))
def citation_quotes(spark, sf_dir):
    v = views(spark, sf_dir)
    return C.checked(v.citations, v.pages).select("page_id", "item_id", "canonical_quote")


def _bad(v: views) -> DataFrame:
    k = (F.col("page_id") + F.col("item_id")) % 4
    c = v.citations
    return c.select(F.when(k == 0, -1 - F.col("page_id")).otherwise(F.col("page_id")).alias("page_id"), F.col("page_id").alias("cited_by"), "item_id", "start_char", F.when(k == 1, F.col("end_char") + 10000000).otherwise(F.col("end_char")).alias("end_char"), F.when(k == 2, F.concat("quote", F.lit(" altered"))).otherwise(F.col("quote")).alias("quote"))


@query(with_views(f"SELECT cited_by, item_id, CASE WHEN p.page_id IS NULL THEN 'page_id' WHEN start_char >= end_char OR end_char > octet_length(encode(p.text)) THEN 'offsets' WHEN {SQUEEZE.format('decode(encode(p.text)[b.start_char + 1 : b.end_char])')} <> {SQUEEZE.format('b.quote')} THEN 'quote' END AS issue FROM v_bad b LEFT JOIN v_pages p ON p.page_id = b.page_id", "v_citations", "v_bad", "v_pages"))
def citation_validate(spark, sf_dir):
    v = views(spark, sf_dir)
    return C.checked(_bad(v), v.pages).select("cited_by", "item_id", "issue")


@query(with_views("SELECT c.item_id, c.page_id, c.start_char, c.end_char, p.page_number, p.text_status, v.sha256, s.source_id, s.display_name FROM v_citations c JOIN v_pages p ON p.page_id = c.page_id JOIN v_versions v ON v.source_version_id = p.source_version_id JOIN v_sources s ON s.source_id = v.source_id", "v_citations", "v_pages", "v_versions", "v_sources"))
def citation_evidence_join(spark, sf_dir):
    v = views(spark, sf_dir)
    cites = v.citations.withColumns({"section_key": F.lit("key_ideas"), "block_index": F.col("item_id")})
    nil = F.lit(None).cast("string")
    versions = v.versions.withColumns({"original_filename": nil, "stored_path": nil, "media_type": nil})
    return C.evidence_of(cites, v.pages, versions, v.sources).select("item_id", "page_id", "start_char", "end_char", "page_number", "text_status", "sha256", "source_id", "display_name")


@query(with_views("SELECT proposal_id, page_id, start_char, end_char FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id, page_id, start_char ORDER BY emit) AS n FROM (SELECT page_id % 7 AS proposal_id, page_id, start_char, end_char - r AS end_char, item_id * 2 + r AS emit FROM v_citations, (VALUES (0), (1)) t(r))) WHERE n = 1", "v_citations"))
def citation_insert_or_ignore(spark, sf_dir):
    rows = views(spark, sf_dir).citations.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("r"))
    rows = rows.select((F.col("page_id") % 7).alias("proposal_id"), F.lit("key_ideas").alias("section_key"), F.lit(0).alias("block_index"), "page_id", "start_char", (F.col("end_char") - F.col("r")).alias("end_char"), (F.col("item_id") * 2 + F.col("r")).alias("emit"))
    return C.insert_or_ignore(rows).select("proposal_id", "page_id", "start_char", "end_char")


def _nested(v: views) -> DataFrame:
    """proposal_id, p: a conversation's turns as blocks, in sections by role; every 3rd text is a bullet."""
    t = v.turns.select(F.col("conv_id").alias("proposal_id"), "turn", "role", "text")
    cites = F.array(F.struct(F.concat(F.lit("page_"), (F.col("proposal_id") % 3).cast("string")).alias("page_id"), F.lit(0).cast("long").alias("start_char"), F.octet_length("text").cast("long").alias("end_char"), F.col("text").alias("quote")), F.struct(F.concat(F.lit("page_"), (F.col("turn") % 4).cast("string")).alias("page_id"), F.lit(0).cast("long").alias("start_char"), F.lit(1).cast("long").alias("end_char"), F.substring("text", 1, 1).alias("quote")))
    block = F.struct(F.when(F.col("turn") % 3 == 0, "bullet").otherwise("paragraph").alias("kind"), "text", cites.alias("citations"))
    sections = t.groupBy("proposal_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("bs"))
    section = F.struct(F.col("role").alias("key"), F.concat(F.lit("Part "), F.col("role")).alias("heading"), F.transform("bs", lambda x: x["b"]).alias("blocks"))
    whole = sections.groupBy("proposal_id").agg(F.array_sort(F.collect_list(section)).alias("sections"))
    related = F.array(F.struct(F.concat(F.lit("Topic "), F.col("proposal_id").cast("string")).alias("title"), F.when(F.col("proposal_id") % 2 == 0, "near it").otherwise("").alias("reason"), F.col("sections")[0]["blocks"][0]["citations"].alias("citations")))
    article = F.struct(F.lit(None).cast("string").alias("article_id"), F.concat(F.lit("Talk: "), F.col("proposal_id").cast("string")).alias("title"), F.concat(F.lit("talk-"), F.col("proposal_id").cast("string")).alias("slug"), F.array(F.concat(F.lit("talk "), F.col("proposal_id").cast("string"))).alias("aliases"))
    return whole.select("proposal_id", F.struct(F.lit(1).alias("schema_version"), F.lit("create_article").alias("operation"), article.alias("article"), "sections", related.alias("related_concepts")).alias("p"))


@query("SELECT conv_id AS proposal_id, role AS section_key, turn, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS INTEGER) AS block_index FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM conversations)")
def citation_block_index(spark, sf_dir):
    t = views(spark, sf_dir).turns
    block = F.struct(F.lit("paragraph").alias("kind"), F.lit("x").alias("text"), F.array(F.struct(F.col("turn").cast("string").alias("page_id"), F.lit(0).cast("long").alias("start_char"), F.lit(1).cast("long").alias("end_char"), F.lit("x").alias("quote"))).alias("citations"))
    sections = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct(F.col("role").alias("key"), F.lit("h").alias("heading"), F.array(block).alias("blocks")).alias("s")))).alias("ss"))
    empty = F.array().cast("array<struct<title:string,reason:string,citations:array<struct<page_id:string,start_char:long,end_char:long,quote:string>>>>")
    p = sections.select(F.col("conv_id").alias("proposal_id"), F.struct(F.transform("ss", lambda x: x["s"]).alias("sections"), empty.alias("related_concepts")).alias("p"))
    return C.flatten(p).select("proposal_id", "section_key", F.col("page_id").cast("long").alias("turn"), "block_index")


@query("SELECT conv_id AS proposal_id, CAST(count(*) AS BIGINT) AS related_index FROM conversations WHERE role = 'assistant' GROUP BY 1 UNION ALL SELECT conv_id, 0 FROM conversations GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'assistant') = 0")
def related_block_index(spark, sf_dir):
    """Where related concepts go on counting: assistant turns stand in for the related_concepts section."""
    n = _nested(views(spark, sf_dir))
    key = lambda s: F.when(s["key"] == "assistant", "related_concepts").otherwise(s["key"])
    p = n.select("proposal_id", F.struct(F.transform("p.sections", lambda s: F.struct(key(s).alias("key"), s["heading"].alias("heading"), s["blocks"].alias("blocks"))).alias("sections"), F.col("p.related_concepts").alias("related_concepts")).alias("p"))
    return C.flatten(p).where("section_key = 'related_concepts'").groupBy("proposal_id").agg(F.max("block_index").cast("long").alias("related_index"))


@query(with_views("(SELECT page_id, start_char, end_char, 'expected' AS side FROM v_citations EXCEPT SELECT page_id, start_char, end_char, 'expected' FROM v_citations WHERE item_id % 3 <> 0) UNION ALL (SELECT page_id, start_char, end_char + 1, 'stored' FROM v_citations WHERE item_id % 5 = 0)", "v_citations"))
def citation_set_equality(spark, sf_dir):
    c = views(spark, sf_dir).citations.select("item_id", "page_id", "start_char", "end_char")
    stored = c.where("item_id % 3 <> 0").unionByName(c.where("item_id % 5 = 0").withColumn("end_char", F.col("end_char") + 1))
    return C.set_difference(c, stored, ["page_id", "start_char", "end_char"])


@query("SELECT DISTINCT conv_id AS article_id, role AS section_key, CAST(turn % 3 AS INTEGER) AS block_index FROM conversations WHERE conv_id <> 1 UNION ALL SELECT DISTINCT 1, role, CAST(turn % 3 AS INTEGER) FROM conversations WHERE conv_id = 2")
def article_citations_distinct(spark, sf_dir):
    c = views(spark, sf_dir).read("conversations").select(F.col("conv_id").alias("article_id"), F.col("role").alias("section_key"), (F.col("turn") % 3).cast("int").alias("block_index"), F.lit("p").alias("page_id"))
    return C.article_rows(c.where("article_id = 2"), c.distinct(), 1).select("article_id", "section_key", "block_index")


@query(with_views("SELECT c.page_id, '[^' || c.page_id || ']: [' || replace(replace(replace(v.source_id, '\\', '\\\\'), '[', '\\['), ']', '\\]') || ', p. 1](' || replace(url_encode('_sources/' || v.source_id || ' ' || c.page_id || '.pdf'), '%2F', '/') || '#page=1)' AS line FROM (SELECT DISTINCT page_id FROM v_citations) c JOIN v_versions v ON v.source_version_id = c.page_id", "v_citations", "v_versions"))
def footnote_list(spark, sf_dir):
    v = views(spark, sf_dir)
    pages = v.citations.select("page_id").distinct().join(v.versions.select(F.col("source_version_id").alias("page_id"), "source_id"), "page_id")
    path = F.concat(F.lit("_sources/"), "source_id", F.lit(" "), F.col("page_id").cast("string"), F.lit(".pdf"))
    return pages.select("page_id", render.footnote(F.col("page_id").cast("string"), F.col("source_id"), F.lit("pdf"), F.lit(1), path).alias("line"))


@query(with_views("SELECT proposal_id, article_id, created_at, status FROM v_proposals", "v_proposals"))
def proposal_list(spark, sf_dir):
    return lifecycle.listed(views(spark, sf_dir).proposals)


@query(with_views("SELECT proposal_id, article_id, created_at, status FROM v_proposals WHERE status = 'pending'", "v_proposals"))
def proposal_list_status(spark, sf_dir):
    return lifecycle.listed(views(spark, sf_dir).proposals, "pending")


@query(with_views("SELECT proposal_id, article_id, CASE WHEN status IN ('pending', 'approved') AND proposal_id < max(CASE WHEN status IN ('pending', 'approved') THEN proposal_id END) OVER (PARTITION BY article_id) THEN 'superseded' ELSE status END AS status FROM v_proposals", "v_proposals"))
def proposal_supersede(spark, sf_dir):
    return lifecycle.supersede_older(views(spark, sf_dir).proposals, F.col("proposal_id")).select("proposal_id", "article_id", "status")


def _cas(verb: str, before: str, after: str):
    def run(spark, sf_dir):
        p = views(spark, sf_dir).proposals
        return state.compare_and_set(p, F.col("proposal_id") % 2 == 0, before, status=after).select("proposal_id", "status")

    run.__name__ = f"{verb}_cas"
    query(with_views(f"SELECT proposal_id, CASE WHEN proposal_id % 2 = 0 AND status = '{before}' THEN '{after}' ELSE status END AS status FROM v_proposals", "v_proposals"))(run)


_cas("approve", "pending", "approved")
_cas("reject", "pending", "rejected")
_cas("apply", "approved", "applied")


@query("SELECT p.p_partkey, p.p_name FROM part p JOIN (SELECT DISTINCT translate(upper(p_name), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS wanted FROM part) w ON translate(p.p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = w.wanted")
def title_nocase_lookup(spark, sf_dir):
    p = views(spark, sf_dir).read("part")
    wanted = p.select(T.ascii_lower(F.upper("p_name")).alias("wanted")).distinct()
    return p.join(wanted, T.ascii_lower(F.col("p_name")) == F.col("wanted")).select("p_partkey", "p_name")


@query("SELECT doc_id, regexp_matches(source || CASE WHEN doc_id % 3 = 0 THEN '-' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'Up' ELSE 'low' END, '^[a-z0-9]+(-[a-z0-9]+)*$') AS slug_ok, doc_id % 4 = 0 AS id_ok FROM documents")
def slug_ulid_checks(spark, sf_dir):
    k = F.col("doc_id")
    slug = F.concat("source", F.when(k % 3 == 0, "-").otherwise(""), F.when(k % 2 == 0, "Up").otherwise("low"))
    made = ids.derived("page_", k.cast("string"))
    value = F.when(k % 4 == 0, made).when(k % 4 == 1, F.concat(made, F.lit("0"))).when(k % 4 == 2, F.regexp_replace(made, ".$", "U")).otherwise(F.regexp_replace(made, "^page_", "src_"))
    return views(spark, sf_dir).read("documents").select("doc_id", T.is_slug(slug).alias("slug_ok"), T.is_id(value, "page_").alias("id_ok"))


_PATHS = "(SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '://[^/]*(/[^?#]*)', 1) WHEN 1 THEN substr(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), 2) WHEN 2 THEN 'a/../' || page_id ELSE '..b/c d+e~f*' || page_id END AS path FROM pages)"


def _paths(v: views) -> DataFrame:
    k, own = F.col("page_id"), F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1)
    path = F.when(k % 4 == 0, own).when(k % 4 == 1, F.substr(own, F.lit(2))).when(k % 4 == 2, F.concat(F.lit("a/../"), k.cast("string"))).otherwise(F.concat(F.lit("..b/c d+e~f*"), k.cast("string")))
    return v.read("pages").select("page_id", path.alias("path"))


@query(f"SELECT page_id, path <> '' AND NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..') AS safe FROM {_PATHS}")
def safe_paths(spark, sf_dir):
    return _paths(views(spark, sf_dir)).select("page_id", T.safe_relative(F.col("path")).alias("safe"))


@query(f"SELECT page_id, replace(url_encode(path), '%2F', '/') AS encoded FROM {_PATHS}")
def url_encode_paths(spark, sf_dir):
    return _paths(views(spark, sf_dir)).select("page_id", T.markdown_url(F.col("path")).alias("encoded"))


@query(r"SELECT p_partkey, regexp_replace(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' [a\b]' ELSE '' END, '([\\\[\]])', '\\\1', 'g') AS label FROM part")
def markdown_escape(spark, sf_dir):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, r" [a\b]").otherwise(""))
    return views(spark, sf_dir).read("part").select("p_partkey", T.markdown_label(name).alias("label"))


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(v, '^[A-Za-z0-9 .''\-]+$') THEN v ELSE CAST(to_json(v) AS VARCHAR) END AS scalar FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ': "q" ü' ELSE '' END AS v FROM part)""")
def yaml_scalar(spark, sf_dir):
    k = F.col("p_partkey")
    v = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat("p_name", F.lit(': "q" ü'))).otherwise("")
    return views(spark, sf_dir).read("part").select("p_partkey", T.yaml_scalar(v).alias("scalar"))


@query("SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k NOT IN ('page'))), ',') AS unexpected FROM events")
def json_strict_keys(spark, sf_dir):
    return views(spark, sf_dir).read("events").select("event_id", F.array_join(validate.unexpected_keys(F.col("props"), ["page"]), ",").alias("unexpected"))


@query("""SELECT conv_id, turn, sha256('{"model":' || to_json(role) || ',"prompt_version":"v1","provider":"p","response_schema":{"a":[1,2],"type":"object"},"system_prompt":"s","user_prompt":' || to_json(text) || '}') AS request_sha256 FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM conversations)""")
def request_hash(spark, sf_dir):
    shape = F.parse_json(F.lit('{"type": "object", "a": [1, 2]}'))
    hashed = T.request_hash(provider=F.lit("p"), model=F.col("role"), prompt_version=F.lit("v1"), system_prompt=F.lit("s"), user_prompt=F.col("text"), response_schema=shape)
    return views(spark, sf_dir).turns.select("conv_id", "turn", hashed.alias("request_sha256"))


@query("""SELECT conv_id, turn, '{"redacted":true,"response_bytes":' || octet_length(encode(text)) || ',"response_sha256":"' || sha256(text) || '","validation_issue_count":' || turn || '}' AS diagnostic FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM conversations)""")
def redacted_diagnostic(spark, sf_dir):
    return views(spark, sf_dir).turns.select("conv_id", "turn", T.redacted(F.col("text"), F.col("turn")).alias("diagnostic"))


@query("""SELECT conv_id, turn, '{"role":' || to_json(role) || ',"text":' || to_json(text) || ',"turn":' || turn || '}' AS doc FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM conversations)""")
def canonical_json(spark, sf_dir):
    return views(spark, sf_dir).turns.select("conv_id", "turn", F.to_json(F.struct("role", "text", "turn")).alias("doc"))


_RENDER = """
WITH t AS (SELECT conv_id, turn, role, text, '[^page_' || (conv_id % 3) || ']' AS a, '[^page_' || (turn % 4) || ']' AS b, conv_id % 3 AS x, turn % 4 AS y FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM conversations)),
s AS (SELECT conv_id, role, '## Part ' || role || chr(10) || chr(10) || string_agg(CASE WHEN turn % 3 = 0 THEN '- ' ELSE '' END || text || ' ' || a || CASE WHEN x <> y THEN ' ' || b ELSE '' END || chr(10) || chr(10), '' ORDER BY turn) AS body FROM t GROUP BY conv_id, role),
w AS (SELECT conv_id, string_agg(body, '' ORDER BY role) AS body FROM s GROUP BY 1),
f AS (SELECT conv_id, arg_min(' ' || a || CASE WHEN x <> y THEN ' ' || b ELSE '' END, (role, turn)) AS refs FROM t GROUP BY 1),
c AS (SELECT conv_id, string_agg('[^' || p || ']: [Notes](_sources/n.md)' || chr(10), '' ORDER BY p) AS notes FROM (SELECT conv_id, 'page_' || x AS p FROM t UNION SELECT conv_id, 'page_' || y FROM t) GROUP BY 1)
SELECT w.conv_id AS proposal_id, sha256('---' || chr(10) || 'schema: 1' || chr(10) || 'article_id: a' || w.conv_id || chr(10) || 'title: "Talk: ' || w.conv_id || '"' || chr(10) || 'aliases:' || chr(10) || '  - talk ' || w.conv_id || chr(10) || 'tags:' || chr(10) || '  - probability' || chr(10) || '---' || chr(10) || chr(10) || '# Talk: ' || w.conv_id || chr(10) || chr(10) || '<!-- a -->' || chr(10) || chr(10) ||
  rtrim(w.body || '## Related concepts' || chr(10) || chr(10) || '- [[Topic ' || w.conv_id || ']]' || CASE WHEN w.conv_id % 2 = 0 THEN ' — near it' ELSE '' END || f.refs || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || c.notes, chr(10)) || chr(10) || chr(10) || '<!-- b -->' || chr(10)) AS article_sha256
FROM w JOIN f USING (conv_id) JOIN c USING (conv_id)"""


@query(_RENDER)
def render_article(spark, sf_dir):
    n = _nested(views(spark, sf_dir))
    notes = F.transform(render.cited(F.col("p")), lambda i: render.footnote(i, F.lit("Notes"), F.lit("markdown"), F.lit(1), F.lit("_sources/n.md")))
    content = render.managed(F.col("p"), notes)
    whole = render.new_article(F.col("p"), F.concat(F.lit("a"), F.col("proposal_id").cast("string")), "<!-- a -->", "<!-- b -->", content)
    return n.select("proposal_id", F.sha2(whole, 256).alias("article_sha256"))


_OLD = "(SELECT doc_id, lang, text || CASE doc_id % 4 WHEN 0 THEN '<a>old<b>' WHEN 1 THEN '<a><b>' WHEN 2 THEN '<b>x<a>' ELSE '<a>1<b>2<a>' END || source AS old FROM documents)"


@query(f"""SELECT doc_id, CASE WHEN length(old) - length(replace(old, '<a>', '')) = 3 AND length(old) - length(replace(old, '<b>', '')) = 3 AND instr(old, '<a>') < instr(old, '<b>')
  THEN sha256(substr(old, 1, instr(old, '<a>') + 2) || chr(10) || chr(10) || lang || chr(10) || chr(10) || substr(old, instr(old, '<b>'))) END AS replaced_sha256 FROM {_OLD}""")
def managed_replace(spark, sf_dir):
    """Markers once and in order, without content, in the wrong order, and twice."""
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, "<a>old<b>").when(k == 1, "<a><b>").when(k == 2, "<b>x<a>").otherwise("<a>1<b>2<a>")
    old = F.concat("text", tail, "source")
    return views(spark, sf_dir).read("documents").select("doc_id", F.sha2(T.replace_region(old, "<a>", "<b>", F.col("lang")), 256).alias("replaced_sha256"))


def _search_sql(terms: list[str], limit: int) -> str:
    tok = "list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    parts = " UNION ALL ".join(f"SELECT doc_id, unnest({tok.format(c)}) AS term, {w} AS w FROM documents" for c, w in (("source", 10.0), ("lang", 5.0), ("text", 1.0)))
    names = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH o AS ({parts}),
dl AS (SELECT doc_id, count(*) AS dl FROM o GROUP BY 1), n AS (SELECT (SELECT count(*) FROM documents) AS N, (SELECT sum(dl) FROM dl)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl),
f AS (SELECT doc_id, term, sum(w)::DOUBLE AS f FROM o WHERE term IN ({names}) GROUP BY ALL), df AS (SELECT term, count(*) AS n_t FROM f GROUP BY 1),
s AS (SELECT f.doc_id, count(*) AS k, -sum(CASE WHEN ln((N - n_t + 0.5) / (n_t + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - n_t + 0.5) / (n_t + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS r FROM f JOIN df USING (term) JOIN dl USING (doc_id), n GROUP BY 1)
SELECT s.doc_id AS article_id, d.source AS title, round(r, 6) AS relevance FROM s JOIN documents d USING (doc_id) WHERE k = {len(terms)} ORDER BY r, lower(d.source), s.doc_id LIMIT {limit}"""


def _search(name: str, text: str, terms: list[str], limit: int) -> None:
    def run(spark, sf_dir):
        v = views(spark, sf_dir)
        out = search.search(v.index, text, limit, index=v.stored_index)
        return out.select("article_id", "title", F.round("relevance", 6).alias("relevance"))

    run.__name__ = name
    query(_search_sql(terms, limit))(run)


_search("search_bm25_and", "that with", ["that", "with"], 100)
_search("search_weighted", "src3 the", ["src3", "the"], 20)
_search("search_topk", "für", ["fur"], 10)
_search("search_literal_or", "en OR* \"the\"", ["en", "or", "the"], 50)


@query("SELECT 'source_versions' AS \"table\", 'unique(sha256)' AS rule, count(*) AS violations FROM (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0")
def state_constraints(spark, sf_dir):
    v = views(spark, sf_dir)
    return state.constraint_violations({"sources": v.sources, "source_versions": v.versions, "source_pages": v.pages})


@query(with_views("SELECT text_status, count(*) AS pages FROM v_pages GROUP BY 1", "v_pages"))
def page_status_counts(spark, sf_dir):
    return views(spark, sf_dir).pages.groupBy("text_status").agg(F.count(F.lit(1)).alias("pages"))


@query(with_views("SELECT page_id, text_status IN ('native', 'reviewed') AND text <> '' AS ready FROM v_pages", "v_pages"))
def readiness_gate(spark, sf_dir):
    return views(spark, sf_dir).pages.select("page_id", ready(F.col("text_status"), F.col("text")).alias("ready"))


@query("SELECT doc_id, lpad(CAST(doc_id % 20000 AS VARCHAR), CAST(greatest(4, length(CAST(doc_id % 20000 AS VARCHAR))) AS INTEGER), '0') AS label, CASE WHEN doc_id % 2 = 0 AND doc_id > 0 THEN CAST(doc_id AS VARCHAR) END AS png FROM documents")
def page_labels(spark, sf_dir):
    k = F.col("doc_id")
    name = F.concat(F.when(k % 2 == 0, "page-").otherwise("pages-"), k.cast("string"), F.lit(".png"))
    return views(spark, sf_dir).read("documents").select("doc_id", T.page_label(k % 20000).alias("label"), T.png_page(name).cast("string").alias("png"))


_NUMBERED = """(SELECT conv_id AS proposal_id, turn, text, dense_rank() OVER (PARTITION BY conv_id ORDER BY role) - 1 AS i, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS j
  FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM conversations))"""


@query(f"""SELECT proposal_id, loc || CASE WHEN page = 3 THEN '/page_id' WHEN page = 0 OR text = '' THEN '' ELSE '/quote' END AS path,
  CASE WHEN page = 3 THEN 'page_id' WHEN page = 0 OR text = '' THEN 'offsets' ELSE 'quote' END || ' page_' || page || ' 0..' || CASE k WHEN 0 THEN octet_length(encode(text)) ELSE 1 END AS message
FROM (SELECT proposal_id, '/sections/' || i || '/blocks/' || j || '/citations/' || k AS loc, CASE k WHEN 0 THEN proposal_id % 3 ELSE turn % 4 END AS page, text, k FROM {_NUMBERED}, (VALUES (0), (1)) t(k)
  UNION ALL SELECT proposal_id, '/related_concepts/0/citations/' || k, CASE k WHEN 0 THEN proposal_id % 3 ELSE turn % 4 END, text, k FROM {_NUMBERED}, (VALUES (0), (1)) t(k) WHERE i = 0 AND j = 0)""")
def proposal_issues(spark, sf_dir):
    """Citations against pages 0 (empty), 1 and 2 (blank, and long enough for any offsets); page 3 is not there."""
    n = _nested(views(spark, sf_dir))
    pages = spark.range(3).select(F.concat(F.lit("page_"), F.col("id").cast("string")).alias("page_id"), F.when(F.col("id") == 0, "").otherwise(F.repeat(F.lit(" "), F.lit(1 << 20))).alias("text"))
    return validate.citation_issues(n, pages)
