"""Strict JSON contracts and semantic rules of proposals, as rows of issues.

Structure: unknown or missing keys, wrong kinds and unknown enum values, at every level, by the
first problem in document order. Semantics: all problems, with JSON-pointer paths.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryspark.functions.text import is_id, is_slug, safe_relative
from quarryspark.operators.citations import BELOW, checked
from quarryspark.operators.schemas import BLOCK_KINDS, OPERATIONS, PROPOSAL, SECTION_KEYS, EngineError

#: Messages of the contract that callers match on.
ONE = "must equal 1"
EMPTY = "must not be empty"
SLUG_SHAPE = "must be a lowercase kebab-case slug"
ARTICLE_ID = "must be an art_ ULID"
PAGE_ID = "must be a pg_ ULID"
VERSION_ID = "must be a ver_ ULID"
UNIQUE = "must contain unique values"
SECTION = "must contain at least one section"
CITATION_NEEDED = "must contain at least one citation"
AFTER_START = "must be greater than start_char"
FROM_1 = "must be at least 1"
RELATIVE = "must be project-relative"

#: Statuses of text that may be evidence.
READY = ("native", "reviewed")

_CITATION = {"page_id": str, "start_char": int, "end_char": int, "quote": str}
#: Object shapes: key -> kind; "?" marks an optional key; a list holds its items' kind; a tuple the allowed strings.
SHAPES = {
    "citation": _CITATION,
    "proposal": {
        "schema_version": int,
        "operation": OPERATIONS,
        "article": {"article_id?": str, "title": str, "slug": str, "aliases?": [str]},
        "sections": [{"key": SECTION_KEYS, "heading": str, "blocks": [{"kind": BLOCK_KINDS, "text": str, "citations": [_CITATION]}]}],
        "related_concepts": [{"title": str, "reason": str, "citations": [_CITATION]}],
    },
    "page": {"page_id": str, "source_version_id": str, "page_number": int, "image_path?": str, "text": str, "text_status": ("native", "ocr_unreviewed", "reviewed", "failed"), "language?": str},
    "config": {
        "schema_version": int,
        "project_id": str,
        "paths": {"sources": str, "vault": str, "state": str, "cache": str},
        "vault": {"source_directory": str, "generated_section_id": str},
        "providers": {"llm": {"default": str, "ollama": {"base_url": str, "model": str, "timeout_seconds": int}}, "ocr": {"default": str, "language": str}},
    },
}


def structure_issue(value, shape, path: str = "") -> tuple[str, str] | None:
    """(path, message) of the first structural problem of a parsed JSON value."""
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            return path, "must be an object"
        names = {k.rstrip("?"): k for k in shape}
        for k in names:
            if k not in value and not names[k].endswith("?"):
                return f"{path}/{k}", "is required"
        for k in sorted(value):
            if k not in names:
                return f"{path}/{k}", "is not allowed"
        return next((found for k in names if k in value and (found := structure_issue(value[k], shape[names[k]], f"{path}/{k}"))), None)
    if isinstance(shape, list):
        if not isinstance(value, list):
            return path, "must be an array"
        return next((found for i, v in enumerate(value) if (found := structure_issue(v, shape[0], f"{path}/{i}"))), None)
    if isinstance(shape, tuple):
        return None if isinstance(value, str) and value in shape else (path, "is not a known value")
    if shape is int:
        return None if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else (path, "must be a non-negative integer")
    return None if isinstance(value, shape) else (path, "must be a string")


def parse_strict(text: str, kind: str) -> dict:
    """The parsed document, or EngineError('invalid_response') with ``path: message``."""
    try:
        value = json.loads(text)
    except ValueError:
        raise EngineError("invalid_response", "/: must be valid JSON") from None
    if found := structure_issue(value, SHAPES[kind]):
        raise EngineError("invalid_response", f"{found[0] or '/'}: {found[1]}")
    return value


def _first_issue(value: Column, shape, path: Column) -> Column:
    """structure_issue() of a VARIANT as an expression: a struct (path, message), null when sound."""

    def told(bad: Column, at: Column, message: str) -> Column:
        return F.when(bad, F.struct(at.alias("path"), F.lit(message).alias("message")))

    is_kind = lambda pattern: F.coalesce(F.schema_of_variant(value).rlike(pattern), F.lit(False))
    if isinstance(shape, dict):
        keys = F.map_keys(value.try_cast("map<string,variant>"))
        names = {k.rstrip("?"): k for k in shape}
        listed = lambda ks: F.array(*(F.lit(k) for k in ks)).cast("array<string>")
        missing = F.get(F.array_except(listed(n for n, k in names.items() if n == k), keys), F.lit(0))
        unknown = F.get(F.array_sort(F.array_except(keys, listed(names))), F.lit(0))
        below = lambda k: F.concat(path, F.lit("/"), k)
        inner = (F.when(F.array_contains(keys, n), _first_issue(F.try_variant_get(value, f"$.{n}", "variant"), shape[k], below(F.lit(n)))) for n, k in names.items())
        return F.coalesce(told(keys.isNull(), path, "must be an object"), told(missing.isNotNull(), below(missing), "is required"), told(unknown.isNotNull(), below(unknown), "is not allowed"), *inner)
    if isinstance(shape, list):
        items = value.try_cast("array<variant>")
        found = F.filter(F.transform(items, lambda v, i: _first_issue(v, shape[0], F.concat(path, F.lit("/"), i.cast("string")))), lambda x: x.isNotNull())
        return F.coalesce(told(items.isNull(), path, "must be an array"), F.get(found, F.lit(0)))
    text = F.when(is_kind("^STRING$"), value.try_cast("string"))
    if isinstance(shape, tuple):
        return told(~F.coalesce(text.isin(*shape), F.lit(False)), path, "is not a known value")
    if shape is int:
        whole = F.when(is_kind(r"^(BIGINT|DECIMAL\(\d+,0\))$"), value.try_cast("decimal(38,0)"))
        return told(~F.coalesce(whole >= 0, F.lit(False)), path, "must be a non-negative integer")
    return told(text.isNull(), path, "must be a string")


def strict_structure(df: DataFrame, column: str, kind: str | dict = "proposal") -> DataFrame:
    """Adds ``structure_path`` and ``structure_message`` (null when sound) by VARIANT expressions. kind: of SHAPES, or a shape.

    Of keys that an object repeats the last one counts.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # the parser stops behind the first value: one that is the first of two, the other being the text's hash, is all of it
    own = F.concat(F.lit('"'), F.md5(F.col(column)), F.lit('"'))
    two = F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit(","), own, F.lit("]"))).try_cast("array<variant>")
    # the generator keeps the planner from parsing the text anew for every rule
    once = df.withColumn("_two", F.explode(F.array(two))).withColumn("_v", F.when((F.size("_two") == 2) & (F.get("_two", F.lit(1)).try_cast("string") == F.md5(F.col(column))), F.get("_two", F.lit(0))))
    broken = F.struct(F.lit("").alias("path"), F.lit("must be valid JSON").alias("message"))
    told = once.withColumn("_s", F.when(F.col("_v").isNull(), broken).otherwise(_first_issue(F.col("_v"), SHAPES[kind] if isinstance(kind, str) else kind, F.lit(""))))
    return told.withColumns({"structure_path": F.col("_s.path"), "structure_message": F.col("_s.message")}).drop("_s", "_v", "_two")


def unexpected_keys(text: Column, allowed: list[str]) -> Column:
    """Top-level keys of a JSON object outside of the allowed ones, sorted; null when it is no object."""
    keys = F.json_object_keys(text)
    return F.array_sort(F.array_except(keys, F.array(*(F.lit(a) for a in allowed))))


def parsed(df: DataFrame, column: str = "payload_json") -> DataFrame:
    return df.withColumn("p", F.from_json(F.col(column), PROPOSAL))


def _issues(df: DataFrame, *rules: tuple[Column, Column, str]) -> DataFrame:
    """One row (proposal_id, path, message) per rule that holds."""
    found = F.array_compact(F.array(*(F.when(bad, F.struct(path.alias("path"), F.lit(message).alias("message"))) for bad, path, message in rules)))
    return df.select("proposal_id", F.explode(found).alias("i")).select("proposal_id", "i.*")


def _at(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def semantic_issues(proposals: DataFrame) -> DataFrame:
    """proposal_id, path, message of (proposal_id, p)."""
    a = F.col("p.article")
    top = _issues(
        proposals,
        (F.col("p.schema_version") != 1, F.lit("/schema_version"), ONE),
        (a["title"] == "", F.lit("/article/title"), EMPTY),
        (~is_slug(a["slug"]), F.lit("/article/slug"), SLUG_SHAPE),
        (a["article_id"].isNotNull() & ~is_id(a["article_id"], "art_"), F.lit("/article/article_id"), ARTICLE_ID),
        (F.size(F.array_distinct(a["aliases"])) != F.size(a["aliases"]), F.lit("/article/aliases"), UNIQUE),
        (F.size("p.sections") == 0, F.lit("/sections"), SECTION),
    )
    s = proposals.select("proposal_id", F.posexplode("p.sections").alias("i", "s"))
    b = s.select("proposal_id", "i", F.posexplode("s.blocks").alias("j", "b")).withColumn("at", _at("/sections/", F.col("i"), "/blocks/", F.col("j")))
    blocks = _issues(b, (F.col("b.text") == "", _at(F.col("at"), "/text"), EMPTY), (F.size("b.citations") == 0, _at(F.col("at"), "/citations"), CITATION_NEEDED))
    r = proposals.select("proposal_id", F.posexplode("p.related_concepts").alias("i", "r")).withColumn("at", _at("/related_concepts/", F.col("i")))
    related = _issues(r, (F.size("r.citations") == 0, _at(F.col("at"), "/citations"), CITATION_NEEDED))
    c = located_citations(proposals)
    cites = _issues(
        c,
        (~is_id(F.col("page_id"), "pg_"), _at(F.col("at"), "/page_id"), PAGE_ID),
        (F.col("start_char") >= F.col("end_char"), _at(F.col("at"), "/end_char"), AFTER_START),
        (F.col("quote") == "", _at(F.col("at"), "/quote"), EMPTY),
    )
    return top.unionByName(blocks).unionByName(related).unionByName(cites)


def located_citations(proposals: DataFrame) -> DataFrame:
    """proposal_id, at (JSON pointer), page_id, start_char, end_char, quote."""
    s = proposals.select("proposal_id", F.posexplode("p.sections").alias("i", "s"))
    b = s.select("proposal_id", "i", F.posexplode("s.blocks").alias("j", "b")).select("proposal_id", _at("/sections/", F.col("i"), "/blocks/", F.col("j")).alias("up"), F.col("b.citations").alias("cs"))
    r = proposals.select("proposal_id", F.posexplode("p.related_concepts").alias("i", "r")).select("proposal_id", _at("/related_concepts/", F.col("i")).alias("up"), F.col("r.citations").alias("cs"))
    return b.unionByName(r).select("proposal_id", "up", F.posexplode("cs").alias("k", "c")).select("proposal_id", _at(F.col("up"), "/citations/", F.col("k")).alias("at"), "c.*")


def citation_issues(proposals: DataFrame, pages: DataFrame) -> DataFrame:
    """At most one issue per citation against the pages given to the model."""
    c = checked(located_citations(proposals), pages).where("issue IS NOT NULL")
    below = F.create_map(*(F.lit(x) for kv in BELOW.items() for x in kv))[F.col("issue")]
    return c.select("proposal_id", _at(F.col("at"), below).alias("path"), _at(F.col("issue"), " ", F.col("page_id"), " ", F.col("start_char"), "..", F.col("end_char")).alias("message"))


def response_issues(proposals: DataFrame, pages: DataFrame, target: Column | None = None) -> DataFrame:
    """Semantic issues, citation issues and, with a target struct (operation, title, slug, article_id), what differs from it."""
    out = semantic_issues(proposals).unionByName(citation_issues(proposals, pages))
    if target is None:
        return out
    places = {"operation": "", "title": "/article", "slug": "/article", "article_id": "/article"}
    own = lambda name, up: F.col("p." + ".".join([*up.split("/")[1:], name]))
    told = lambda name, up: F.struct(F.lit(f"{up}/{name}").alias("path"), _at("asked for ", F.coalesce(target[name], F.lit("none"))).alias("message"))
    found = F.array_compact(F.array(*(F.when(~own(name, up).eqNullSafe(target[name]), told(name, up)) for name, up in places.items())))
    return out.unionByName(proposals.select("proposal_id", F.explode(found).alias("i")).select("proposal_id", "i.*"))


def formatted(issues: DataFrame, key: str = "proposal_id") -> DataFrame:
    """key and ``issues``: all of a key's issues as ``path: message``, in order, between semicolons."""
    line = F.concat("path", F.lit(": "), "message")
    return issues.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("issues"))


def stored_issue(df: DataFrame) -> DataFrame:
    """Adds ``issue`` to (payload_json, operation): why a stored payload can't be used, null if it can."""
    checked_rows = strict_structure(df, "payload_json")
    other = F.get_json_object("payload_json", "$.operation") != F.col("operation")
    return checked_rows.withColumn("issue", F.when(F.col("structure_message").isNotNull(), F.concat(F.lit("damaged: "), F.col("structure_path"), F.lit(": "), F.col("structure_message"))).when(other, "names another operation"))


def page_issues(pages: DataFrame) -> DataFrame:
    """page_id, path, message of (page_id, source_version_id, page_number, image_path, language), where columns are there."""
    rules = [
        (~is_id(F.col("page_id"), "pg_"), "/page_id", PAGE_ID),
        (~is_id(F.col("source_version_id"), "ver_"), "/source_version_id", VERSION_ID),
        (F.col("page_number") < 1, "/page_number", FROM_1),
    ]
    if "image_path" in pages.columns:
        rules.append((F.col("image_path").isNotNull() & ~safe_relative(F.col("image_path")), "/image_path", RELATIVE))
    if "language" in pages.columns:
        rules.append((F.coalesce("language", F.lit("")) == "", "/language", EMPTY))
    found = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"))) for bad, path, message in rules)))
    return pages.select(*([c for c in ("index", "request_id") if c in pages.columns]), "page_id", F.explode(found).alias("i")).select("*", "i.path", "i.message").drop("i")


def request_issues(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """request_id, path, message of requests (request_id, operation, article_id) and the pages (request_id, index, ...) sent with them.

    A message is what was found: how many pages, which article for which operation, a status, where a page came first.
    """
    one = lambda path, *message: F.struct(path.alias("path"), _at(*message).alias("message"))
    r = requests.join(pages.groupBy("request_id").agg(F.count(F.lit(1)).alias("pages")), "request_id", "left")
    article = F.col("article_id")
    # an update names its article, and only an update does
    unfit = article.isNull() == (F.col("operation") == "update_article")
    tops = F.array(
        F.when(F.col("pages").isNull(), one(F.lit("/pages"), "pages 0")),
        F.when(unfit, one(F.lit("/article_id"), F.col("operation"), " of ", F.coalesce(article, F.lit("no article")))),
        F.when(article.isNotNull() & ~is_id(article, "art_"), one(F.lit("/article_id"), ARTICLE_ID)),
    )
    first = F.min("index").over(Window.partitionBy("request_id", "page_id"))
    sent = pages.select("request_id", "index", "text_status", first.alias("first"))
    at = lambda below: F.concat(F.lit("/pages/"), F.col("index").cast("string"), below)
    each = F.array(
        F.when(~F.col("text_status").isin(*READY), one(at(F.lit("/text_status")), "text_status ", F.col("text_status"))),
        F.when(F.col("index") > F.col("first"), one(at(F.lit("/page_id")), "page of index ", F.col("first"))),
    )
    rows = lambda df, found: df.select("request_id", F.explode(F.array_compact(found)).alias("i")).select("request_id", "i.*")
    own = page_issues(pages).select("request_id", at(F.col("path")).alias("path"), "message")
    return rows(r, tops).unionByName(own).unionByName(rows(sent, each))


def unrenderable(proposals: DataFrame, start: str, end: str, reserved: str) -> DataFrame:
    """proposal_id, message: what may not be written to an article, and where. Needs payload_json and p.

    That is a marker anywhere, and names that are empty, break the line or, of related concepts, would end their link.
    """
    names = {"sections": ("heading", r"^$|[\n\r]"), "related_concepts": ("title", r"^$|[\n\r]|\[\[|\]\]")}
    found = [F.when(F.col("payload_json").contains(m), F.lit(f"marker {m}")) for m in (reserved, start, end)]
    for group, (name, unfit) in names.items():
        spots = F.filter(F.transform(f"p.{group}", lambda x, i: F.when(x[name].rlike(unfit), i)), lambda i: i.isNotNull())  # noqa: B023
        found.append(F.when(F.size(spots) > 0, _at(f"{name} /{group}/", F.get(spots, F.lit(0)), f"/{name}")))
    return proposals.select("proposal_id", F.coalesce(*found).alias("message")).where("message IS NOT NULL")
