"""Evidence for a table of concepts at once, by a dictionary of word n-grams.

Phrases are cut into grams of at most GRAM words: a longer phrase is several grams, the last one aligned with its end. Texts
are exploded into grams of the dictionary's widths only and met with it by equality, so the work for a text does not grow
with the number of phrases, and no text leaves its task. A phrase occurs where all of its grams do, each at its place.

Edge cases: phrases and texts without letters or digits (null, empty) match nothing; a phrase that a concept names twice counts
twice; concepts without phrases, and pages without a score, have no row; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.functions.text import match_text
from quarryspark.operators.evidence import ready
from quarryspark.operators.ingest import latest_versions
from quarryspark.operators.schemas import ConceptSpec
from quarryspark.operators.scratch import kept

#: Words of a gram, at most.
GRAM = 3


def phrases_of(concepts: DataFrame, weights: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """concept_id, phrase (normalised), in_name and in_text of (concept_id, title, aliases, keywords).

    weights: what a phrase of each kind counts in a source's name and in a page's text.
    """
    weights = weights or ConceptSpec().weights

    def listed_as(phrases: Column, kind: str) -> Column:
        in_name, in_text = (F.lit(w) for w in weights[kind])
        known = F.coalesce(phrases, F.array().cast("array<string>"))
        return F.transform(known, lambda p: F.struct(p.alias("p"), in_name.alias("a"), in_text.alias("b")))

    listed = F.concat(listed_as(F.array("title"), "title"), listed_as(F.col("aliases"), "alias"), listed_as(F.col("keywords"), "keyword"))
    each = concepts.select("concept_id", F.explode(listed).alias("x")).select("concept_id", match_text(F.col("x.p")).alias("phrase"), "x.a", "x.b")
    return each.where("phrase <> ''").groupBy("concept_id", "phrase").agg(F.sum("a").cast("int").alias("in_name"), F.sum("b").cast("int").alias("in_text"))


def grams_of(phrases: DataFrame) -> DataFrame:
    """phrase, parts, offset and gram: the pieces that a phrase is found by."""
    words, n = F.split("phrase", " "), F.size(F.split("phrase", " "))
    last = F.greatest(n - GRAM, F.lit(0))
    offsets = F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), n - 1, F.lit(GRAM)), lambda i: i <= last), F.array(last)))
    each = phrases.select("phrase").distinct().select("phrase", words.alias("words"), F.size(offsets).alias("parts"), F.explode(offsets).alias("offset"))
    return each.select("phrase", "parts", "offset", F.array_join(F.slice("words", F.col("offset") + 1, F.lit(GRAM)), " ").alias("gram"))


def matches(texts: DataFrame, key: str, phrases: DataFrame) -> DataFrame:
    """(key, phrase) of the phrases that occur, as whole words, in (key, matched); both normalised."""
    parts = F.split("gram", " ")
    hashed = F.xxhash64(*(F.get(parts, F.lit(k)) for k in range(GRAM)))  # a null changes no hash
    # written, so that its size is known where it is joined
    pieces = kept(grams_of(phrases).select("phrase", "parts", "offset", hashed.alias("gram"), F.size(parts).alias("width")), "dictionary")
    # the widths are at most GRAM numbers
    widths = [r[0] for r in pieces.select("width").distinct().collect()]
    words = F.split("matched", " ")
    own = texts.where("matched <> ''").select(key, F.explode(F.array(words)).alias("words"))  # split once
    at = lambda w: F.transform(
        F.when(F.size("words") >= w, F.sequence(F.lit(0), F.size("words") - w)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("at"), F.xxhash64(*(F.get("words", i + k) for k in range(w))).alias("gram")),
    )
    if not widths:
        return texts.select(key, F.lit("").alias("phrase")).limit(0)
    exploded = own.select(key, F.explode(F.concat(*(at(w) for w in sorted(widths)))).alias("g")).select(key, "g.at", "g.gram")
    # of a phrase in one piece any place will do, so a text's repeats of it are one row before they are shuffled
    start = F.when(F.col("parts") > 1, F.col("at") - F.col("offset"))
    found = exploded.join(pieces.drop("width"), "gram").groupBy(key, "phrase", "parts", start.alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return found.where("parts = 1 OR n = parts").select(key, "phrase").distinct()


def select_for_all(sources: DataFrame, versions: DataFrame, pages: DataFrame, phrases: DataFrame) -> DataFrame:
    """concept_id, score and page (no text) of the ready pages that say anything of a concept: evidence for each concept.

    phrases: of phrases_of(). The rows of a concept are those of select_evidence for it, in its order when sorted by
    concept_id, score descending, sort_name, source_id, page_number and page_id.
    """
    latest = latest_versions(versions).select("source_id", "source_version_id")
    dim = sources.where("archived_at IS NULL").select("source_id", "display_name", "source_kind", match_text(F.col("display_name")).alias("sort_name")).join(latest, "source_id")
    fit = pages.where(ready(F.col("text_status"), F.col("text")))
    names = matches(dim.select("source_version_id", F.col("sort_name").alias("matched")), "source_version_id", phrases)
    by_name = names.join(phrases, "phrase").groupBy("concept_id", "source_version_id").agg(F.sum("in_name").alias("score"))
    by_name = by_name.join(fit.select("page_id", "source_version_id"), "source_version_id").select("concept_id", "page_id", "score")
    texts = matches(fit.select("page_id", match_text(F.col("text")).alias("matched")), "page_id", phrases)
    by_text = texts.join(phrases, "phrase").select("concept_id", "page_id", F.col("in_text").cast("long").alias("score"))
    scored = by_name.unionByName(by_text).groupBy("concept_id", "page_id").agg(F.sum("score").cast("int").alias("score")).where("score > 0")
    placed = fit.select("page_id", "source_version_id", "page_number", "text_status").join(dim, "source_version_id")
    return scored.join(placed, "page_id").select("concept_id", "score", "sort_name", "source_id", "display_name", "source_kind", "source_version_id", "page_number", "page_id", "text_status")
