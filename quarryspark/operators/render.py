"""Markdown from nested proposals: higher-order functions over arrays, no rows are exploded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryspark.functions.text import markdown_label, markdown_url, yaml_scalar


def references(citations: Column) -> Column:
    """`` [^page]`` for each distinct page, in order of first use."""
    return F.array_join(F.transform(F.array_distinct(F.transform(citations, lambda c: c["page_id"])), lambda p: F.concat(F.lit(" [^"), p, F.lit("]"))), "")


def cited(p: Column) -> Column:
    """All cited page ids, sorted."""
    blocks = F.flatten(F.transform(p["sections"], lambda s: s["blocks"]))
    ids = lambda xs: F.flatten(F.transform(xs, lambda b: F.transform(b["citations"], lambda c: c["page_id"])))
    return F.array_sort(F.array_distinct(F.concat(ids(blocks), ids(p["related_concepts"]))))


def footnote(page_id: Column, name: Column, kind: Column, number: Column, path: Column) -> Column:
    pdf, n = kind == "pdf", number.cast("string")
    label = F.concat(markdown_label(name), F.when(pdf, F.concat(F.lit(", p. "), n)).otherwise(""))
    target = F.concat(markdown_url(path), F.when(pdf, F.concat(F.lit("#page="), n)).otherwise(""))
    return F.concat(F.lit("[^"), page_id, F.lit("]: ["), label, F.lit("]("), target, F.lit(")"))


def _related(p: Column) -> Column:
    def one(r: Column) -> Column:
        return F.concat(F.lit("- [["), r["title"], F.lit("]]"), F.when(r["reason"] != "", F.concat(F.lit(" — "), r["reason"])).otherwise(""), references(r["citations"]), F.lit("\n"))

    return F.array_join(F.transform(p["related_concepts"], one), "")


def managed(p: Column, footnotes: Column) -> Column:
    """The generated region. footnotes: the lines of ``footnote`` in page order."""
    related = _related(p)
    some = F.size(p["related_concepts"]) > 0

    def block(b: Column) -> Column:
        return F.concat(F.when(b["kind"] == "bullet", "- ").otherwise(""), b["text"], references(b["citations"]), F.lit("\n\n"))

    def section(s: Column) -> Column:
        body = F.array_join(F.transform(s["blocks"], block), "")
        tail = F.when((s["key"] == "related_concepts") & some, F.concat(related, F.lit("\n"))).otherwise("")
        return F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), body, tail)

    has = F.exists(p["sections"], lambda s: s["key"] == "related_concepts")
    appended = F.when(has, "").otherwise(F.concat(F.lit("## Related concepts\n\n"), related, F.lit("\n")))
    whole = F.concat(F.array_join(F.transform(p["sections"], section), ""), appended, F.lit("## Sources\n\n"), F.array_join(F.transform(footnotes, lambda f: F.concat(f, F.lit("\n"))), ""))
    return F.rtrim(whole, F.lit("\n"))


def new_article(p: Column, article_id: Column, start: str, end: str, content: Column, tag: str = "probability", schema_key: str = "schema") -> Column:
    """Front matter, heading and the marked region."""
    aliases = F.array_join(F.transform(p["article"]["aliases"], lambda a: F.concat(F.lit("  - "), yaml_scalar(a), F.lit("\n"))), "")
    return F.concat(
        F.lit(f"---\n{schema_key}: 1\narticle_id: "), article_id, F.lit("\ntitle: "), yaml_scalar(p["article"]["title"]), F.lit("\naliases:\n"), aliases,
        F.lit(f"tags:\n  - {tag}\n---\n\n# "), p["article"]["title"], F.lit(f"\n\n{start}\n\n"), content, F.lit(f"\n\n{end}\n"),
    )
