"""Text, path and Markdown expressions. All are pure Column functions that stay in the JVM.

Character classes are spelled out in ASCII: white space is space, tab, newline, vertical tab,
form feed and carriage return, and only A-Z and a-z have case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\x0B\f\r]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Crockford's base 32 and the slug shape.
ULID = "[0-9A-HJKMNP-TV-Z]{26}"
SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def match_text(text: Column) -> Column:
    """Lower-case ASCII letters and digits; every other run is one space, none at the ends."""
    return F.trim(ascii_lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def has_phrase(matched: Column, phrase: str) -> Column:
    """Whole-word containment of an already normalised phrase."""
    return F.concat(F.lit(" "), matched, F.lit(" ")).contains(f" {phrase} ") if phrase else F.lit(False)


def squeeze(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def visible(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))


def usable_native(text: Column) -> Column:
    """At least 4 visible bytes, of which 2 are letters, digits or part of a non-ASCII character."""
    seen = F.octet_length(F.regexp_replace(text, f"{WS}+", ""))
    solid = F.octet_length(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ""))
    return F.coalesce((seen >= 4) & (solid >= 2), F.lit(False))


def byte_span(text: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of the UTF-8 text, as text."""
    return F.substring(text.cast("binary"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def is_id(value: Column, prefix: str) -> Column:
    return F.coalesce(value.rlike(f"^{prefix}{ULID}$"), F.lit(False))


def is_slug(value: Column) -> Column:
    return F.coalesce(value.rlike(SLUG), F.lit(False))


def safe_relative(path: Column) -> Column:
    """Not empty, not absolute, without a parent step."""
    return F.coalesce((path != "") & ~path.startswith("/") & ~F.exists(F.split(path, "/"), lambda p: p == ".."), F.lit(False))


def is_file_name(title: Column) -> Column:
    """Fit to name a file: not empty, no dots only, no separator, line break or NUL."""
    return F.coalesce((title != "") & ~title.isin(".", "..") & ~title.rlike(r"[/\\\n\r\x00]"), F.lit(False))


def has_line_break(text: Column) -> Column:
    return text.rlike(r"[\n\r]")


def page_label(number: Column) -> Column:
    return F.format_string("%04d", number.cast("long"))


def png_page(name: Column) -> Column:
    """Page number of ``page-<n>.png``, null for other names or numbers out of 1 .. 2^32-1."""
    n = F.nullif(F.regexp_extract(name, r"^page-([0-9]{1,12})\.png$", 1), F.lit("")).cast("long")
    return F.when(n.between(1, 4294967295), n)


def file_kind(path: Column) -> Column:
    """pdf, markdown or text by extension, null when unsupported."""
    ext = ascii_lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(ext == ".pdf", "pdf").when(ext.isin(".md", ".markdown"), "markdown").when(ext == ".txt", "text")


def media_type(kind: Column) -> Column:
    return F.when(kind == "pdf", "application/pdf").when(kind == "markdown", "text/markdown").when(kind == "text", "text/plain")


def vault_filename(source: Column, version: Column, name: Column, kind: Column) -> Column:
    """<source>-<version><extension>, with the kind's own extension when the name has none."""
    ext = F.regexp_extract(name, r"[^/](\.[^./]*)$", 1)
    default = F.when(kind == "pdf", ".pdf").when(kind == "markdown", ".md").otherwise(".txt")
    return F.concat(source, F.lit("-"), version, F.when(ext == "", default).otherwise(ext))


def markdown_label(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\]])", r"\\$1")


def markdown_url(path: Column) -> Column:
    """Percent-encoding of all bytes but letters, digits and / _ . ~ -."""
    out = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def json_text(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def yaml_scalar(text: Column) -> Column:
    return F.when(text.rlike(r"^[A-Za-z0-9 .'\-]+$"), text).otherwise(json_text(text))


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def replace_region(text: Column, start: str, end: str, content: Column) -> Column:
    """What stands between the only two markers, in order, becomes ``content`` between blank lines; else null."""
    a, b = F.instr(text, start), F.instr(text, end)
    fine = (occurrences(text, start) == 1) & (occurrences(text, end) == 1) & (a < b)
    return F.when(fine, F.concat(text.substr(F.lit(1), a + len(start) - 1), F.lit("\n\n"), content, F.lit("\n\n"), text.substr(b, F.length(text))))


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def redacted(response: Column, issues: Column) -> Column:
    """What is kept of an invalid model response; keys in alphabetical order."""
    return F.to_json(F.struct(F.lit(True).alias("redacted"), F.octet_length(response).alias("response_bytes"), F.sha2(response, 256).alias("response_sha256"), issues.alias("validation_issue_count")))


def request_hash(**parts: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts)))), 256)
