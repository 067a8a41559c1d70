"""Schemas, value sets, keys and references of the state tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import StructType

#: Tables, columns, keys and references of the state.
TABLES: dict[str, str] = {
    "schema_migrations": "version int, applied_at string",
    "sources": "source_id string, display_name string, source_kind string, created_at string, archived_at string",
    "source_versions": "source_version_id string, source_id string, sha256 string, original_filename string, stored_path string, media_type string, byte_size long, imported_at string, version_seq long",
    "source_pages": "page_id string, source_version_id string, page_number int, image_path string, text string, text_status string, text_sha256 string",
    "extraction_runs": "run_id string, source_version_id string, extractor_name string, extractor_version string, ocr_provider string, status string, started_at string, completed_at string, error_message string",
    "articles": "article_id string, title string, slug string, vault_path string, content_sha256 string, created_at string, updated_at string",
    "model_runs": "run_id string, provider string, model string, prompt_version string, request_sha256 string, response_json string, status string, started_at string, completed_at string, error_message string",
    "proposals": "proposal_id string, article_id string, model_run_id string, operation string, payload_json string, status string, created_at string, reviewed_at string, applied_at string, review_reason string",
    "proposal_citations": "proposal_id string, section_key string, block_index int, page_id string, start_char long, end_char long, quote string",
    "article_citations": "article_id string, section_key string, block_index int, page_id string",
    "apply_runs": "apply_run_id string, proposal_id string, article_id string, previous_content_sha256 string, new_content_sha256 string, backup_path string, applied_at string",
    "article_index": "article_id string, title string, aliases string, body string",
    "article_postings": "term string, block long, article_id string, dl long, f double, places array<int>",
}

#: The enumerations of the state tables and of proposals.
KINDS = ("pdf", "markdown", "text")
TEXT_STATUS = ("native", "ocr_unreviewed", "reviewed", "failed")
RUN_STATUS = ("running", "completed", "failed")
MODEL_STATUS = ("completed", "invalid_response", "failed")
OPERATIONS = ("create_article", "update_article")
PROPOSAL_STATUS = ("pending", "approved", "rejected", "applied", "superseded")
SECTION_KEYS = ("working_explanation", "key_ideas", "example", "related_concepts")
BLOCK_KINDS = ("paragraph", "bullet")

UNIQUE: dict[str, list[tuple[str, ...]]] = {
    "schema_migrations": [("version",)],
    "sources": [("source_id",)],
    "source_versions": [("source_version_id",), ("sha256",)],
    "source_pages": [("page_id",), ("source_version_id", "page_number")],
    "extraction_runs": [("run_id",)],
    "articles": [("article_id",), ("lower title",), ("slug",), ("vault_path",)],
    "model_runs": [("run_id",)],
    "proposals": [("proposal_id",)],
    "proposal_citations": [("proposal_id", "section_key", "block_index", "page_id", "start_char")],
    "article_citations": [("article_id", "section_key", "block_index", "page_id")],
    "apply_runs": [("apply_run_id",), ("proposal_id",)],
}

REFERENCES: list[tuple[str, str, str]] = [
    ("source_versions", "source_id", "sources"),
    ("source_pages", "source_version_id", "source_versions"),
    ("extraction_runs", "source_version_id", "source_versions"),
    ("proposals", "article_id", "articles"),
    ("proposals", "model_run_id", "model_runs"),
    ("proposal_citations", "proposal_id", "proposals"),
    ("proposal_citations", "page_id", "source_pages"),
    ("article_citations", "article_id", "articles"),
    ("article_citations", "page_id", "source_pages"),
    ("apply_runs", "proposal_id", "proposals"),
    ("apply_runs", "article_id", "articles"),
]

CHECKS: dict[str, list[str]] = {
    "sources": [f"source_kind IN {KINDS}"],
    "source_versions": ["byte_size >= 0"],
    "source_pages": ["page_number >= 1", f"text_status IN {TEXT_STATUS}"],
    "extraction_runs": [f"status IN {RUN_STATUS}"],
    "model_runs": [f"status IN {MODEL_STATUS}"],
    "proposals": [f"operation IN {OPERATIONS}", f"status IN {PROPOSAL_STATUS}"],
    "proposal_citations": ["end_char > start_char"],
}

CITATION = "struct<page_id:string,start_char:long,end_char:long,quote:string>"
PROPOSAL = (
    "struct<schema_version:int,operation:string,article:struct<article_id:string,title:string,slug:string,aliases:array<string>>,"
    f"sections:array<struct<key:string,heading:string,blocks:array<struct<kind:string,text:string,citations:array<{CITATION}>>>>>,"
    f"related_concepts:array<struct<title:string,reason:string,citations:array<{CITATION}>>>>"
)


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


@dataclass(frozen=True)
class ConceptSpec:
    """What evidence is selected for, and how presence in a source's name and in a page's text is weighed."""

    title: str = "Markov Chains"
    aliases: tuple[str, ...] = ("Markov chain",)
    #: Fixed values.
    keywords: tuple[str, ...] = (
        "markov property", "transition probability", "transition probabilities", "transition matrix",
        "state transition", "stochastic matrix", "memoryless", "memorylessness",
    )
    weights: dict[str, tuple[int, int]] = field(default_factory=lambda: {"title": (1000, 800), "alias": (600, 400), "keyword": (40, 20)})


class EngineError(Exception):
    """kind: invalid_argument, not_found, invalid_state, conflict, unsupported_format, no_evidence, invalid_response,
    external_failure, filesystem_error, state_error or invalid_query."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind
