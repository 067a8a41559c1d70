"""Project configuration: strict JSON in, atomic JSON out."""

from __future__ import annotations

import json
import re

from quarryspark.functions.text import ULID
from quarryspark.operators.schemas import EngineError
from quarryspark.operators.validate import EMPTY, RELATIVE, parse_strict
from quarryspark.sources.files import write_atomic

#: Keys and defaults of a project's configuration.
DEFAULT = {
    "schema_version": 1,
    "project_id": "project",
    "paths": {"sources": "sources", "vault": "vault", "state": "state", "cache": "cache"},
    "vault": {"source_directory": "_sources", "generated_section_id": "main"},
    "providers": {"llm": {"default": "ollama", "ollama": {"base_url": "http://127.0.0.1:11434", "model": "default", "timeout_seconds": 300}}, "ocr": {"default": "tesseract", "language": "eng"}},
}


def problems(config: dict) -> list[str]:
    """JSON pointer and issue of every value that can't be used, in the order of the file's groups."""
    llm = config["providers"]["llm"]
    unsafe = lambda p: not p or p.startswith("/") or ".." in p.split("/")
    rules = [("/schema_version", config["schema_version"] != 1, "must equal 1"), ("/project_id", not re.fullmatch(f"prj_{ULID}", config["project_id"]), "must be a prj_ ULID")]
    rules += [(f"/paths/{k}", unsafe(p), RELATIVE) for k, p in config["paths"].items()]
    rules += [("/vault/source_directory", unsafe(config["vault"]["source_directory"]), RELATIVE), ("/vault/generated_section_id", not config["vault"]["generated_section_id"], EMPTY)]
    rules += [("/providers/llm/default", not llm["default"], EMPTY), *((f"/providers/llm/ollama/{k}", not llm["ollama"][k], EMPTY) for k in ("base_url", "model"))]
    rules += [("/providers/llm/ollama/timeout_seconds", llm["ollama"]["timeout_seconds"] < 1, "must be positive"), *((f"/providers/ocr/{k}", not config["providers"]["ocr"][k], EMPTY) for k in ("default", "language"))]
    return [f"{path}: {issue}" for path, bad, issue in rules if bad]


def read(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            config = parse_strict(f.read(), "config")
    except FileNotFoundError:
        raise EngineError("not_found", "no project configuration") from None
    if found := problems(config):
        raise EngineError("invalid_argument", found[0])
    return config


def write(path: str, config: dict) -> None:
    write_atomic(path, (json.dumps(config, indent=2, sort_keys=True) + "\n").encode())
