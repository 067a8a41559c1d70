"""Command line over ``Project``: ``python -m quarryspark [--project DIR] [--json] [--quiet] VERB ...``."""

from __future__ import annotations

import argparse
import json
import sys

from quarryspark.operators.schemas import ConceptSpec, EngineError

#: Exit codes by error kind; 6 is anything unexpected.
EXIT = {
    "invalid_argument": 2, "invalid_query": 2, "unsupported_format": 2,
    "not_found": 3, "invalid_state": 3, "conflict": 3, "no_evidence": 3,
    "external_failure": 4,
    "invalid_response": 5,
    "filesystem_error": 6, "state_error": 6,
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarryspark")
    top.add_argument("--project", default=".")
    top.add_argument("--json", action="store_true")
    top.add_argument("--quiet", action="store_true")
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("init").add_argument("--vault")
    verbs.add_parser("import").add_argument("files", nargs="+")
    v = verbs.add_parser("extract")
    v.add_argument("source_id")
    v.add_argument("--force", action="store_true")
    v = verbs.add_parser("compile")
    v.add_argument("--concept", required=True)
    v.add_argument("--source", action="append", default=[])
    v = verbs.add_parser("review").add_subparsers(dest="what", required=True).add_parser("extraction")
    v.add_argument("source_id")
    v.add_argument("--page", type=int)
    text = v.add_mutually_exclusive_group()
    text.add_argument("--text")
    text.add_argument("--text-file")
    whats = verbs.add_parser("proposal").add_subparsers(dest="what", required=True)
    whats.add_parser("list").add_argument("--status")
    for name in ("show", "approve", "reject"):
        v = whats.add_parser(name)
        v.add_argument("proposal_id")
        if name == "reject":
            v.add_argument("--reason")
    v = verbs.add_parser("apply")
    v.add_argument("proposal_id")
    v.add_argument("--allow-overwrite-user-file", action="store_true")
    v = verbs.add_parser("search")
    v.add_argument("query")
    v.add_argument("--limit", type=int, default=20)
    return top


def run(args, spark, **adapters):
    """The verb's result as plain values. adapters: pdf, ocr, model, now, config_name, marker of ``Project``."""
    from quarryspark.project import Project, find_root
    from quarryspark.sources.adapters import HttpModel, LocalRunner, PopplerPdf, TesseractOcr

    rows = lambda df: [r.asDict(True) for r in df.collect()]
    if args.verb == "init":
        return {"root": Project.init(spark, args.project, args.vault, **adapters).root}
    project = Project(spark, find_root(args.project), **adapters)
    providers = project.config["providers"]
    project.pdf = project.pdf or PopplerPdf(LocalRunner())
    project.ocr = project.ocr or TesseractOcr(LocalRunner(), providers["ocr"]["language"])
    match args.verb, getattr(args, "what", None):
        case "import", _:
            return project.import_files(args.files)
        case "extract", _:
            return project.extract(args.source_id, args.force)
        case "compile", _:
            o = providers["llm"]["ollama"]
            project.model = project.model or HttpModel(o["base_url"], o["model"], o["timeout_seconds"])
            default = ConceptSpec()
            if args.concept.lower() not in (default.title.lower(), *(a.lower() for a in default.aliases)):
                raise EngineError("invalid_argument", f"unknown concept: {args.concept}")
            return project.compile(default, args.source)
        case "review", _:
            text = args.text
            if args.text_file is not None:
                with open(args.text_file, encoding="utf-8") as f:
                    text = f.read()
            if text is not None:
                if args.page is None:
                    raise EngineError("invalid_argument", "a correction needs --page")
                project.correct_page_text(args.source_id, args.page, text)
            return rows(project.review_extraction(args.source_id, args.page))
        case "proposal", "list":
            return rows(project.proposals(args.status).drop("payload_json"))
        case "proposal", "show":
            return project.show(args.proposal_id)
        case "proposal", "approve":
            return project.approve(args.proposal_id)
        case "proposal", "reject":
            return project.reject(args.proposal_id, args.reason)
        case "apply", _:
            return project.apply(args.proposal_id, args.allow_overwrite_user_file)
    return rows(project.search(args.query, args.limit))


def command(args, spark, **adapters) -> tuple[int, dict]:
    """(exit code, the JSON document of the command)."""
    name = " ".join(filter(None, (args.verb, getattr(args, "what", None))))
    try:
        return 0, {"ok": True, "command": name, "result": run(args, spark, **adapters)}
    except EngineError as e:
        return EXIT.get(e.kind, 6), {"ok": False, "command": name, "error": {"kind": e.kind, "message": str(e)}}
    except OSError as e:
        return 6, {"ok": False, "command": name, "error": {"kind": "filesystem_error", "message": type(e).__name__}}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("quarryspark").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", str(not args.quiet).lower())
    code, document = command(args, builder.getOrCreate())
    if args.json:
        print(json.dumps(document, ensure_ascii=False, default=str))
    elif code:
        print(document["error"]["message"], file=sys.stderr)
    else:
        found = document["result"]
        for line in found if isinstance(found, list) else [found or "done"]:
            print("\t".join(f"{k}={v}" for k, v in line.items()) if isinstance(line, dict) else line)
    return code


if __name__ == "__main__":
    sys.exit(main())
