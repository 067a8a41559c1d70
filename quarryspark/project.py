"""A project folder and its verbs: init, import, extract, review, compile, proposals, apply, search.

The verbs hold no relational logic of their own: they read the snapshot store, apply the
operators, and commit. What they bring to the driver is one source's pages, one proposal or one
request's evidence. File effects come before the commit and are undone when it fails.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import stat
import tempfile
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspark.functions import text as T
from quarryspark.operators import citations, extract, ids, ingest, lifecycle, migrations, prompt, render, validate
from quarryspark.operators import search as full_text
from quarryspark.operators.evidence import select_evidence
from quarryspark.operators.schemas import PROPOSAL_STATUS, ConceptSpec, EngineError, schema
from quarryspark.operators.state import StateStore, append, compare_and_set, overlay, replace_rows
from quarryspark.sources import config as configs
from quarryspark.sources import files
from quarryspark.sources.adapters import LanguageModel, OcrProvider, PdfAdapter, ocr_cascade_input

CONFIG = "project.json"
MAX_REASON_BYTES = 4096


def utc_now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def find_root(start: str, name: str = CONFIG) -> str:
    """The nearest folder at or above ``start`` that holds a project."""
    at = os.path.abspath(start)
    while not os.path.exists(os.path.join(at, name)):
        up = os.path.dirname(at)
        if up == at:
            raise EngineError("not_found", "no project here or above")
        at = up
    return at


class Project:
    def __init__(self, spark: SparkSession, root: str, pdf: PdfAdapter | None = None, ocr: OcrProvider | None = None, model: LanguageModel | None = None, now: Callable[[], str] = utc_now, config_name: str = CONFIG, marker: str = "managed"):
        self.spark, self.root, self.now = spark, os.path.abspath(root), now
        self.pdf, self.ocr, self.model = pdf, ocr, model
        self.config_path, self.marker = os.path.join(self.root, config_name), marker

    # -- plumbing

    @classmethod
    def init(cls, spark: SparkSession, root: str, vault: str | None = None, **options) -> Project:
        """Create configuration and empty state; what exists already stays as it is."""
        project = cls(spark, root, **options)
        if not os.path.exists(project.config_path):
            config = json.loads(json.dumps(configs.DEFAULT)) | {"project_id": ids.new("prj_")}
            if vault is not None:
                config["paths"]["vault"] = vault
            if found := configs.problems(config):
                raise EngineError("invalid_argument", found[0])
            configs.write(project.config_path, config)
        for name in ("sources", "vault", "cache"):
            os.makedirs(project._path(name), exist_ok=True)
        project.store.initialize()
        return project

    @property
    def config(self) -> dict:
        return configs.read(self.config_path)

    @property
    def store(self) -> StateStore:
        return StateStore(self.spark, self._path("state"))

    def _path(self, name: str, *more: str) -> str:
        return os.path.join(self.root, self.config["paths"][name], *more)

    def _rows(self, table: str, *rows: dict) -> DataFrame:
        kind = schema(table)
        return self.spark.createDataFrame([tuple(r.get(c) for c in kind.names) for r in rows], kind)

    def _markers(self) -> tuple[str, str, str]:
        """Start and end of the generated region, and what no proposal may hold."""
        section, reserved = self.config["vault"]["generated_section_id"], f"<!-- {self.marker}:"
        return f"{reserved}start {section} -->", f"{reserved}end {section} -->", reserved

    def _latest(self, source_id: str) -> dict:
        t = self.store.tables()
        active = t["sources"].where((F.col("source_id") == source_id) & F.col("archived_at").isNull()).select("source_id", "display_name", "source_kind")
        found = ingest.latest_versions(t["source_versions"].where(F.col("source_id") == source_id)).join(active, "source_id").first()
        if found is None:
            raise EngineError("not_found", f"source is missing or archived: {source_id}")
        return found.asDict()

    def _pages(self, version: str) -> DataFrame:
        return extract.pages_of(self.store.table("source_pages"), version)

    @staticmethod
    def _refuse_cited(tables, pages: DataFrame) -> None:
        cited = extract.cited_pages(pages, tables["proposal_citations"]).agg(F.min("page_number")).first()[0]
        if cited is not None:
            raise EngineError("conflict", f"page {cited} is cited and may not change")

    # -- sources

    def import_files(self, paths: list[str]) -> list[dict]:
        """One result per path, in order. Files before one that can't be taken are imported, then its error is raised."""
        wanted, error = [], None
        for p in map(os.path.abspath, paths):
            if not os.path.isfile(p):
                error = EngineError("not_found", f"no such file: {os.path.basename(p)}")
            elif not p.lower().endswith((".pdf", ".md", ".markdown", ".txt")):
                error = EngineError("unsupported_format", f"unsupported file: {os.path.basename(p)}")
            if error:
                break
            wanted.append(p)
        out = self._import(wanted) if wanted else []
        if error:
            raise error
        return out

    def _import(self, paths: list[str]) -> list[dict]:
        seed, made = ids.new(""), []
        try:
            with self.store.transaction() as tables:
                scanned = files.scan(self.spark, list(dict.fromkeys(paths)))
                new, result = ingest.ingest(tables, scanned, self.now(), lambda prefix, key: ids.derived(prefix, key, seed))
                where = new["source_versions"].select("source_version_id", "stored_path")
                rows = {r["path"]: r.asDict() for r in result.join(where, "source_version_id").collect()}
                for p, r in rows.items():
                    target = os.path.join(self.root, r["stored_path"])
                    if files.retain(p, r["sha256"], target):
                        made.append(target)
                if any(r["created"] for r in rows.values()):
                    tables |= new
        except BaseException:
            for target in made:
                os.chmod(target, stat.S_IREAD | stat.S_IWRITE)
                os.remove(target)
            raise
        return [{k: rows[p][k] for k in ("path", "source_id", "source_version_id", "sha256", "source_kind", "created")} for p in paths]

    def extract(self, source_id: str, force: bool = False) -> dict:
        """Pages of the source's latest version; made anew only if there are none yet or ``force`` is set."""
        version = self._latest(source_id)
        vid = version["source_version_id"]
        have = self._pages(vid).collect()
        if have and not force:
            return {"reused": True, "source_version_id": vid, "status": None, "pages": [r.asDict() for r in have]}
        self._refuse_cited(self.store.tables(), self._pages(vid))
        began, run_id = self.now(), ids.new("run_")
        run = {"run_id": run_id, "source_version_id": vid, "extractor_name": "poppler" if version["source_kind"] == "pdf" else "text", "started_at": began}
        if version["source_kind"] == "pdf":
            run["ocr_provider"] = self.config["providers"]["ocr"]["default"]
        with self.store.transaction() as tables:
            tables["extraction_runs"] = append(tables["extraction_runs"], self._rows("extraction_runs", run | {"status": "running"}))
        try:
            stored = os.path.join(self.root, version["stored_path"])
            if files.file_sha256(stored) != version["sha256"]:
                raise EngineError("state_error", "the retained source has other bytes")
            fresh = self._pdf_pages(vid, stored) if version["source_kind"] == "pdf" else self._text_pages(vid, stored)
            status = extract.run_status(fresh).first()["status"]
            with self.store.transaction() as tables:
                self._refuse_cited(tables, tables["source_pages"].where(F.col("source_version_id") == vid))
                seed = F.concat_ws(":", "source_version_id", "page_number")
                tables["source_pages"] = extract.upsert_pages(tables["source_pages"], fresh, ids.derived("pg_", seed, run_id))
                tables["extraction_runs"] = self._finished(tables["extraction_runs"], run_id, status)
        except Exception as e:
            with self.store.transaction() as tables:
                tables["extraction_runs"] = self._finished(tables["extraction_runs"], run_id, "failed", "extraction did not finish")
            if isinstance(e, EngineError):
                raise
            raise EngineError("external_failure", "extraction did not finish") from e
        return {"reused": False, "source_version_id": vid, "status": status, "pages": [r.asDict() for r in self._pages(vid).collect()]}

    def _finished(self, runs: DataFrame, run_id: str, status: str, error: str | None = None, **values) -> DataFrame:
        """The run with its end."""
        own = {"status": status, "completed_at": self.now(), "error_message": error} | values
        kinds = ", ".join(f"{c} string" for c in ("run_id", *own))
        return overlay(runs, "run_id", self.spark.createDataFrame([(run_id, *own.values())], kinds))

    def _text_pages(self, vid: str, stored: str) -> DataFrame:
        version = self.spark.createDataFrame([(vid,)], "source_version_id string")
        with open(stored, "rb") as f:
            contents = self.spark.createDataFrame([(vid, bytearray(f.read()))], "source_version_id string, content binary")
        return extract.text_pages(version, contents)

    def _pdf_pages(self, vid: str, stored: str) -> DataFrame:
        if self.pdf is None or self.ocr is None:
            raise EngineError("external_failure", "no PDF or OCR adapter is set")
        with tempfile.TemporaryDirectory(dir=self._path("cache")) as folder:
            rows = ocr_cascade_input(self.pdf, self.ocr, stored, folder)
            for r in rows:
                kept = self._path("cache", "pages", vid, f"{r['page_number']:04d}.png")
                os.makedirs(os.path.dirname(kept), exist_ok=True)
                shutil.copyfile(r["image_path"], kept)
                r["image_path"] = os.path.relpath(kept, self.root)
        kinds = {"page_number": "int", "image_path": "string", "native_text": "string", "ocr_ok": "boolean", "ocr_text": "string"}
        made = self.spark.createDataFrame([(vid, *(r[c] for c in kinds)) for r in rows], "source_version_id string, " + ", ".join(f"{c} {t}" for c, t in kinds.items()))
        return extract.cascade(made)

    # -- review

    def review_extraction(self, source_id: str, page: int | None = None) -> DataFrame:
        version = self._latest(source_id)["source_version_id"]
        pages = self._pages(version)
        if pages.isEmpty():
            raise EngineError("invalid_state", "the latest version has not been extracted")
        if page is not None:
            pages = extract.pages_of(pages, version, page)
            if pages.isEmpty():
                raise EngineError("not_found", f"no page {page}")
        return pages

    def correct_page_text(self, source_id: str, page: int, text: str) -> None:
        """The page's reviewed text; refused for cited pages and blank texts."""
        if page < 1 or not text.strip(" \t\n\x0b\f\r"):
            raise EngineError("invalid_argument", "a page number and a visible text are needed")
        row = self.review_extraction(source_id, page).first()
        with self.store.transaction() as tables:
            self._refuse_cited(tables, tables["source_pages"].where(F.col("page_id") == row["page_id"]))
            tables["source_pages"] = extract.corrected(tables["source_pages"], row["page_id"], text)

    # -- proposals

    def _target(self, spec: ConceptSpec) -> dict:
        row = lifecycle.titled(self.store.table("articles"), self.spark.createDataFrame([(spec.title,)], "wanted string")).first()
        if row:
            return {"operation": "update_article", "title": row["title"], "slug": row["slug"], "article_id": row["article_id"]}
        slug = "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in spec.title.lower()).split())
        return {"operation": "create_article", "title": spec.title, "slug": slug, "article_id": None}

    def compile(self, spec: ConceptSpec | None = None, only: list[str] | None = None) -> dict:
        """Evidence -> model -> checks -> one pending proposal; older open proposals of the target are superseded."""
        if self.model is None:
            raise EngineError("invalid_argument", "no language model is set")
        spec = spec or ConceptSpec()
        t = self.store.tables()
        # one request holds all of the evidence, so it fits the driver
        evidence = [r.asDict() for r in select_evidence(t["sources"], t["source_versions"], t["source_pages"], spec, only).collect()]
        if not evidence:
            raise EngineError("no_evidence", "no reviewed page speaks of the concept")
        target = self._target(spec)
        system, user, shape = prompt.build({k: v for k, v in target.items() if v is not None}, evidence)
        self._check_request(target, evidence)
        llm = self.config["providers"]["llm"]
        provider, name = getattr(self.model, "provider", llm["default"]), getattr(self.model, "model", llm["ollama"]["model"])
        parts = {"provider": provider, "model": name, "prompt_version": prompt.VERSION, "system_prompt": system, "user_prompt": user}
        columns = {k: F.lit(v) for k, v in parts.items()} | {"response_schema": F.parse_json(F.lit(json.dumps(shape)))}
        request = self.spark.range(1).select(T.request_hash(**columns)).first()[0]
        run = {"run_id": ids.new("run_"), "provider": provider, "model": name, "prompt_version": prompt.VERSION, "request_sha256": request, "started_at": self.now()}
        try:
            response = self.model.generate(system, user, shape)
        except Exception as e:
            self._model_run(run, status="failed", error_message="the model did not answer")
            raise EngineError("external_failure", "the model did not answer") from e
        try:
            payload = validate.parse_strict(response, "proposal")
            payload["article"].setdefault("aliases", [])
        except EngineError as e:
            self._model_run(run, status="invalid_response", response_json=self._redacted(response, 1), error_message="the response did not validate")
            raise EngineError("invalid_response", str(e)) from None
        self._model_run(run, status="completed", response_json=response)
        pages = self.spark.createDataFrame([(e["page_id"], e["text"]) for e in evidence], "page_id string, text string")
        payload = self._canonical(payload, pages)
        proposal_id = ids.new("prp_")
        text = json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        asked = self._parsed(proposal_id, text)
        columns = F.struct(*(F.lit(v).cast("string").alias(k) for k, v in target.items()))
        issues = sorted((r["path"], r["message"]) for r in validate.response_issues(asked, pages, columns).collect())
        flat = citations.flatten(asked)
        kept = citations.insert_or_ignore(flat)
        if not issues and not citations.set_difference(flat, kept).isEmpty():
            issues = [("/sections", "citations of one block may not share page and start")]
        if issues:
            with self.store.transaction() as tables:
                tables["model_runs"] = self._finished(tables["model_runs"], run["run_id"], "invalid_response", "the response did not validate", response_json=self._redacted(response, len(issues)))
            raise EngineError("invalid_response", "; ".join(f"{p}: {m}" for p, m in issues))
        with self.store.transaction() as tables:
            row = {"proposal_id": proposal_id, "article_id": target["article_id"], "model_run_id": run["run_id"], "operation": target["operation"], "payload_json": text, "status": "pending", "created_at": self.now()}
            tables["proposals"] = append(lifecycle.superseded(tables["proposals"], target["article_id"]), self._rows("proposals", row))
            tables["proposal_citations"] = append(tables["proposal_citations"], kept)
        return {"proposal_id": proposal_id, "operation": target["operation"], "model_run_id": run["run_id"], "evidence_pages": len(evidence)}

    def _check_request(self, target: dict, evidence: list[dict]) -> None:
        request = self.spark.createDataFrame([("", target["operation"], target["article_id"])], "request_id string, operation string, article_id string")
        kinds = {"page_id": "string", "source_version_id": "string", "page_number": "int", "text_status": "string"}
        pages = self.spark.createDataFrame([("", i, *(e[c] for c in kinds)) for i, e in enumerate(evidence)], "request_id string, index int, " + ", ".join(f"{c} {t}" for c, t in kinds.items()))
        pages = pages.join(self.store.table("source_pages").select("page_id", "image_path"), "page_id", "left").withColumn("language", F.lit(self.config["providers"]["ocr"]["language"]))
        if found := validate.formatted(validate.request_issues(request, pages), "request_id").first():
            raise EngineError("invalid_state", found["issues"])

    def _model_run(self, run: dict, **rest) -> None:
        with self.store.transaction() as tables:
            tables["model_runs"] = append(tables["model_runs"], self._rows("model_runs", run | rest | {"completed_at": self.now()}))

    def _redacted(self, response: str, issues: int) -> str:
        one = self.spark.createDataFrame([(response,)], "r string")
        return one.select(T.redacted(F.col("r"), F.lit(issues))).first()[0]

    def _parsed(self, proposal_id: str, payload: str) -> DataFrame:
        return validate.parsed(self.spark.createDataFrame([(proposal_id, payload)], "proposal_id string, payload_json string"))

    def _canonical(self, payload: dict, pages: DataFrame) -> dict:
        """Quotes replaced by the page's own text where the span can be had."""
        located = validate.located_citations(self._parsed("", json.dumps(payload)))
        for r in citations.checked(located, pages).where("canonical_quote IS NOT NULL").select("at", "canonical_quote").collect():
            at = payload
            for key in r["at"].split("/")[1:]:
                at = at[int(key)] if isinstance(at, list) else at[key]
            at["quote"] = r["canonical_quote"]
        return payload

    def proposals(self, status: str | None = None) -> DataFrame:
        if status is not None and status not in PROPOSAL_STATUS:
            raise EngineError("invalid_argument", "unknown status")
        return lifecycle.listed(self.store.table("proposals"), status)

    def _proposal(self, proposal_id: str) -> dict:
        row = lifecycle.one(self.store.table("proposals"), proposal_id).first()
        if row is None:
            raise EngineError("not_found", f"no proposal {proposal_id}")
        return row.asDict()

    def _checked_payload(self, row: dict) -> dict:
        stored = self.spark.createDataFrame([(row["payload_json"], row["operation"])], "payload_json string, operation string")
        if issue := validate.stored_issue(stored).first()["issue"]:
            raise EngineError("state_error", f"the stored proposal: {issue}")
        return json.loads(row["payload_json"])

    def _evidence(self, proposal_id: str) -> DataFrame:
        """The proposal's stored citations with page, version and source; refused when one no longer holds."""
        t = self.store.tables()
        own = t["proposal_citations"].where(F.col("proposal_id") == proposal_id)
        if own.isEmpty():
            raise EngineError("state_error", "the proposal has no citations")
        if not citations.checked(own, t["source_pages"]).where("issue IS NOT NULL").isEmpty():
            raise EngineError("state_error", "a citation does not match its page")
        return citations.evidence_of(own, t["source_pages"], t["source_versions"], t["sources"])

    def show(self, proposal_id: str) -> dict:
        row = self._proposal(proposal_id)
        return row | {"payload": self._checked_payload(row), "citations": [r.asDict() for r in self._evidence(proposal_id).collect()]}

    def approve(self, proposal_id: str) -> None:
        self._checked_payload(self._proposal(proposal_id))
        self._move(proposal_id, "pending", status="approved", reviewed_at=self.now())

    def reject(self, proposal_id: str, reason: str | None = None) -> None:
        if reason is not None and (len(reason.encode()) > MAX_REASON_BYTES or not reason.strip(" \t\n\x0b\f\r")):
            raise EngineError("invalid_argument", "a reason is visible text of at most 4096 bytes")
        self._move(proposal_id, "pending", status="rejected", reviewed_at=self.now(), review_reason=reason)

    def _move(self, proposal_id: str, expected: str, **values) -> None:
        with self.store.transaction() as tables:
            row = lifecycle.one(tables["proposals"], proposal_id).first()
            if row is None:
                raise EngineError("not_found", f"no proposal {proposal_id}")
            if row["status"] != expected:
                raise EngineError("invalid_state", f"the proposal is {row['status']}, not {expected}")
            tables["proposals"] = compare_and_set(tables["proposals"], F.col("proposal_id") == proposal_id, expected, **values)

    # -- articles

    def apply(self, proposal_id: str, overwrite: bool = False) -> dict:
        """Write an approved proposal's article: sources are copied, then the old bytes saved, then the file replaced."""
        row = self._proposal(proposal_id)
        if row["status"] != "approved":
            raise EngineError("invalid_state", f"the proposal is {row['status']}, not approved")
        payload = self._checked_payload(row)
        p = self._parsed(proposal_id, row["payload_json"])
        start, end, reserved = self._markers()
        if bad := validate.unrenderable(p, start, end, reserved).first():
            raise EngineError("invalid_state", bad["message"])
        title = payload["article"]["title"]
        if not self.spark.range(1).select(T.is_file_name(F.lit(title))).first()[0]:
            raise EngineError("invalid_argument", "the title is no file name")
        evidence = self._evidence(proposal_id)
        if not citations.set_difference(citations.flatten(p), evidence).isEmpty():
            raise EngineError("state_error", "stored citations differ from the proposal's")
        articles = self.store.table("articles")
        if row["operation"] == "update_article":
            old = articles.where(F.col("article_id") == payload["article"].get("article_id")).first()
            if old is None:
                raise EngineError("not_found", "the article to update does not exist")
            article_id, relative, created = old["article_id"], old["vault_path"], old["created_at"]
        else:
            article_id, relative, created = ids.new("art_"), f"{title}.md", self.now()
        path = self._path("vault", relative)
        if not files.is_within(self._path("vault"), path):
            raise EngineError("invalid_argument", "the article would leave the vault")
        before = None
        if os.path.exists(path):
            with open(path, "rb") as f:
                before = f.read()
        if row["operation"] == "create_article" and before is not None and not overwrite:
            raise EngineError("conflict", "a file of that name exists")
        if row["operation"] == "update_article" and before is None:
            raise EngineError("not_found", "the article's file is missing")
        rendered = self._rendered(p, evidence, article_id, before if row["operation"] == "update_article" else None)
        self._copy_sources(evidence)
        run_id, backup = ids.new("run_"), None
        if before is not None:
            backup = os.path.join(self.config["paths"]["cache"], "backups", article_id, f"{run_id}.md")
            files.write_atomic(os.path.join(self.root, backup), before)
        data, now = rendered.encode(), self.now()
        sha = hashlib.sha256(data).hexdigest()
        try:
            with self.store.transaction() as tables:
                own = F.col("article_id") == article_id
                values = {"article_id": article_id, "title": title, "slug": payload["article"]["slug"], "vault_path": relative, "content_sha256": sha, "created_at": created, "updated_at": now}
                tables["articles"] = replace_rows(tables["articles"], "article_id", self._rows("articles", values))
                tables["article_citations"] = citations.article_rows(evidence, tables["article_citations"], article_id)
                tables["proposals"] = overlay(tables["proposals"], "proposal_id", self.spark.createDataFrame([(proposal_id, article_id, "applied", now)], "proposal_id string, article_id string, status string, applied_at string"))
                tables["apply_runs"] = append(tables["apply_runs"], self._rows("apply_runs", {"apply_run_id": run_id, "proposal_id": proposal_id, "article_id": article_id, "previous_content_sha256": hashlib.sha256(before).hexdigest() if before is not None else None, "new_content_sha256": sha, "backup_path": backup, "applied_at": now}))
                indexed = {"article_id": article_id, "title": title, "aliases": "\n".join(payload["article"].get("aliases") or []), "body": rendered}
                entry = self._rows("article_index", indexed)
                tables["article_index"] = replace_rows(tables["article_index"], "article_id", entry)
                index = full_text.build_index(entry)  # of this article only; those of the others stay
                listed = tables["article_postings"]
                # a new article's postings are written beside those that are there
                tables["article_postings"] = append(listed if listed.where(own).isEmpty() else listed.where(~own), index.postings)
                if self.store.table("proposals").where((F.col("proposal_id") == proposal_id) & (F.col("status") == "approved")).isEmpty():
                    raise EngineError("invalid_state", "the proposal is no longer approved")
                files.write_atomic(path, data)
        except BaseException:
            self._restore(path, before)
            raise
        return {"article_id": article_id, "vault_path": relative, "content_sha256": sha, "backup_path": backup}

    @staticmethod
    def _restore(path: str, before: bytes | None) -> None:
        try:
            if before is not None:
                files.write_atomic(path, before)
            else:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(path)
        except OSError as e:
            raise EngineError("filesystem_error", "the article must be restored by hand from its backup") from e

    def _copied_name(self):
        return T.vault_filename(F.col("source_id"), F.col("source_version_id"), F.col("original_filename"), F.col("source_kind"))

    def _copy_sources(self, evidence: DataFrame) -> None:
        folder = self._path("vault", self.config["vault"]["source_directory"])
        for r in evidence.select("stored_path", "sha256", self._copied_name().alias("name")).distinct().collect():
            files.retain(os.path.join(self.root, r["stored_path"]), r["sha256"], os.path.join(folder, r["name"]))

    def _rendered(self, p: DataFrame, evidence: DataFrame, article_id: str, before: bytes | None) -> str:
        start, end, _ = self._markers()
        folder = self.config["vault"]["source_directory"]
        pages = evidence.select("page_id", "display_name", "source_kind", "page_number", F.concat(F.lit(f"{folder}/"), self._copied_name()).alias("target")).distinct()
        line = render.footnote(F.col("page_id"), F.col("display_name"), F.col("source_kind"), F.col("page_number"), F.col("target"))
        notes = pages.agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", line.alias("line")))), lambda n: n["line"]).alias("notes"))  # one proposal's pages
        rows = p.join(notes)
        content = render.managed(F.col("p"), F.col("notes"))
        if before is None:
            return rows.select(render.new_article(F.col("p"), F.lit(article_id), start, end, content)).first()[0]
        try:
            old = self.spark.createDataFrame([(before.decode(),)], "old string")
        except UnicodeDecodeError:
            raise EngineError("invalid_state", "the article's file is not UTF-8") from None
        text = rows.join(old).select(T.replace_region(F.col("old"), start, end, content)).first()[0]
        if text is None:
            raise EngineError("invalid_state", "the article's markers are missing, repeated or out of order")
        return text

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """article_id, title, vault_path, snippet and relevance of the articles that hold all terms, by the stored postings."""
        t = self.store.tables()
        found = full_text.search(t["article_index"], query, limit, index=full_text.Index(t["article_postings"]), snippets=True)
        placed = full_text.with_paths(found, t["articles"])
        if not placed.where("NOT safe").isEmpty():  # limit rows at most
            raise EngineError("state_error", "an article's path leaves the vault")
        return placed.drop("safe")

    def migrate(self, folder: str) -> list[int]:
        """Apply the folder's migrations that the state has not had; their numbers."""
        return migrations.apply_all(self.store, folder, self.now())

