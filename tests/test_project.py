"""The verbs end to end, with doubles for external tools."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quarryspark.__main__ import command, parser
from quarryspark.operators.schemas import EngineError
from quarryspark.project import Project, find_root

TEXT = "A Markov \n chain has the Markov property."


class Model:
    """Cites the first Markov page of the request, with the target it was given."""

    def __init__(self):
        self.calls, self.change = 0, {}

    def generate(self, system, user, schema):
        self.calls += 1
        lines = user.split("\n")
        target, page = json.loads(lines[1]), json.loads(lines[-1])[0]
        cite = {"page_id": page["page_id"], "start_char": 2, "end_char": 16, "quote": "Markov   chain"}
        article = {k: target[k] for k in ("title", "slug", "article_id") if k in target} | {"aliases": ["Markov chain"]}
        sections = [{"key": "key_ideas", "heading": "Key ideas", "blocks": [{"kind": "bullet", "text": f"Idea {self.calls}.", "citations": [cite]}]}]
        return json.dumps({"schema_version": 1, "operation": target["operation"], "article": article, "sections": sections, "related_concepts": [{"title": "Bayes", "reason": "", "citations": [cite]}]} | self.change)


class Pdf:
    def render(self, pdf, folder):
        out = [os.path.join(folder, f"page-{i}.png") for i in (1, 2, 3)]
        for p in out:
            open(p, "wb").close()
        return out

    def native_text(self, pdf, page, folder):
        return {1: "transition matrix", 2: ""}.get(page)


class Ocr:
    def recognise(self, image, folder):
        return (True, "a Markov chaim", "") if "page-2" in image else (False, "", "no")


def refused(kind, call, *args):
    with pytest.raises(EngineError) as e:
        call(*args)
    assert e.value.kind == kind


@pytest.fixture()
def project(spark, tmp_path):
    p = Project.init(spark, str(tmp_path / "p"), model=Model(), pdf=Pdf(), ocr=Ocr())
    assert find_root(p._path("vault")) == p.root
    (tmp_path / "notes.md").write_text(TEXT)
    (tmp_path / "same.txt").write_text(TEXT)
    (tmp_path / "scan.PDF").write_bytes(b"%PDF")
    (tmp_path / "odd.rtf").write_text("x")
    return p


def test_workflow(project, tmp_path):
    at = lambda *names: [str(tmp_path / n) for n in names]
    one, same = project.import_files(at("notes.md", "same.txt"))
    assert one["created"] and not same["created"] and one["source_id"] == same["source_id"]
    refused("unsupported_format", project.import_files, at("scan.PDF", "odd.rtf"))  # the first is in all the same
    assert project.store.table("sources").count() == 2
    refused("no_evidence", project.compile)
    assert project.model.calls == 0
    assert project.extract(one["source_id"])["pages"][0]["text"] == TEXT and project.extract(one["source_id"])["reused"]
    before = project.extract(one["source_id"])["pages"][0]["page_id"]
    assert project.extract(one["source_id"], True)["pages"][0]["page_id"] == before
    first, second = project.compile(), project.compile()
    assert [r["status"] for r in project.proposals().orderBy("status").collect()] == ["pending", "superseded"]
    shown = project.show(second["proposal_id"])
    assert {c["quote"] for c in shown["citations"]} == {"Markov chain"} and len(shown["citations"]) == 2
    refused("conflict", project.extract, one["source_id"], True)
    refused("invalid_state", project.apply, second["proposal_id"])
    refused("invalid_state", project.approve, first["proposal_id"])
    refused("invalid_argument", project.reject, second["proposal_id"], " \n")
    project.approve(second["proposal_id"])
    path = project._path("vault", "Markov Chains.md")
    with open(path, "w") as f:
        f.write("mine")
    refused("conflict", project.apply, second["proposal_id"])
    os.remove(path)
    made = project.apply(second["proposal_id"])
    text = open(path).read()
    assert "- Idea 2. [^" in text and "(_sources/" in text and project.store.table("article_citations").count() == 2
    with open(path, "w") as f:
        f.write("own line\n" + text + "own end")
    third = project.compile()
    assert third["operation"] == "update_article"
    project.approve(third["proposal_id"])
    again = project.apply(third["proposal_id"])
    new = open(path).read()
    assert again["article_id"] == made["article_id"] and new.startswith("own line\n---") and new.endswith("own end") and "Idea 3." in new and "Idea 2." not in new
    assert open(os.path.join(project.root, again["backup_path"])).read() == "own line\n" + text + "own end"
    found = project.search("markov bayes").collect()
    assert [r["article_id"] for r in found] == [made["article_id"]]
    with open(path, "w") as f:
        f.write(new.replace("managed:end", "managed:gone"))
    fourth = project.compile()
    project.approve(fourth["proposal_id"])
    refused("invalid_state", project.apply, fourth["proposal_id"])
    assert "managed:gone" in open(path).read()


def test_scans_and_review(project, tmp_path):
    (scan,) = project.import_files([str(tmp_path / "scan.PDF")])
    got = project.extract(scan["source_id"])
    assert got["status"] == "failed" and [p["text_status"] for p in got["pages"]] == ["native", "ocr_unreviewed", "failed"]
    refused("invalid_argument", project.correct_page_text, scan["source_id"], 2, " ")
    project.correct_page_text(scan["source_id"], 2, "a Markov chain")
    rows = project.review_extraction(scan["source_id"]).collect()
    assert [r["text_status"] for r in rows] == ["native", "reviewed", "failed"] and os.path.exists(os.path.join(project.root, rows[0]["image_path"]))
    refused("not_found", project.review_extraction, scan["source_id"], 9)
    project.ocr = None
    refused("external_failure", project.extract, scan["source_id"], True)
    assert [r["status"] for r in project.store.table("extraction_runs").collect()] == ["failed", "failed"]


def test_invalid_responses_leave_one_redacted_run(project, tmp_path):
    (one,) = project.import_files([str(tmp_path / "notes.md")])
    project.extract(one["source_id"])
    project.model.change = {"schema_version": 2}
    refused("invalid_response", project.compile)
    (run,) = project.store.table("model_runs").collect()
    assert run["status"] == "invalid_response" and json.loads(run["response_json"])["redacted"] is True
    assert project.proposals().isEmpty()


def test_commands(spark, tmp_path):
    call = lambda *argv: command(parser().parse_args(["--project", str(tmp_path / "q"), *argv]), spark, model=Model())
    assert call("init")[0] == 0
    (tmp_path / "n.txt").write_text(TEXT)
    code, document = call("import", str(tmp_path / "n.txt"))
    source = document["result"][0]["source_id"]
    assert code == 0 and document["command"] == "import" and call("extract", source)[0] == 0
    code, document = call("compile", "--concept", "Markov Chains")
    assert code == 0 and call("apply", document["result"]["proposal_id"])[0] == 3
    assert call("proposal", "reject", document["result"]["proposal_id"], "--reason", "no")[0] == 0
    assert call("proposal", "list", "--status", "odd")[0] == 2 and call("search", "...")[0] == 2
    assert call("proposal", "list", "--status", "rejected")[1]["result"][0]["review_reason"] == "no"
    assert call("review", "extraction", "src_none")[1]["error"]["kind"] == "not_found"
    assert spark.range(1).select(F.lit(1)).first()[0] == 1
