"""Set comparison by digests; issues by code; paths of configuration issues."""

import random

from quarryspark.operators import citations, validate
from quarryspark.sources import config

ROW = "g int, a string, b long"


def test_difference_equals_sets(spark):
    rng = random.Random(2)
    row = lambda: (rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "x", "y"]), rng.choice([None, 1, 2]))
    for k in range(4):
        a, b = [row() for _ in range(12)], [row() for _ in range(12)]
        if k == 0:
            b = [*a, a[0], a[0]]  # repeats don't make another set
        left, right = spark.createDataFrame(a, ROW), spark.createDataFrame(b, ROW)
        want = sorted(map(repr, [(*r, "expected") for r in set(a) - set(b)] + [(*r, "stored") for r in set(b) - set(a)]))
        assert sorted(repr(tuple(r)) for r in citations.set_difference(left, right, ["a", "b"], by=["g"]).collect()) == want
        assert sorted(repr(tuple(r)) for r in citations.set_difference(left, right, ["g", "a", "b"]).collect()) == want
        changed = {r.g for r in citations.changed_sets(left, right, ["g"], ["a", "b"]).collect()}
        assert {r[0] for r in set(a) ^ set(b)} <= changed
    assert citations.set_difference(left.limit(0), left.limit(0), ["a"]).collect() == []
    assert citations.set_difference(left, left, ["a", "b"], by=["g"]).collect() == []


def test_issue_codes_and_values(spark):
    pages = spark.createDataFrame([("r", 0, "pg_x", "ver_x", 1, None, "eng", "failed"), ("r", 1, "pg_x", "ver_x", 1, "../a.png", "eng", "reviewed")], "request_id string, index int, page_id string, source_version_id string, page_number int, image_path string, language string, text_status string")
    requests = spark.createDataFrame([("r", "update_article", None), ("none", "create_article", None)], "request_id string, operation string, article_id string")
    told = {(r.request_id, r.path): r.message for r in validate.request_issues(requests, pages).collect() if "ULID" not in r.message}
    assert told == {
        ("r", "/article_id"): "update_article of no article", ("none", "/pages"): "pages 0", ("r", "/pages/0/text_status"): "text_status failed",
        ("r", "/pages/1/page_id"): "page of index 0", ("r", "/pages/1/image_path"): validate.RELATIVE,
    }
    shape = "p struct<sections:array<struct<heading:string>>,related_concepts:array<struct<title:string>>>, proposal_id int, payload_json string"
    rows = [(([("fine",), ("two\nlines",)], [("R",)]), 1, ""), (([("fine",)], [("a",), ("b]]",)]), 2, ""), (([], []), 3, "a <!-- s --> b"), (([("x",)], [("y",)]), 4, "")]
    found = validate.unrenderable(spark.createDataFrame(rows, shape), "<!-- s -->", "<!-- e -->", "<!-- r")
    assert {r.proposal_id: r.message for r in found.collect()} == {1: "heading /sections/1/heading", 2: "title /related_concepts/1/title", 3: "marker <!-- s -->"}


def test_paths_of_configuration_issues():
    bad = {"schema_version": 2, "project_id": "p", "paths": {"sources": "/a", "vault": "v", "state": "../s", "cache": "c"}, "vault": {"source_directory": "", "generated_section_id": ""}}
    bad["providers"] = {"llm": {"default": "", "ollama": {"base_url": "", "model": "", "timeout_seconds": 0}}, "ocr": {"default": "", "language": ""}}
    assert [line.split(": ")[0] for line in config.problems(bad)] == [
        "/schema_version", "/project_id", "/paths/sources", "/paths/state", "/vault/source_directory", "/vault/generated_section_id", "/providers/llm/default",
        "/providers/llm/ollama/base_url", "/providers/llm/ollama/model", "/providers/llm/ollama/timeout_seconds", "/providers/ocr/default", "/providers/ocr/language",
    ]
