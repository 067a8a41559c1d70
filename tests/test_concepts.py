"""Evidence for many concepts equals evidence for each one."""

import pytest
from pyspark.sql import functions as F

from quarryspark.operators import concepts
from quarryspark.operators.evidence import select_evidence
from quarryspark.operators.schemas import ConceptSpec
from quarryspark.plans.concepts import table_of_concepts
from quarryspark.plans.registry import views

CONCEPT = "concept_id int, title string, aliases array<string>, keywords array<string>"


@pytest.fixture(scope="module")
def state(spark):
    pages = [
        ("p1", "v1", 1, "Markov chains, and a Markov-chain! The transition matrix of a b c d e f g.", "native"), ("p2", "v1", 2, "Nothing of it; a b c d e f h g.", "reviewed"),
        ("p3", "v2", 1, "a b c. d e f g", "ocr_unreviewed"), ("p4", "v3", 1, "markov chain state", "native"), ("p5", "v4", 1, "", "native"), ("p6", "v4", 2, None, "native"),
        ("p7", "v5", 1, "a a a b a a b c a b c d e f a b c d e f g", "native"), ("p8", "v6", 1, "markov chains", "native"),
    ]
    pages = spark.createDataFrame(pages, "page_id string, source_version_id string, page_number int, text string, text_status string")
    versions = spark.createDataFrame([("s1", "v1", 1), ("s2", "v2", 2), ("s3", "v3", 3), ("s3", "v4", 4), ("s5", "v5", 5), ("s6", "v6", 6)], "source_id string, source_version_id string, version_seq long")
    sources = [("s1", "Markov chains", "text", None), ("s2", "other", "text", None), ("s3", "third", "text", None), ("s5", "A B", "text", None), ("s6", "gone", "text", "2024")]
    return spark.createDataFrame(sources, "source_id string, display_name string, source_kind string, archived_at string"), versions, pages


SPECS = [
    (1, "Markov Chains", ["Markov chain", "markov  CHAIN"], ["transition matrix", "state"]), (2, "a b c d e f g", [], ["a", "a a b"]), (3, "nowhere", None, None), (4, "—", ["", None], []),
    (5, "A B", ["c d e", "a b c d"], ["b c d e f", "f g"]), (6, None, ["e f h g"], ["g"]),
]


def test_every_concept_equals_its_own_selection(spark, state):
    found = concepts.select_for_all(*state, concepts.phrases_of(spark.createDataFrame(SPECS, CONCEPT)))
    got = {}
    for r in found.collect():
        got.setdefault(r.concept_id, []).append((r.score, r.sort_name, r.source_id, r.page_number, r.page_id))
    for k, title, aliases, keywords in SPECS:
        spec = ConceptSpec(title or "", tuple(a for a in aliases or () if a), tuple(keywords or ()))
        want = [(r.score, r.sort_name, r.source_id, r.page_number, r.page_id) for r in select_evidence(*state, spec).collect()]
        assert sorted(got.get(k, [])) == sorted(want)
    assert set(got) == {1, 2, 5, 6}


def test_no_concepts_or_pages(spark, state):
    none = concepts.phrases_of(spark.createDataFrame([], CONCEPT))
    assert concepts.select_for_all(*state, none).collect() == []
    some = concepts.phrases_of(spark.createDataFrame(SPECS, CONCEPT))
    assert concepts.select_for_all(state[0], state[1], state[2].limit(0), some).collect() == []


def test_long_phrases_are_pieces(spark):
    phrases = spark.createDataFrame([("a",), ("a b",), ("a b c",), ("a b c d",), ("a b c d e f",), ("a b c d e f g",)], "phrase string")
    pieces = {}
    for r in concepts.grams_of(phrases).collect():
        pieces.setdefault(r.phrase, []).append((r.offset, r.gram, r.parts))
    assert {k: sorted(v) for k, v in pieces.items()} == {
        "a": [(0, "a", 1)], "a b": [(0, "a b", 1)], "a b c": [(0, "a b c", 1)], "a b c d": [(0, "a b c", 2), (1, "b c d", 2)],
        "a b c d e f": [(0, "a b c", 2), (3, "d e f", 2)], "a b c d e f g": [(0, "a b c", 3), (3, "d e f", 3), (4, "e f g", 3)],
    }


def test_passages_of_the_tables_as_concepts(spark, sf_dir):
    v = views(spark, sf_dir)
    table = table_of_concepts(v)
    found = concepts.select_for_all(v.sources, v.versions, v.pages, concepts.phrases_of(table))
    for r in table.where("concept_id IN (0, 7, 21)").collect():
        spec = ConceptSpec(r.title, tuple(r.aliases), tuple(r.keywords))
        want = sorted((x.score, x.page_id) for x in select_evidence(v.sources, v.versions, v.pages, spec).collect())
        assert sorted((x.score, x.page_id) for x in found.where(F.col("concept_id") == r.concept_id).collect()) == want
