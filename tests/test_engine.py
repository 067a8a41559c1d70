"""Behaviour of the engine on small, hand-written cases."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from quarryspark.functions import text as T
from quarryspark.operators import citations, extract, ids, ingest, lifecycle, migrations, passages, render, search, state, validate
from quarryspark.operators.evidence import select_evidence
from quarryspark.operators.schemas import ConceptSpec, EngineError
from quarryspark.operators.state import StateStore, append
from quarryspark.sources import adapters, config, files


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(col).first()[0]


def test_text_expressions(spark):
    assert one(spark, T.match_text(F.col("t")), t=" Étude—Markov\tChains! ") == "tude markov chains"
    assert one(spark, T.squeeze(F.col("t")), t=" a \x0b\f b  ") == "a b "
    assert one(spark, T.byte_span(F.col("t"), F.lit(3), F.lit(15)), t="πAMarkov chain example") == "Markov chain"
    assert one(spark, T.has_phrase(T.match_text(F.col("t")), "markov chain"), t="markov chains") is False
    assert [one(spark, T.safe_relative(F.col("t")), t=t) for t in ("a/b", "", "/a", "a/../b", "..a")] == [True, False, False, False, True]
    assert one(spark, T.markdown_url(F.col("t")), t="_s/a b*~é+.pdf") == "_s/a%20b%2A~%C3%A9%2B.pdf"
    assert one(spark, T.markdown_label(F.col("t")), t="[a]\\") == "\\[a\\]\\\\"
    assert one(spark, T.usable_native(F.col("t")), t=" .. a ") is False
    assert one(spark, T.file_kind(F.col("t")), t="x/Notes.PDF") == "pdf"
    assert one(spark, T.replace_region(F.col("t"), "<a>", "<b>", F.lit("new")), t="x<a>old<b>y") == "x<a>\n\nnew\n\n<b>y"
    assert one(spark, T.replace_region(F.col("t"), "<a>", "<b>", F.lit("new")), t="x<a><a>old<b>y") is None


def test_sha256_vectors(spark):
    assert one(spark, T.sha256_text(F.col("t")), t="abc") == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert one(spark, T.sha256_text(F.col("t")), t="") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_ids(spark):
    assert len(ids.new("src_")) == 30
    made = one(spark, ids.derived("page_", F.col("k")), k="x")
    assert made == ids.derived_py("page_", "x")
    assert one(spark, T.is_id(F.col("v"), "page_"), v=made) is True


def test_ingest_dedups_and_versions(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    assert store.initialize() and not store.initialize()
    new_id = lambda prefix, key: ids.derived(prefix, key, "t")
    batches = [[("in/a.md", b"one"), ("in/b.md", b"one"), ("in/c.rtf", b"x")], [("in/a.md", b"two"), ("in/z.txt", b"one")]]
    for rows in batches:
        df = spark.createDataFrame([(p, bytearray(c), i) for i, (p, c) in enumerate(rows)], "path string, content binary, seq long")
        with store.transaction() as tables:
            new, result = ingest.ingest(tables, df, "2024-01-01T00:00:00Z", new_id)
            tables |= new
            result.collect()
    assert store.table("sources").count() == 1 and store.table("source_versions").count() == 2
    latest = ingest.latest_versions(store.table("source_versions")).collect()
    assert [r["sha256"] for r in latest] == ["3fc4ccfe745870e2c0d99f71f30ff0656c8dedd41cc1d7d3d376b0dbe685e2f3"]


def test_failed_transaction_leaves_state(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    store.initialize()
    row = [("src_1", "a", "text", "now", None)]
    with store.transaction() as tables:
        tables["sources"] = append(tables["sources"], spark.createDataFrame(row, tables["sources"].schema))
    with pytest.raises(EngineError) as e, store.transaction() as tables:
        tables["sources"] = append(tables["sources"], spark.createDataFrame(row, tables["sources"].schema))
    assert e.value.kind == "state_error" and store.table("sources").count() == 1
    assert not os.path.exists(tmp_path / "state" / "LOCK") and not os.path.exists(tmp_path / "state" / "v=2")


def test_evidence_order_and_gates(spark):
    sources = spark.createDataFrame([("s1", "Notes.md", "text", None), ("s2", "Markov Chains Overview.md", "text", None), ("s3", "Old.md", "text", "x")], "source_id string, display_name string, source_kind string, archived_at string")
    versions = spark.createDataFrame([("v1", "s1", 1), ("v1b", "s1", 2), ("v2", "s2", 3), ("v3", "s3", 4)], "source_version_id string, source_id string, version_seq long")
    pages = spark.createDataFrame([("p1", "v1", 1, "markov chains", "native"), ("p2", "v1b", 1, "a transition matrix", "native"), ("p3", "v2", 1, "text", "reviewed"), ("p4", "v2", 2, "markov property", "ocr_unreviewed"), ("p5", "v3", 1, "markov chains", "native")], "page_id string, source_version_id string, page_number int, text string, text_status string")
    rows = select_evidence(sources, versions, pages, ConceptSpec()).collect()
    assert [(r["page_id"], r["score"]) for r in rows] == [("p3", 1000), ("p2", 20)]
    with pytest.raises(EngineError):
        select_evidence(sources, versions, pages, ConceptSpec(), ["s3"])


def proposal(**change):
    cite = {"page_id": ids.derived_py("pg_", "1"), "start_char": 2, "end_char": 14, "quote": "Markov chain"}
    base = {"schema_version": 1, "operation": "create_article", "article": {"title": "Markov Chains", "slug": "markov-chains", "aliases": ["Markov chain"]}, "sections": [{"key": "key_ideas", "heading": "Key ideas", "blocks": [{"kind": "bullet", "text": "B.", "citations": [cite]}, {"kind": "paragraph", "text": "P.", "citations": [cite, cite | {"start_char": 0}]}]}], "related_concepts": [{"title": "Bayes", "reason": "", "citations": [cite]}]}
    return base | change


def parsed(spark, *docs):
    return validate.parsed(spark.createDataFrame([(f"p{i}", json.dumps(d)) for i, d in enumerate(docs)], "proposal_id string, payload_json string"))


def test_strict_structure(spark):
    bad = proposal()
    bad["sections"][0]["blocks"][0]["colour"] = 1
    docs = [proposal(), bad, proposal(operation="drop"), {k: v for k, v in proposal().items() if k != "sections"}]
    rows = validate.strict_structure(spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").coalesce(1), "j").collect()
    assert [r["structure_path"] for r in rows] == [None, "/sections/0/blocks/0/colour", "/operation", "/sections"]
    with pytest.raises(EngineError):
        validate.parse_strict("{", "proposal")


def test_semantic_and_citation_issues(spark):
    bad = proposal(schema_version=2, article={"title": "", "slug": "No Slug", "aliases": ["a", "a"]})
    bad["sections"][0]["blocks"][0] |= {"text": "", "citations": []}
    found = {r["path"] for r in validate.semantic_issues(parsed(spark, bad)).collect()}
    assert found == {"/schema_version", "/article/title", "/article/slug", "/article/aliases", "/sections/0/blocks/0/text", "/sections/0/blocks/0/citations"}
    pages = spark.createDataFrame([(ids.derived_py("pg_", "1"), "A Markov \n chain has")], "page_id string, text string")
    rows = validate.citation_issues(parsed(spark, proposal()), pages).collect()
    assert {(r["path"]) for r in rows} == {"/sections/0/blocks/0/citations/0/quote", "/sections/0/blocks/1/citations/0/quote", "/sections/0/blocks/1/citations/1/quote", "/related_concepts/0/citations/0/quote"}
    sound = spark.createDataFrame([(ids.derived_py("pg_", "1"), "A Markov chain has")], "page_id string, text string")
    assert {r["path"] for r in validate.citation_issues(parsed(spark, proposal()), sound).collect()} == {"/sections/0/blocks/1/citations/1/quote"}


def test_block_index_runs_on_and_first_wins(spark):
    rows = citations.flatten(parsed(spark, proposal())).collect()
    assert sorted((r["section_key"], r["block_index"], r["start_char"]) for r in rows) == [("key_ideas", 0, 2), ("key_ideas", 1, 0), ("key_ideas", 1, 2), ("related_concepts", 0, 2)]
    again = citations.flatten(parsed(spark, proposal())).withColumn("end_char", F.col("end_char") + F.col("emit"))
    assert citations.insert_or_ignore(again.unionByName(again.withColumn("emit", F.col("emit") + 9))).count() == 4


def test_render(spark):
    p = parsed(spark, proposal())
    page = ids.derived_py("pg_", "1")
    notes = F.transform(render.cited(F.col("p")), lambda i: render.footnote(i, F.lit("A [b]"), F.lit("pdf"), F.lit(3), F.lit("_s/a b.pdf")))
    text = p.select(render.new_article(F.col("p"), F.lit("art_1"), "<!-- s -->", "<!-- e -->", render.managed(F.col("p"), notes))).first()[0]
    assert text == (
        "---\nschema: 1\narticle_id: art_1\ntitle: Markov Chains\naliases:\n  - Markov chain\ntags:\n  - probability\n---\n\n# Markov Chains\n\n<!-- s -->\n\n"
        f"## Key ideas\n\n- B. [^{page}]\n\nP. [^{page}]\n\n## Related concepts\n\n- [[Bayes]] [^{page}]\n\n## Sources\n\n[^{page}]: [A \\[b\\], p. 3](_s/a%20b.pdf#page=3)\n\n<!-- e -->\n"
    )


def test_cascade_and_stable_ids(spark):
    rows = spark.createDataFrame([("v", 1, "enough text", False, None), ("v", 2, "", True, "seen"), ("v", 3, None, True, " ")], "source_version_id string, page_number int, native_text string, ocr_ok boolean, ocr_text string")
    pages = extract.cascade(rows).withColumn("image_path", F.lit(None).cast("string"))
    assert [r["text_status"] for r in pages.orderBy("page_number").collect()] == ["native", "ocr_unreviewed", "failed"]
    old = pages.where("page_number < 3").withColumn("page_id", F.concat(F.lit("old"), F.col("page_number").cast("string")))
    again = extract.upsert_pages(old, pages.where("page_number > 1"), F.lit("new"))
    assert [(r["page_number"], r["page_id"]) for r in again.orderBy("page_number").collect()] == [(1, "old1"), (2, "old2"), (3, "new")]
    assert extract.run_status(pages).first()["status"] == "failed"


def test_lifecycle(spark):
    df = spark.createDataFrame([("a", None, "create_article", "pending"), ("b", None, "create_article", "applied"), ("c", "x", "update_article", "approved")], "proposal_id string, article_id string, operation string, status string")
    assert [r["status"] for r in lifecycle.superseded(df, None).orderBy("proposal_id").collect()] == ["superseded", "applied", "approved"]
    assert [r["status"] for r in lifecycle.superseded(df, "x").orderBy("proposal_id").collect()] == ["pending", "applied", "superseded"]


ARTICLES = [(1, "Markov Chains", "Markov chain", "The état of a system. A transition matrix."), (2, "Bayes", "", "Prior and posterior; see Markov chains."), (3, "Other", "", "Nothing here. Markov—chains adjacent."), (4, "Plain", "", "Words only.")]


@pytest.mark.parametrize("query", ["markov", "markov chains", '"markov" chains*', "etat", "MARKOV OR chains", "markov—chains", "transition matrix system", "—", "of a"])
def test_search_agrees_with_fts(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, title, aliases, body, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", ARTICLES)
    import re

    words = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", query)
    want = db.execute("SELECT id, bm25(f, 0, 10, 5, 1) FROM f WHERE f MATCH ?", (" AND ".join(f'"{w}"' for w in words),)).fetchall()
    got = search.search(spark.createDataFrame(ARTICLES, "article_id long, title string, aliases string, body string"), query, snippets=True).collect()
    assert {r["article_id"] for r in got} == {i for i, _ in want}
    assert {r["article_id"]: round(r["relevance"], 9) for r in got} == {i: round(s, 9) for i, s in want}


def test_search_guards(spark):
    df = spark.createDataFrame(ARTICLES, "article_id long, title string, aliases string, body string")
    for query, limit in (("---", 20), ("a", 0), ("a", 101), ("x" * 5000, 20)):
        with pytest.raises(EngineError):
            search.search(df, query, limit)
    assert search.snippet("One two. Three four five six seven.", [["four"]], 4) == " ... Three [four] five six ... "


def test_files_config_and_adapters(spark, tmp_path):
    src = tmp_path / "a.txt"
    src.write_bytes(b"abc")
    sha = files.file_sha256(str(src))
    assert files.retain(str(src), sha, str(tmp_path / "kept" / "a.txt")) and not files.retain(str(src), sha, str(tmp_path / "kept" / "a.txt"))
    with pytest.raises(EngineError):
        files.retain(str(src), "0" * 64, str(tmp_path / "kept" / "b.txt"))
    rows = files.scan(spark, [str(src)]).collect()
    assert rows[0]["seq"] == 0 and bytes(rows[0]["content"]) == b"abc"
    own = config.DEFAULT | {"project_id": ids.new("prj_")}
    config.write(str(tmp_path / "c.json"), own)
    assert config.read(str(tmp_path / "c.json")) == own and config.problems(config.DEFAULT) == ["/project_id: must be a prj_ ULID"]
    config.write(str(tmp_path / "c.json"), config.DEFAULT | {"paths": config.DEFAULT["paths"] | {"vault": "../x"}})
    with pytest.raises(EngineError):
        config.read(str(tmp_path / "c.json"))

    class Fake:
        def __init__(self):
            self.calls = []

        def run(self, argv):
            self.calls.append(argv)
            if argv[0] == "pdftoppm":
                for k in (1, 2):
                    open(f"{argv[-1]}-{k}.png", "w").close()
            if argv[0] == "pdftotext" and argv[2] == "1":
                with open(argv[-1], "w") as f:
                    f.write("native text")
            return 0

    fake = Fake()
    rows = adapters.ocr_cascade_input(adapters.PopplerPdf(fake), adapters.TesseractOcr(fake), "x.pdf", str(tmp_path))
    assert [(r["page_number"], r["native_text"], r["ocr_ok"]) for r in rows] == [(1, "native text", False), (2, None, False)]
    assert fake.calls[0][:4] == ["pdftoppm", "-png", "-r", "150"]
    with pytest.raises(EngineError):
        adapters.HttpModel("http://user:pw@x", "m")


def test_streaming_ingest(spark, tmp_path):
    from quarryspark.streaming.ingest import start

    (tmp_path / "in").mkdir()
    for name, data in (("a.txt", b"1"), ("b.txt", b"1"), ("c.txt", b"2")):
        (tmp_path / "in" / name).write_bytes(data)
    seen = []
    q = start(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, _: seen.extend(r["sha256"] for r in df.select("sha256").collect()))
    q.awaitTermination(120)
    assert len(seen) == 2


def test_migrations_are_applied_once_and_in_order(spark, tmp_path):
    store, folder = state.StateStore(spark, str(tmp_path / "s")), tmp_path / "m"
    store.initialize()
    folder.mkdir()
    (folder / "002_reason.sql").write_text("-- a column\nALTER TABLE notes ADD COLUMN reason TEXT;")
    (folder / "001_first.sql").write_text("CREATE TABLE notes (note_id TEXT, size INTEGER);")
    (folder / "readme.txt").write_text("no migration")
    assert migrations.apply_all(store, str(folder), "t") == [1, 2] and migrations.apply_all(store, str(folder), "t") == []
    assert [r["version"] for r in store.table("schema_migrations").orderBy("version").collect()] == [1, 2]
    with store.transaction() as tables:
        tables["notes"] = state.append(tables["notes"], spark.createDataFrame([("n", 1, "why")], "note_id string, size long, reason string"))
    (folder / "003_more.sql").write_text("ALTER TABLE notes ADD COLUMN more TEXT")
    assert migrations.apply_all(store, str(folder), "t") == [3]
    assert [tuple(r) for r in store.table("notes").collect()] == [("n", 1, "why", None)]
    (folder / "004_bad.sql").write_text("DROP TABLE notes;")
    with pytest.raises(EngineError):
        migrations.apply_all(store, str(folder), "t")
    assert store.table("schema_migrations").count() == 3
    (folder / "0004_twice.sql").write_text("")
    with pytest.raises(EngineError, match="twice"):
        migrations.apply_all(store, str(folder), "t")


def test_appended_rows_are_a_part_of_their_own(spark, tmp_path):
    store = state.StateStore(spark, str(tmp_path / "s"), most_parts=2)
    store.initialize()
    row = lambda k: spark.createDataFrame([(k, "t")], "version int, applied_at string")
    sizes = []
    for k in range(4):
        with store.transaction() as tables:
            tables["schema_migrations"] = state.append(tables["schema_migrations"], row(k))
        sizes.append(len(store.manifest()["tables"]["schema_migrations"]))
    assert sizes == [1, 2, 1, 2] and store.table("schema_migrations").count() == 4
    with store.transaction() as tables:  # not a pure append: written as one
        tables["schema_migrations"] = state.append(tables["schema_migrations"].where("version > 1"), row(9))
    assert len(store.manifest()["tables"]["schema_migrations"]) == 1
    assert sorted(r["version"] for r in store.table("schema_migrations").collect()) == [2, 3, 9]


def test_a_lost_writer_gives_way(spark, tmp_path):
    store = state.StateStore(spark, str(tmp_path / "s"), lease_s=0.2)
    store.initialize()
    store._locked(1)  # a writer that never comes back
    row = spark.createDataFrame([(1, "t")], "version int, applied_at string")
    with pytest.raises(EngineError), store.transaction(wait_s=0.05):
        pass
    with state.StateStore(spark, store.root).transaction() as tables:
        tables["schema_migrations"] = state.append(tables["schema_migrations"], row)
    assert store.table("schema_migrations").count() == 1
    with pytest.raises(EngineError, match="lease"), store.transaction() as tables:
        tables["schema_migrations"] = state.append(tables["schema_migrations"], row.withColumn("version", F.lit(2)))
        import time

        time.sleep(0.3)
        os.replace(os.path.join(store.root, "LOCK"), os.path.join(store.root, "LOCK.gone"))  # another took it over
    assert store.table("schema_migrations").count() == 1


def test_ocr_reads_pages_without_usable_text(spark, tmp_path):
    class Pdf:
        def render(self, pdf, folder):
            return ["page-1.png", "page-2.png"]

        def native_text(self, pdf, page, folder):
            return {1: ". ", 2: "enough text"}[page]

    class Ocr:
        def recognise(self, image, folder):
            return True, "seen", ""

    rows = adapters.ocr_cascade_input(Pdf(), Ocr(), "x.pdf", str(tmp_path))
    assert [r["ocr_ok"] for r in rows] == [True, False]
    values = ["", ". ", "ab", "abcd", "....", "..a.", "..ab", "é..x", None, " a b c d ", "\u00e9\u00e9"]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", T.usable_native(F.col("v")).alias("u")).orderBy("i").collect()
    assert [r["u"] for r in got] == [adapters.usable(v) for v in values]


def test_model_over_http():
    class Http:
        def __init__(self, status, reply):
            self.status, self.reply, self.sent = status, reply, None

        def post_json(self, url, body, timeout_s):
            self.sent = (url, json.loads(body), timeout_s)
            return self.status, self.reply

    good = Http(200, b'{"done": true, "message": {"content": "{}"}}')
    assert adapters.HttpModel("http://h:1/", "m", 5, good).generate("s", "u", {}) == "{}"
    assert good.sent[0] == "http://h:1/api/chat" and good.sent[1]["model"] == "m" and good.sent[2] == 5
    for status, reply in ((500, b"{}"), (200, b"no json"), (200, b'{"done": false, "message": {"content": "x"}}'), (200, b"[]")):
        with pytest.raises(EngineError) as e:
            adapters.HttpModel("http://h", "m", 5, Http(status, reply)).generate("s", "u", {})
        assert e.value.kind == "external_failure"


def test_local_http_is_bounded():
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            n = int(self.headers["Content-Length"])
            body = self.rfile.read(n)
            self.send_response(302 if self.path == "/moved" else 200)
            if self.path == "/moved":
                self.send_header("Location", "/other")
            self.end_headers()
            self.wfile.write(body if self.path != "/large" else b"x" * ((16 << 20) + 1))

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at, client = f"http://127.0.0.1:{server.server_port}", adapters.LocalHttp()
    assert client.post_json(f"{at}/echo", b'{"a":1}', 5) == (200, b'{"a":1}')
    assert client.post_json(f"{at}/moved", b"", 5)[0] == 302
    for path in (f"{at}/large", "http://127.0.0.1:1/"):
        with pytest.raises(EngineError):
            client.post_json(path, b"", 5)
    server.shutdown()


def test_passages_are_found_where_they_first_stand(spark):
    texts = spark.createDataFrame([(1, "xé abc abc"), (2, None), (3, "bcab"), (4, "ab")], "page_id long, text string")
    items = spark.createDataFrame([(10, "abc"), (11, "bc"), (12, "abc"), (13, ""), (14, None), (15, "é")], "item_id long, text string")
    want = {(1, 10, 4, 7), (1, 12, 4, 7), (1, 11, 5, 7), (1, 15, 1, 3), (3, 11, 0, 2)}
    for size in (1 << 20, 3):  # one block, and several
        assert {(r.page_id, r.item_id, r.start_char, r.end_char) for r in passages.found(texts, items, size).collect()} == want
    assert passages.found(texts, items.limit(0)).count() == 0
