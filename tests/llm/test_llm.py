"""Training-data operators against brute force, round trips, libraries and held-out labels."""

import collections
import hashlib
import itertools
import random
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryspark.llm import ann, bpe, common, exact_dedup, gbt, langid, mixing, pack, quality, queries, simhash, toxicity, url_filter
from quarryspark.llm.common import held_out
from quarryspark.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, h long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", "en", None, 3), (4, "the same text here", "en", "s", 18), (5, "the  same\ttext here", "en", "s", 19), (6, "the same text here", "en", "s", 18), (6, "the same text here", "en", "s", 18), (7, "Ünïcödé wörter 123 <|endoftext|> !", "de", "s", 30), (8, "long " * 20_000, "en", "t", 100_000), (9, "x" * 50_000, "fr", "t", 50_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(*r, "extra", 0) for r in ODD], DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 1, 1), (8, 0, 0), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.Merges.load(queries.tokenizer_path()))


def by_library(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# 1 packing


@given(st.lists(st.integers(0, 40), max_size=60))
@settings(max_examples=60, deadline=None)
def test_best_fit_decreasing(lengths):
    rows = pack.best_fit_decreasing(lengths, 40)
    assert sorted(itertools.chain(*rows)) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in r) <= 40 for r in rows)
    free, plain = [], collections.Counter()
    for n in sorted(lengths, reverse=True):  # the plain algorithm opens as many rows
        fit = [f for f in free if f >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(40 - n)
        plain[n] += 1
    assert len(rows) == len(free)


def test_packing_is_lossless(spark, odd, empty, library):
    out = pack.pack(odd, queries.tokenizer_path(), row_len=64, pad_id=49407, shard_tokens=3000).collect()
    found = collections.defaultdict(dict)
    for r in out:
        ids, pos = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == len(pos) == 64 and len(set(r["cu_seqlens"])) <= r["n_segments"] + 1 and r["cu_seqlens"][-1] == r["n_tokens"]
        for k, (a, b) in enumerate(zip(r["cu_seqlens"], r["cu_seqlens"][1:])):
            found[r["doc_ids"][k]].setdefault(r["pieces"][k], []).append(ids[a:b].tolist())
            assert pos[a:b].tolist() == list(range(b - a))
    for doc, text, *_ in ODD:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert [x for p in sorted(found[doc]) for x in found[doc][p][0]] == want
    assert len(found[6][0]) == 2 and len({r["pack_id"] for r in out}) == len(out)
    assert pack.pack(empty, queries.tokenizer_path()).count() == 0


def test_packing_of_empty_texts_ties_and_long_rows(spark, library, tmp_path):
    assert max(map(len, pack.best_fit_decreasing([0] * 25 + [3, 3], 8))) <= 8
    rows = [(None, "two words"), (None, "two words"), (7, ""), (8, "long " * 80_000)]
    out = pack.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), queries.tokenizer_path(), row_len=70_000)
    pack.write(out, str(tmp_path / "packed"), 70_000, 49_408)
    ids, lengths, positions = next(iter(pack.matrices(spark, str(tmp_path / "packed"))))
    assert ids.shape == positions.shape == (2, 70_000) and positions.dtype == np.uint32
    assert positions[0].tolist() == list(range(70_000)) and lengths[0] == [0, 70_000, 70_000]  # the empty text takes the first row
    two = library.encode("two words", add_special_tokens=False).ids
    assert lengths[1] == [0, 10_000, 10_002, 10_004] and ids[1, 10_000:10_004].tolist() == two * 2 and positions[1, 9_999:10_003].tolist() == [9_999, 0, 1, 0]


# 2 URLs


def test_url_rules_and_shrinkage(spark):
    urls = ["http://a.Example.com/en/71?x", "http://a.example.com/en/9", "https://x.net/de/8", "https://m.example.net/de/81#t", "https://q.org", "https://q.org?a=/es/", "nothing", None, "http://good.org/a", "http://bad.org/a", "://h/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([(8, 1)] * 30 + [(9, 0)] * 30, "page_id long, good int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, outcomes).collect()}
    assert [got[i]["rule"] for i in range(6)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", None, None]
    assert [got[i]["verdict"] for i in range(4)] == ["allow", "block", "allow", "block"]
    assert (got[0]["host"], got[0]["path"], got[5]["host"], got[5]["path"], got[6]["host"], got[7]["path"]) == ("a.example.com", "/en/71", "q.org", "", "", "")
    assert got[8]["verdict"] == "allow" and got[9]["verdict"] == "block" and got[8]["reputation"] > got[4]["reputation"] > got[9]["reputation"]
    none = url_filter.judge(pages, outcomes.where("good > 1"))
    assert none.count() == len(urls) and url_filter.judge(pages.limit(0), outcomes).count() == 0


# 3 and 9 classifiers


@pytest.mark.parametrize("label,module,least", [("toxic", toxicity, 0.9), ("quality", quality, 0.95)])
def test_classifiers_hold_out(spark, label, module, least):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = module.score(docs, labels, ~held_out(F.col("label_id"))).join(labels.where(held_out(F.col("doc_id"))), "doc_id").toPandas()
    pos, neg = got[got[label] == 1].score.to_numpy(), got[got[label] == 0].score.to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > least and got.score.between(0, 1).all()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_odd_tables(spark, odd, empty, labels, module):
    learn = F.col("label_id") > 0
    assert module.score(odd, labels, learn).count() == len(ODD)
    assert module.score(empty, labels, learn).count() == 0
    got = module.score(odd, labels.limit(0), learn).collect()
    assert len({round(r["score"], 6) for r in got}) == 1


def test_keep_good_keeps_columns(odd, labels):
    out = quality.keep_good(odd, labels, F.col("label_id") > 0, least=0.0)
    assert out.columns == odd.columns and out.count() == len(ODD)


def plain_trees(x, y, trees, depth, rate, bins, least):
    """Boosting by loops over every feature, cut and node; the raw scores of the rows it was fitted on."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = [[sum(e < v for e in edges[j]) for j, v in enumerate(row)] for row in x]
    base = (y.sum() + 1) / (len(y) + 2)
    f = [float(np.log(base / (1 - base)))] * len(y)
    for _ in range(trees):
        p = [1 / (1 + np.exp(-v)) for v in f]
        g, h = [t - q for t, q in zip(y, p)], [q * (1 - q) for q in p]
        groups = [list(range(len(y)))]
        for _ in range(depth):
            parts = []
            for rows in groups:
                best, cut = 1e-9, None
                for j in range(x.shape[1]):
                    for k in range(bins):
                        left = [i for i in rows if b[i][j] <= k]
                        right = [i for i in rows if b[i][j] > k]
                        gl, hl, gr, hr = (sum(v[i] for i in part) for part in (left, right) for v in (g, h))
                        if hl < least / 10 or hr < least / 10:
                            continue
                        gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1)
                        if gain > best + 1e-12:
                            best, cut = gain, (j, k)
                inside = (lambda i: True) if cut is None else (lambda i, c=cut: b[i][c[0]] <= c[1])
                parts += [[i for i in rows if inside(i)], [i for i in rows if not inside(i)]]
            groups = parts
        for rows in groups:
            step = rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)
            for i in rows:
                f[i] += step
    return np.array(f)


def test_boosted_trees_equal_plain_ones():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (80, 3)).round(1)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(0, 0.5, 80) > 0.7).astype(float)
    how = {"trees": 4, "depth": 2, "rate": 0.3, "bins": 8, "least": 5.0}
    assert np.allclose(gbt.Boosted(**how).fit(x, y).raw(x), plain_trees(x, y, **how))


def test_isotonic_equals_max_min():
    rng = np.random.default_rng(7)
    raw = np.sort(rng.normal(0, 1, 40))
    y = (rng.random(40) < 1 / (1 + np.exp(-raw))).astype(float)
    mean = lambda a, b: y[a : b + 1].mean()
    plain = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    pools = [list(g) for _, g in itertools.groupby(range(40), key=lambda i: round(plain[i], 9))]
    want = np.zeros(40)
    for pool in pools:
        want[pool] = (sum(y[pool]) + 0.5) / (len(pool) + 1)
    want = np.maximum.accumulate(want)
    got = gbt.Isotonic().fit(raw, y)(raw)
    assert np.allclose(got, 0.999 * want + 0.001 / (1 + np.exp(-raw)))


def test_toxicity_equals_its_parts_by_hand(spark):
    """The distributed lexicon and scores, against plain counts and the model applied row by row."""
    rng = random.Random(9)
    rows = []
    for i in range(600):
        words = [rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(30)]
        bad = i % 3 == 0
        rows.append((i, " ".join(words + ["you", "vile"] * bad), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, F.col("label_id") >= 0, "toxic")
    found = toxicity.lexicon(sample)
    n, pos = 600, 200
    want = {}
    for word in {w for _, t, _ in rows for w in t.split()}:
        k, p = sum(word in t.split() for _, t, _ in rows), sum(word in t.split() for _, t, y in rows if y)
        odds = np.log((p + 0.5) / (pos + 1)) - np.log((k - p + 0.5) / (n - pos + 1)) - 2 / np.sqrt(p) if p >= 3 else -1
        if odds > 1:
            want[word] = odds
    assert set(found) == set(want) == {"you", "vile"} and all(abs(found[w] - want[w]) < 1e-9 for w in want)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels, F.col("label_id") % 5 > 0).collect()}
    weights, trees, calibrate = toxicity.fit(toxicity.labelled_sample(docs, labels, F.col("label_id") % 5 > 0, "toxic"))
    plain = calibrate(trees.raw(np.array([toxicity.features(t, weights) for _, t, _ in rows], float)))
    assert all(abs(got[i] - plain[i]) < 1e-9 and (got[i] > 0.5) == bool(y) for i, _, y in rows)


def test_co_training_over_all_rows(spark, docs):
    """Pseudo-labels come from rows without any label, beyond the quantiles of all scores; scores equal the model's, row by row."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    features = quality.feature_rows(table)
    plain = {r["doc_id"]: r for r in table.collect()}
    for r in features.limit(20).collect():
        d = plain[r["doc_id"]]
        assert np.allclose(r["a"], quality.text_view(d["text"]), rtol=1e-6) and np.allclose(r["b"], quality.meta_view(d["lang"], d["source"], d["n_chars"]), rtol=1e-6)
    learn = ~held_out(F.col("label_id"))
    known = {r["doc_id"] for r in labels.collect()}
    pool = features.where(~F.col("doc_id").isin(*known))
    sample = quality.labelled_sample(features, labels, learn, "quality").toPandas()
    model = quality.CoTrained([np.array(sample[c].tolist(), float) for c in "ab"], sample["y"].to_numpy(float))
    before, views = [len(t[1]) for t in model.taught], model.views
    rows = pool.toPandas()
    quality.exchange(model, pool, len(rows), 0)
    for view, column, other in ((0, "a", "b"), (1, "b", "a")):
        raw = views[view].raw(np.array(rows[column].tolist(), float))
        up, down = quality.SHARE * model.base, quality.SHARE * (1 - model.base)
        order = np.sort(raw)
        sure = (raw >= max(order[int((1 - up) * len(raw))] - 1e-3, quality.SURE)) | (raw <= min(order[int(down * len(raw))] + 1e-3, -quality.SURE))
        x, y, _ = model.taught[1 - view]
        taught = {tuple(np.round(v, 4)) for v in x[before[1 - view] :]}
        assert taught <= {tuple(np.round(v, 4)) for v in np.array(rows[other].tolist(), float)[sure]}
    got = {r["doc_id"]: r["score"] for r in quality.score(table, labels, learn).collect()}
    final = quality.train(features, labels, learn)
    want = final([np.array([quality.text_view(d["text"]) for d in plain.values()], np.float32).astype(float), np.array([quality.meta_view(d["lang"], d["source"], d["n_chars"]) for d in plain.values()], np.float32).astype(float)])
    assert all(abs(got[k] - w) < 1e-6 for k, w in zip(plain, want))


# 4 mixing


def test_raking_meets_margins(spark):
    rng = random.Random(3)
    cells = [(s, la, t, rng.randint(1, 100)) for s in "abc" for la in ("x", "y") for t in ("p", "q")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, n long")
    goal = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.5, "q": 0.5}}
    raked = mixing.rake(df, goal)
    out = raked.toPandas()
    assert (out.p <= 1).all() and ((out.w - out.n * out.p).abs() < 1e-9).all()
    for m, shares in goal.items():
        got = out.groupby(m).w.sum() / out.w.sum()
        assert all(abs(got[k] - v) < 1e-3 for k, v in shares.items())
    assert mixing.missed(raked) < 1e-3


def test_mixture_of_the_documents_meets_its_targets(docs):
    """Also where some cells are wanted more than whole: what the bound takes goes to the others."""
    raked = mixing.rake(mixing.sample(docs).groupBy(*mixing.MARGINS).agg(F.sum("n_tokens").alias("n")))
    assert mixing.missed(raked) < 1e-3 and raked.where("p > 0.999").count() > 0


def test_draws_and_empty_targets(spark):
    """Rows without an id are drawn one by one; a source that is not wanted gives nothing, not even texts without tokens."""
    rows = spark.createDataFrame([(None, f"text number {i}", "a", "x") for i in range(400)] + [(i, "", "b", "x") for i in range(20)] + [(i, "some words", None, "x") for i in range(400, 500)], "doc_id long, text string, source string, lang string")
    kept = mixing.keep_sampled(rows, targets={"source": {"a": 1.0}}, rate=0.5).collect()
    assert 100 < len(kept) < 300 and {r.source for r in kept} == {"a"}


def test_mixing_odd_tables(odd, empty):
    out = mixing.sample(odd)
    assert out.count() == len(ODD) and mixing.sample(empty).count() == 0
    kept = mixing.keep_sampled(odd)
    assert kept.columns == odd.columns and 0 < kept.count() <= len(ODD)


# 5 BPE


def digests(codec, texts):
    return list(zip(*bpe.Digester(codec)(pa.array(texts, pa.string()))))


def test_codec_equals_library(docs, odd, empty, library):
    path = queries.tokenizer_path()
    for df in (docs, odd):
        texts = [r["text"] for r in df.select("text").collect()]
        got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest_texts(df, path).collect())
        assert got == sorted(by_library(library, t) for t in texts)
    assert bpe.digest_texts(empty, path).count() == 0


@given(st.lists(st.text(alphabet=st.sampled_from("etaoin srhldcu'sm.-!éßñΣ1<|>\n\x1c\u0301"), max_size=300), max_size=5))
@settings(max_examples=150, deadline=None)
def test_codec_on_any_text(library, codec, texts):
    assert digests(codec, texts) == [by_library(library, t) for t in texts]
    for text in texts:
        assert list(codec.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_codec_on_every_code_point(library, codec):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(points), 60_000):
        texts = [f"a{chr(c)}b" for c in points[low : low + 60_000]]
        assert digests(codec, texts) == [by_library(library, t) for t in texts]


def test_long_rows_are_read_in_pieces(library, codec):
    texts = ["ab " * 60_000, "x" * 70_000, "é" * 66_000 + " end<|endoftext|>" + "q" * 70_000 + "!", "", None, "last one"]
    for limit in (1 << 24, 1 << 18):
        seen = [(r, len(t)) for rows, part in bpe.pieces(pa.array(texts), limit) for r, t in zip(rows, part.to_pylist())]
        assert [sum(n for r, n in seen if r == k) for k in range(6)] == [len(t or "") for t in texts]
    assert digests(codec, texts) == [by_library(library, t) for t in texts]
    assert [x.tolist() for x in pack.texts_ids(codec, pa.array(texts), 1 << 22)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_transducer_is_bounded(library, codec):
    rng = random.Random(5)
    for letters in ("etaoinshr", "ab", "thein"):
        word = "".join(rng.choice(letters) for _ in range(20_000))
        want = library.encode(word, add_special_tokens=False).ids
        t = bpe.WordTransducer(codec.m)
        early = [codec.m.vocab[x] for x in t.feed(word[:-1])]
        assert early == want[: len(early)] and len("".join(codec.m.text_of[k] for k in early)) > 18_000
        assert early + [codec.m.vocab[x] for x in t.finish(word[-1])] == want == list(codec.stream_word(word))
        assert t.widest <= codec.m.lookahead + 2 * codec.m.longest + bpe.STEP


@given(st.data())
@settings(max_examples=200, deadline=None)
def test_lookahead_is_sufficient(data):
    """Random merge lists: a token that ends further back than the lookahead is that of any longer text."""
    tokens, merges = ["a", "b", "c"], []
    for _ in range(data.draw(st.integers(1, 12))):
        pair = (data.draw(st.sampled_from(tokens)), data.draw(st.sampled_from(tokens)))
        if "".join(pair) not in tokens:
            tokens.append("".join(pair))
            merges.append(list(pair))
    m = bpe.Merges({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}})
    text, more = (data.draw(st.text("abc", min_size=1, max_size=30)) for _ in "xy")
    ends = lambda s: set(itertools.accumulate(map(len, m.merged(list(s)))))
    stable = len(text) - m.lookahead
    assert {e for e in ends(text) if e <= stable} == {e for e in ends(text + more) if e <= min(stable, max((e for e in ends(text) if e <= stable), default=0))}
    t = bpe.WordTransducer(m)
    assert t.feed(text[:-1]) + t.finish(text[-1]) == m.merged(list(text))


def test_hash_collisions_are_noticed(codec, library):
    """A table whose hashes name wrong tokens still gives right ids, through the words' own transducers."""
    broken = bpe.Codec(codec.m)
    for kind in broken.table.found:
        kind[3][:] = np.roll(kind[3], 1)
    assert digests(broken, ["some words here", "of the"]) == [by_library(library, t) for t in ("some words here", "of the")]


def test_decoder_joins_split_characters(codec):
    d = codec.decoder(joined=False)
    assert "".join(map(d.feed, codec.encode("日本 ok"))) + d.finish() == "日本 ok "


def test_decoder_of_a_byte_level_file():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library, m = Tokenizer.from_file(path), bpe.Merges.load(path)
    text = "Ünïcödé 日本語 🙂 \n and\tmore"
    d = bpe.Decoder(m, {c: b for b, c in enumerate(bpe.byte_alphabet())}, joined=not m.has_decoder)
    assert "".join(map(d.feed, library.encode(text).ids)) + d.finish() == text


# 6 language


def test_language_held_out(docs, odd, empty):
    got = langid.identify(docs, ~held_out(F.col("doc_id"))).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id")))
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    out = {r["doc_id"]: r for r in langid.identify(odd, F.lit(True)).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[3]["lang_pred"] == "und" and out[7]["lang_pred"] == "de"
    assert langid.identify(empty, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}


def test_letters_and_pieces():
    space = langid.Space(langid.letter_table())
    letters = np.array(sorted({int(x) for x in space.table[0x400:0x500]} - {0}))
    assert len(np.unique(langid.letter_vectors(letters, 5), axis=0)) == len(letters) >= 32
    plain = "Ünïcödé wörter über älles " * 40
    assert (space.bundle(plain) == space.bundle(unicodedata.normalize("NFD", plain))).all()
    assert all(np.allclose(space.bundle(plain, n), space.bundle(plain)) for n in (1, 7, 100))
    grams = collections.Counter()
    for w in "".join(chr(space.table[ord(c)]) if space.table[ord(c)] else " " for c in plain).split():
        padded = f"\0{w}\0"
        grams.update(padded[i : i + 3] for i in range(len(w)))
    vector = lambda c: langid.letter_vectors(np.array([ord(c)]), 5)[0].astype(float)
    want = sum(n * np.roll(vector(g[0]), 2) * np.roll(vector(g[1]), 1) * vector(g[2]) for g, n in grams.items())
    assert np.allclose(space.bundle(plain), want)


def test_language_equals_plain_sums(spark):
    rows = [(i, t * 5, la) for i, (t, la) in enumerate([("the cat and the dog ", "en"), ("der hund und die katze ", "de"), ("le chat et le chien ", "fr")] * 4)]
    space = langid.Space(langid.letter_table())
    unit = {la: [space.bundle(t) / np.linalg.norm(space.bundle(t)) for _, t, x in rows if x == la] for la in ("de", "en", "fr")}
    plain = langid.Profiles({la: np.sum(v, 0) for la, v in unit.items()})
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).collect()
    for r in got:
        lang, score = plain.predict(space.bundle(rows[r.doc_id][1]))
        assert (r.lang_pred, round(r.score, 6)) == (lang, round(score, 6)) and lang == rows[r.doc_id][2]


# 7 exact


def test_exact_groups_survive_collisions(docs, odd, empty):
    for df in (docs, odd):
        plain = sorted(map(tuple, exact_dedup.exact_groups(df).collect()))
        weak = exact_dedup.exact_groups(df, capacity=3, key=(F.length("t") % 3).cast("long"), digest=F.substring("t", 1, 2))
        assert sorted(map(tuple, weak.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == plain
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(odd).collect()}
    assert (got[5]["keep_id"], got[5]["group_size"], got[2]["keep_id"], got[3]["keep_id"]) == (4, 4, 1, 3)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(odd).columns == odd.columns and exact_dedup.drop_copies(odd).count() == 6


def test_dropping_goes_by_row_not_by_id_alone(spark):
    """Null ids and ids that stand for two texts: only the rows that are copies, or are not drawn, go."""
    many, more = (" ".join(f"{p}{i}" for i in range(60)) for p in "vw")
    rows = spark.createDataFrame([(1, many, "s"), (None, many, "s"), (None, more, "s"), (5, many, "s"), (5, "another text", "s"), (None, "only here", "t")], "doc_id long, text string, source string")
    left = [(1, many), (5, "another text"), (None, more), (None, "only here")]
    order = lambda x: sorted(x, key=str)
    assert order((r.doc_id, r.text) for r in exact_dedup.drop_copies(rows).collect()) == order(left)
    # a null id never names a component: two null rows of different texts are no group of their own
    assert order((r.doc_id, r.text) for r in simhash.drop_near_copies(rows).collect()) == order(left)
    mixed = rows.withColumn("lang", F.lit("en"))
    kept = mixing.keep_sampled(mixed, targets={"source": {"t": 1.0}, "topic": {"prose": 1.0}}, rate=1.0, headroom=1.0)
    assert [(r.doc_id, r.text) for r in kept.collect()] == [(None, "only here")]


def test_directory_doubles(spark):
    """90 entries that share their first bits, and one each of seven other prefixes of three bits."""
    rows = [(k,) for k in range(90)] + [((p << 61) - (1 << 64) * (p > 3),) for p in range(1, 8)]
    slots, depth = exact_dedup.directory(spark.createDataFrame(rows, "h long"), 10)
    found = {}
    for r in slots.collect():
        found.setdefault((r["bits"], r["bucket"]), []).append(r["slot"])
    assert depth == 8 and {k: len(v) for k, v in found.items()} == {(1, 128): 128, (2, 64): 64, (3, 32): 32, (8, 0): 1}
    assert all(min(v) == bucket for (_, bucket), v in found.items())
    slots, depth = exact_dedup.directory(spark.createDataFrame(rows[:5], "h long"), 10)
    assert depth == 0 and [(r["slot"], r["bucket"], r["bits"]) for r in slots.collect()] == [(0, 0, 0)]


def test_index_has_chains_in_order(spark):
    keys = spark.createDataFrame([(i, i % 5 - 2, f"d{i % 10}") for i in range(40)], "doc_id long, h long, digest string")
    index = exact_dedup.build_index(keys, 40, 3).collect()
    assert len(index) == 10 and all(r["chain"] == 2 and r["n"] == 4 for r in index)
    chains = {}
    for r in index:
        chains.setdefault((r["bucket"], r["h"]), []).append((r["link"], r["digest"], r["keep_id"]))
    assert len(chains) == 5 and all([link for link, *_ in sorted(c)] == [1, 2] and sorted(c) == sorted(c, key=lambda x: x[1]) for c in chains.values())


# 8 SimHash


def brute(fps, ids, radius):
    labels = simhash.Labels(len(ids))
    for i in range(len(ids)):
        j = np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i:]) <= radius) + i
        labels.link(np.full(len(j), i), j)
    return np.array(ids)[labels.of]


def test_tree_equals_brute_force(spark, docs, odd, empty):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)), base[:50] ^ np.uint64(0b1111)])
    nodes = spark.createDataFrame([(i, int(f.astype(np.int64))) for i, f in enumerate(fps)], "rep long, fp0 long")
    roots = {r["node"]: r["root"] for r in components(simhash.tree_links(nodes), 10_000).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute(fps, list(range(len(fps))), 3).tolist()
    # few top levels and small shards, so that fingerprints of the shards themselves become vantage points
    split = {r["node"]: r["root"] for r in components(simhash.tree_links(nodes, levels=1, pairs=400), 10_000).collect()}
    assert split == roots
    got = simhash.near_components(docs).toPandas().sort_values("doc_id")
    words = np.array([int(x, 16) for x in got.fingerprint], np.uint64)
    assert got.component_id.tolist() == brute(words, got.doc_id.tolist(), 3).tolist()
    rows = {r["doc_id"]: r for r in simhash.near_components(odd).collect()}
    assert rows[1]["fingerprint"] == "0" * 16 and rows[3]["component_id"] == 1 and rows[5]["component_id"] == 4
    assert simhash.near_components(empty).count() == 0


def test_shards_stay_whole_under_any_join(spark, tmp_path, monkeypatch):
    """tables of shards that are planned to be shuffled and turn out small, as at 6 GB, or are shuffled indeed."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    fps = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64)), base ^ np.uint64(0b1011)])
    rng.shuffle(fps)
    spark.createDataFrame([(i, int(f.astype(np.int64))) for i, f in enumerate(fps)], "rep long, fp0 long").repartition(16).write.parquet(str(tmp_path / "nodes"))
    nodes, want = spark.read.parquet(str(tmp_path / "nodes")), brute(fps, list(range(len(fps))), 3).tolist()
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for rows, limits in ((common.BROADCAST_ROWS, ("-1", "10MB")), (0, ("-1", "10MB")), (0, ("-1", "-1"))):
            monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
            for key, limit in zip(keys, limits):
                spark.conf.set(key, limit)
            roots = {r["node"]: r["root"] for r in components(simhash.tree_links(nodes), 10_000).collect()}
            assert [roots.get(i, i) for i in range(len(fps))] == want
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_rows_without_an_id_link_others(spark):
    """0 - 0b111 - 0b111111, the middle one known by null ids only."""
    fps = spark.createDataFrame([(5, 0), (None, 0b111), (None, 0b111), (9, 0b111111), (None, -1)], "doc_id long, fp0 long")
    got = simhash.named_components(fps, ["fp0"], lambda nodes: simhash.tree_links(nodes)).select("fp0", "first.doc_id").collect()
    assert {(r.fp0, r.doc_id) for r in got} == {(0, 5), (0b111, 5), (0b111111, 5), (-1, None)} and len(got) == 5


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "a  b c"), (None, "x y"), (None, "x y"), (None, ""), (None, None), (3, "a b c"), (7, "w")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _row int")
    kept = sorted((r.doc_id or 0, r.text or "") for r in exact_dedup.drop_copies(df).collect())
    assert kept == sorted([(1, "a b c"), (0, "x y"), (0, ""), (7, "w")]) or kept == sorted([(1, "a  b c"), (0, "x y"), (0, ""), (7, "w")])
    near = sorted((r.doc_id or 0, r.text or "") for r in simhash.drop_near_copies(df).collect())
    assert [k for k, _ in near] == [0, 0, 1, 7]


def test_hubs_are_salted(spark):
    """A hub of more links than a task joins, and a path behind it."""
    hub = spark.range(1, 6_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    path = spark.createDataFrame([(6_000, 6_001), (6_001, 6_002), (7_000, 7_001)], "a long, b long")
    got = components(hub.unionByName(path), 6_003).collect()
    assert len(got) == 6_003 and {r.root for r in got if r.node < 7_000} == {0} and {(r.node, r.root) for r in got if r.node >= 7_000} == {(7_001, 7_000)}


def test_hot_keys_are_salted(spark, odd, monkeypatch):
    """Sides that are too large to broadcast: the same rows, through salted joins."""
    rows = spark.range(1_000).select((F.col("id") % 7 * (F.col("id") % 3 > 0).cast("int")).alias("k"), "id")
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k != 6")
    plain = sorted(map(tuple, common.meet(rows, side, ["k"]).collect()), key=str)
    whole = lambda: [sorted(map(tuple, f.collect()), key=str) for f in (exact_dedup.exact_groups(odd), simhash.near_components(odd), exact_dedup.drop_copies(odd).select("doc_id"), mixing.sample(odd))]
    before = whole()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert sorted(map(tuple, common.meet(rows, side, ["k"]).collect()), key=str) == plain and whole() == before


def test_near_copies_at_similarity(spark, docs, empty):
    text = docs.where("n_chars > 1500").orderBy("doc_id").first()["text"].split()
    copies = [(10**6, " ".join(text)), (10**6 + 1, " ".join([*text[:100], "changed", *text[101:]]))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df)[0].collect()}
    assert got[10**6] == got[10**6 + 1] < 10**6
    assert simhash.similar_groups(empty)[0].count() == 0


def test_wide_fingerprints_keep_lesser_likeness_apart(spark):
    words = [f"w{i}" for i in range(2000)]
    change = lambda every: " ".join(f"x{i}" if i % every == 0 else w for i, w in enumerate(words))
    rows = [(1, " ".join(words)), (2, change(20)), (3, change(100))]  # similarity 0.6 and 0.9 with the first
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_repeats_of_a_line_do_not_part_near_copies(spark):
    rng = random.Random(5)
    rows = []
    for i, times in enumerate((0, 5, 30, 0, 5, 30)):
        if not times:
            text, line = ([f"{c}{rng.randrange(10**9)}" for _ in range(n)] for c, n in (("w", 300), ("l", 12)))
        rows.append((i, " ".join(text + line * times)))  # set similarity 0.95 with the text alone
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


def test_forest_meets_pairs_at_the_threshold(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1000):
        words = [f"w{rng.randrange(10**9)}" for _ in range(184)]
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join(f"x{rng.randrange(10**9)}" if j in (20, 60, 100, 140) else w for j, w in enumerate(words))))  # 160 of 200 shingles in common
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df, slack=6.0)[0].collect()}  # so wide that only the forest can part them
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(1000)) >= 980
    assert all(got[k] // 2 == k // 2 for k in got)


def test_forest_counts_pairs_that_differ_in_more_bits():
    p, rng = simhash.bits_apart(0.8), np.random.default_rng(2)
    for depth in (12, 18):
        trees = simhash.forest_trees(p, 512, depth, 0.99)
        differ = rng.random((4000, 512)) < p
        met = np.zeros(4000, bool)
        for _ in range(trees):
            met |= ~differ[:, rng.choice(512, depth, replace=False)].any(1)
        assert met.mean() > 0.984


def test_majority_counts_each_bit():
    rng = np.random.default_rng(3)
    for n in (1, 2, 254, 255, 256, 40_000):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert simhash.majority(h) == sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > n)


def test_components_of_long_paths(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components(edges, 200).collect()} == {0}


# 10 nearest


def plain_nearest(rows, k):
    """(query_id, rank, vec_id, score) by brute force over (vec_id, vector) rows."""
    out = []
    for i, (q, y) in enumerate(rows):
        if q % 20 == 0:
            found = sorted((-float(np.dot(x, y)), v) for j, (v, x) in enumerate(rows) if j != i)[:k]
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(found)]
    return out


def test_nearest_recall_and_odd_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    extra = [(10**6, None), (10**6 + 20, []), (10**6 + 40, [0.0] * 64), (10**6 + 60, [float("nan")] * 64), (10**6 + 80, [1.0, None] + [0.0] * 62), (10**6 + 100, [1.0])]
    both = df.unionByName(spark.createDataFrame(extra, "vec_id long, embedding array<float>")).withColumns({c: F.lit(1) for c in ("row", "v", "q", "block", "part", "rank", "score")})
    x = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect()] + [(10**6 + 100, np.eye(64)[0])]
    want = plain_nearest(x, 20)
    for size in (ann.BLOCK, 100):  # one block, and several
        got = [tuple(r) for r in ann.nearest(both, F.col("vec_id") % 20 == 0, block=size).collect()]
        assert sorted(r[:2] for r in got) == sorted(r[:2] for r in want)
        true = {(q, v): s for q, _, v, s in plain_nearest(x, len(x))}
        assert all(abs(true[q, v] - s) < 1e-9 for q, _, v, s in got)
        assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in ann.nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_takes_rows_as_candidates(spark):
    """A vec_id on many rows: each is a candidate, and a query where its id is one."""
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 0.0, 0.0]), *[(7, [0.9, 0.1, 0.0])] * 31, *[(20, [0.0, 0.0, 1.0])] * 2, *((100 + i, rng.normal(0, 0.3, 3).tolist()) for i in range(57))]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted((q, r, v, round(s, 9)) for q, r, v, s in plain_nearest([(i, np.array(v)) for i, v in rows], 20))


def test_windows_are_read_and_recall_holds():
    """Clustered and spread vectors: the arrays are read in part only, and few vectors are verified where neighbours stand out."""
    rng = np.random.default_rng(8)
    near = np.concatenate([c + rng.normal(0, 0.02, (25, 32)) for c in rng.normal(0, 0.3, (160, 32))])
    near /= np.linalg.norm(near, axis=1, keepdims=True)  # short queries have no near points: their products are far below M^2
    for x, most in ((near, 0.2), (rng.normal(0, 0.2, (4000, 32)), 0.9)):
        index = ann.ProjectedBlock(x, np.linalg.norm(x, axis=1).max(), 96, 11, 0.9, 1.5)
        asked, hits = np.arange(0, 4000, 40), 0
        for q, (found, score) in zip(asked, index.search(x[asked], asked, 20, 1.05)):
            best = set(found[np.argsort(-score)[:20]].tolist())
            true = x @ x[q]
            true[q] = -np.inf
            hits += len(best & set(np.argsort(-true)[:20].tolist()))
        assert hits >= 0.9 * 20 * len(asked) and index.read > 0 and index.verified < most * len(asked) * 4000


# queries with SQL, and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), db.execute(queries.ORACLE_SQL[name]).df()
    rows = lambda f: sorted(repr([None if v != v else v for v in r]) for r in f[sorted(f.columns)].astype(object).where(f.notna(), None).values.tolist())
    assert rows(got) == rows(want)


def test_pipeline_stages(spark, sf_dir, library):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for (name, stage), n in zip(cp.STAGES, range(len(cp.STAGES))):
        before, docs = docs, cp.spill(stage(spark, docs, sf_dir), name)
        if n < 4:
            assert docs.columns == before.columns
            assert docs.join(before, docs.columns, "left_anti").isEmpty()
        if n == 1:
            assert docs.count() == before.select(exact_dedup.normalised(F.col("text"))).distinct().count()
        if n == 2:
            left = {r["doc_id"]: frozenset(zip(*(r["text"].lower().split()[k:] for k in range(5)))) for r in docs.select("doc_id", "text").collect()}
            pairs = [(a, b) for (a, x), (b, y) in itertools.combinations(left.items(), 2) if x and y and len(x & y) >= 0.85 * len(x | y)]
            assert not pairs
    assert sorted(r["ids_sha256"] for r in docs.collect()) == sorted(by_library(library, r["text"])[1] for r in before.select("text").collect())


def test_pipeline_on_odd_and_empty_tables(spark, sf_dir, odd, empty):
    import corpus_pipeline as cp

    for df in (odd, empty):
        docs = df
        for n, (name, stage) in enumerate(cp.STAGES):
            before, docs = docs, cp.spill(stage(spark, docs, sf_dir), name)
            assert docs.count() <= before.count()
            if n < 4:
                assert docs.columns == df.columns
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_mixture_stage_equals_the_operator(spark, docs):
    """What stays is what ``sample`` draws, row by row, and what a plain raking would."""
    drawn = {r["doc_id"] for r in mixing.sample(docs).where("kept").collect()}
    assert {r["doc_id"] for r in mixing.keep_sampled(docs).collect()} == drawn
    rows = mixing.sample(docs).toPandas()
    cells = rows.groupby(list(mixing.MARGINS)).n_tokens.sum().astype(float)
    n = cells.to_dict()
    total, aims, rate = sum(n.values()), [], mixing.RATE
    for i, m in enumerate(mixing.MARGINS):
        own = cells.groupby(level=i).sum()
        power = (own / total) ** mixing.TEMPER[m]
        share = np.minimum(power / power.sum(), mixing.BOOST * own / total)
        aims.append((share / share.sum()).to_dict())
        rate = min(rate, mixing.HEADROOM * min(own[v] / total / t for v, t in aims[-1].items()))
    w = {c: v * rate for c, v in n.items()}
    for _ in range(mixing.ROUNDS):
        for i in range(3):
            sums = collections.Counter()
            for c, v in w.items():
                sums[c[i]] += v
            w = {c: min(n[c], v * aims[i][c[i]] * rate * total / sums[c[i]]) if sums[c[i]] else v for c, v in w.items()}
    for r in rows.itertuples():
        c = (r.source, r.lang, r.topic)
        assert abs(r.probability - (w[c] / n[c] if n[c] else rate)) < 1e-8
