"""Keyword search: literal queries, positional postings in blocks, weighted BM25 top k and snippets.

An index is a table, to be written once and searched often, and two views.

- postings: a row for a term and an article, with the article's block and length, the weighted frequency and the places. Each
  file holds the articles of a task, by term, so that a search reads the parts of its terms.
- lengths: each article's block and length, kept as postings of a name that no token has.
- bounds: of a term's articles in a block the number, the largest frequency and the least length; read from the postings of
  a search's terms, without ids and places.

An article's block follows from its own length and id (lengths within a factor of 2^(1/4), ``splits`` blocks of each), so a
new article adds rows to its block alone, and the articles of a block have like scores. Best results are found in two
rounds: the ``limit`` blocks of each query with the largest bounds give a score that the last result has at least, then only
blocks whose bound reaches it are read. Phrases become postings of their own by meeting the places of their words.
All of it takes a table of queries; one query is a table of one row.
"""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryspark.functions.text import ascii_lower, safe_relative
from quarryspark.operators.schemas import EngineError
from quarryspark.operators.scratch import kept

#: Column weights and BM25 constants.
WEIGHTS = {"title": 10.0, "aliases": 5.0, "body": 1.0}
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
MAX_QUERY_BYTES, MAX_LIMIT, SNIPPET_TOKENS = 4096, 100, 24
TOKEN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*"
#: A place is a column's number times this, plus the token's number in the column.
COLUMN = 1 << 29
#: Every article's posting of this term holds its length, and the starts of its body's sentences; no token has this name.
SENTENCE = "."
#: Blocks for articles of about the same length. More of them keep blocks small in a large index.
SPLITS = 16


def _fold_table() -> tuple[str, str]:
    """Lower-case letters and what they are folded to: Latin ones with marks to their ASCII letter, variants of others by case folding.

    Derived by rule: a letter's decomposition up to U+024F and U+1E00-U+1EFF, and one-letter case folds below U+2000.
    """
    fold_to = {}
    for cp in (*range(0xB5, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        c = chr(cp).lower()
        other = c.casefold() if len(c.casefold()) == 1 else c
        if len(c) == 1:
            base = unicodedata.normalize("NFD", other)[0]
            latin = base.isascii() and base.isalpha() and (cp < 0x250 or 0x1E00 <= cp < 0x1F00)
            if (latin and base != c) or other != c:
                fold_to[c] = base if latin else other
    return "".join(fold_to), "".join(fold_to.values())


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    src, dst = _fold_table()
    return F.regexp_replace(F.translate(F.lower(text), src, dst), r"\p{Mn}+", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def fold_py(text: str) -> str:
    out = text.lower().translate(str.maketrans(*_fold_table()))
    return "".join(c for c in out if unicodedata.category(c) != "Mn")


def literal_terms(query: str) -> list[list[str]]:
    """Phrases that must all occur. ASCII signs separate words; a word with other separators inside is a phrase."""
    if len(query.encode("utf-8")) > MAX_QUERY_BYTES:
        raise EngineError("invalid_query", "query is too long")
    words = regex.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", query)
    if not words:
        raise EngineError("invalid_query", "query has no searchable terms")
    return [regex.findall(r"[\p{L}\p{N}\p{Co}]+", fold_py(w)) for w in words]


def _chunks(text: Column) -> Column:
    """Each token with the separators before it."""
    return F.regexp_extract_all(text, F.lit(rf"[^\p{{L}}\p{{N}}\p{{Co}}]*{TOKEN}"), F.lit(0))


def _sentences(body: Column) -> Column:
    """Numbers of the tokens that start a sentence: the first, and those behind a full stop or colon and white space."""
    starts = F.transform(_chunks(body), lambda c, i: F.when((i == 0) | c.rlike(r"[.:][ \t\n\r]+[\p{L}\p{N}\p{Co}]"), i))
    return F.filter(starts, lambda i: i.isNotNull())


def _weighted(places: Column) -> Column:
    """Weighted frequency of a term with these places."""
    weights = F.array(*(F.lit(w) for w in WEIGHTS.values()))
    return F.aggregate(places, F.lit(0.0), lambda a, p: a + F.get(weights, F.shiftright(p, 29)))


class Index(NamedTuple):
    postings: DataFrame  # term, block, article_id, dl, f, places

    @property
    def lengths(self) -> DataFrame:
        return self.postings.where(F.col("term") == SENTENCE).select("article_id", "block", "dl")

    @property
    def bounds(self) -> DataFrame:
        return self.postings.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("f_max"), F.min("dl").alias("dl_min"))


def stored(index: Index) -> Index:
    """The index, written. Nothing is shuffled."""
    return Index(kept(index.postings.sortWithinPartitions("term", "block"), "postings"))


def _article_postings(sized: DataFrame) -> DataFrame:
    """(term, block, article_id, dl, f, places) of each row's tokens: an article's own places meet where it is read."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = sized.schema["article_id"].dataType.simpleString()
    out = f"term string, block long, article_id {kind}, dl long, f double, places array<int>"
    schema, column, names = to_arrow_schema(_parse_datatype_string(out)), COLUMN, tuple(WEIGHTS)
    weights, sentence = np.array([*WEIGHTS.values()]), SENTENCE
    sized.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))

    def run(batches):
        for batch in batches:
            # places and terms of all columns, by row, then column
            rows, places, terms = [], [], []
            for nth, name in enumerate(names):
                found = batch.column(name)
                starts = found.offsets.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(found)), np.diff(starts))
                own = np.arange(len(row)) - (starts - starts[0])[row]
                if len(own) and own.max() >= column:
                    raise OverflowError("a text has too many tokens")
                rows.append(row)
                places.append(own + nth * column)
                terms.append(found.flatten())
            row, place = np.concatenate(rows), np.concatenate(places)
            at = batch.column("sentences")
            lists = pa.ListArray.from_arrays(pa.array(at.offsets.to_numpy() - at.offsets[0].as_py()), pa.array((at.flatten().to_numpy(zero_copy_only=False) + (len(names) - 1) * column).astype(np.int32)))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([sentence] * n, pa.string()), batch.column("block"), batch.column("article_id"), batch.column("dl"), pa.array(np.zeros(n)), lists], schema=schema)
            if not len(row):
                continue
            coded = pa.chunked_array(terms, pa.string()).combine_chunks().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(row * len(coded.dictionary) + code, kind="stable")
            row, code, place = row[order], code[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]))
            of = pa.array(row[first])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(row)]]), pa.int32()), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), batch.column("block").take(of), batch.column("article_id").take(of), batch.column("dl").take(of), pa.array(np.add.reduceat(weights[place >> 29], first)), lists], schema=schema)

    return sized.mapInArrow(run, out)


def build_index(articles: DataFrame, splits: int = SPLITS, only: list[str] | None = None) -> Index:
    """The index of (article_id, title, aliases, body). only: the postings of these terms."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in WEIGHTS}
    by = articles.select("article_id", *(tokens(text[c]).alias(c) for c in WEIGHTS), _sentences(text["body"]).alias("sentences"))
    sized = by.withColumn("dl", sum((F.size(c) for c in WEIGHTS), F.lit(0)).cast("long"))
    block = F.floor(F.log2(F.col("dl") + 1) * 4) * splits + F.pmod(F.xxhash64(F.col("article_id").cast("string")), F.lit(splits))
    sized = sized.withColumn("block", block.cast("long"))
    postings = _article_postings(sized)
    if only is not None:
        postings = postings.where(F.col("term").isin(SENTENCE, *only))
    return Index(postings)


def phrases_of(queries: DataFrame) -> DataFrame:
    """query_id, phrase_no, tokens and key of each phrase of (query_id, query): a word with its signs is one.

    Queries that are too long or have no words are none; ``refused`` names them.
    """
    words = F.regexp_extract_all("query", F.lit(r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"), F.lit(0))
    fine = queries.where(F.octet_length("query") <= MAX_QUERY_BYTES).select("query_id", F.posexplode(words).alias("phrase_no", "word"))
    return fine.select("query_id", "phrase_no", tokens(F.col("word")).alias("tokens")).withColumn("key", F.array_join("tokens", "\0"))


def refused(queries: DataFrame) -> DataFrame:
    """query_id and issue of the queries that can't be searched."""
    long = F.octet_length("query") > MAX_QUERY_BYTES
    issue = F.when(long, "query is too long").when(~F.coalesce("query", F.lit("")).rlike(r"[A-Za-z0-9\x{80}-\x{10FFFF}]"), "query has no searchable terms")
    return queries.select("query_id", issue.alias("issue")).where("issue IS NOT NULL")


def phrase_postings(index: Index, phrases: DataFrame) -> DataFrame:
    """Postings of phrases (key, tokens), from those of their tokens: places that follow each other, in the same column.

    Of an article that lacks a phrase's rarest token no places are read.
    """
    parts = phrases.select("key", F.size("tokens").alias("width"), F.posexplode("tokens").alias("nth", "term"))
    known = index.postings.join(parts.select("term").distinct(), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    rarest = parts.join(known, "term").groupBy("key").agg(F.min(F.struct("n_t", "nth", "term"))["term"].alias("term"))
    # written, so that its size is known where it is joined
    holders = kept(index.postings.join(rarest, "term").select("key", "article_id"), "holders")
    rows = index.postings.join(parts, "term").join(holders, ["key", "article_id"])
    shifted = rows.select("key", "block", "width", "article_id", "dl", F.transform("places", lambda p: p - F.col("nth")).alias("places"))
    whole = shifted.groupBy("key", "block", "width", "article_id", "dl").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == F.col("width"))
    found = whole.withColumn("places", F.sort_array(F.aggregate("lists", F.get("lists", F.lit(0)), F.array_intersect))).where(F.size("places") > 0)
    weights = F.array(*(F.lit(w) for w in WEIGHTS.values()))
    f = F.aggregate("places", F.lit(0.0), lambda a, p: a + F.get(weights, F.shiftright(p, 29)))
    return found.select(F.col("key").alias("term"), "block", "article_id", "dl", f.alias("f"), "places")


def entries_of(index: Index, asked: DataFrame) -> Index:
    """The index of all keys of phrases_of()."""
    postings = index.postings.join(asked.select(F.col("key").alias("term")).distinct(), "term", "left_semi")
    phrases = asked.where(F.size("tokens") > 1).select("key", "tokens").distinct()
    if not phrases.isEmpty():
        postings = postings.unionByName(kept(phrase_postings(index, phrases), "phrases"))
    return Index(postings)


def _gain(f: Column, dl: Column) -> Column:
    """A term's share of the score: grows with f, falls with dl."""
    return F.col("times") * F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / F.col("avgdl")))


class Ranking:
    """Best articles for each query of a table, and which blocks are read for them."""

    def __init__(self, index: Index, asked: DataFrame, limit: int):
        self.limit, self.entries = limit, entries_of(index, asked)  # without the articles' own postings
        stats = F.broadcast(index.lengths.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl")))  # one row
        times = asked.groupBy("query_id", F.col("key").alias("term")).agg(F.count(F.lit(1)).alias("times"))
        self.needed = asked.groupBy("query_id").agg(F.count_distinct("key").alias("needed"))
        cells = self.entries.bounds
        n_t = cells.groupBy("term").agg(F.sum("n").alias("n_t"))
        idf = F.log((F.col("N") - F.col("n_t") + 0.5) / (F.col("n_t") + 0.5))
        # written, as every later step reads them: a row for a query's term, and one for a query's block
        self.terms = kept(times.join(n_t, "term").join(stats).withColumn("idf", F.when(idf <= 0, IDF_FLOOR).otherwise(idf)).drop("N", "n_t"), "terms")
        bounds = cells.join(self.terms, "term").withColumn("gain", _gain(F.col("f_max"), F.col("dl_min")))
        whole = bounds.groupBy("query_id", "block").agg(F.count(F.lit(1)).alias("c"), F.sum("gain").alias("bound"), F.min("n").alias("most"), F.sum("n").alias("postings"))
        #: Blocks that hold all terms of a query.
        self.blocks = kept(whole.join(self.needed, "query_id").where("c = needed").drop("c", "needed"), "blocks")

    def scores(self, blocks: DataFrame) -> DataFrame:
        """query_id, article_id and score of the articles with all terms in these (query_id, block)."""
        cells = blocks.select("query_id", "block").join(self.terms, "query_id")
        rows = self.entries.postings.join(cells, ["term", "block"])
        summed = rows.groupBy("query_id", "article_id").agg(F.count(F.lit(1)).alias("c"), F.sum(_gain(F.col("f"), F.col("dl"))).alias("score"))
        return summed.join(self.needed, "query_id").where("c = needed").select("query_id", "article_id", "score")

    def _best(self, rows: DataFrame, n: int, *order: Column) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("nth") <= n)

    def chosen(self) -> DataFrame:
        """The blocks whose articles can be among the best ones."""
        seeds = self._best(self.blocks, self.limit, F.desc("bound"), F.col("block"))
        sure = self._best(self.scores(seeds), self.limit, F.desc("score")).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("c")).where(F.col("c") == self.limit)
        reach = F.col("bound") * (1 + 1e-9) >= F.coalesce("least", F.lit(float("-inf")))
        return self.blocks.join(sure.select("query_id", "least"), "query_id", "left").where(reach)

    def top(self, articles: DataFrame) -> DataFrame:
        """query_id, rank, article_id, title and relevance; equal relevance (to 12 digits) goes by title, then id."""
        # sums of the same parts in another order must tie
        unit = F.pow(F.lit(10.0), 11 - F.floor(F.log10("score")))
        scored = self.scores(self.chosen()).select("query_id", "article_id", (-F.round(F.col("score") * unit) / unit).alias("relevance"))
        near = scored.withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy("relevance"))).where(F.col("place") <= self.limit)
        titled = near.join(articles.select("article_id", "title"), "article_id")
        best = self._best(titled, self.limit, F.col("relevance"), ascii_lower(F.col("title")), F.col("article_id"))
        return best.select("query_id", F.col("nth").alias("rank"), "article_id", "title", "relevance")

    def skipping(self) -> DataFrame:
        """For each query: blocks and postings of articles' blocks that hold all terms, and how many of them are read."""
        both = self.blocks.join(self.chosen().select("query_id", "block", F.lit(1).alias("read")), ["query_id", "block"], "left")
        n = F.coalesce("read", F.lit(0))
        return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(n).alias("blocks_read"), F.sum("postings").alias("postings"), F.sum(n * F.col("postings")).alias("postings_read"))


def _checked(limit: int) -> None:
    if not 1 <= limit <= MAX_LIMIT:
        raise EngineError("invalid_query", "limit must be between 1 and 100")


def search_many(articles: DataFrame, queries: DataFrame, limit: int = 20, index: Index | None = None) -> DataFrame:
    """The best articles of each of (query_id, query): query_id, rank, article_id, title, relevance."""
    _checked(limit)
    return Ranking(index or stored(build_index(articles)), phrases_of(queries), limit).top(articles)


def search(articles: DataFrame, query: str, limit: int = 20, index: Index | None = None, snippets: bool = False) -> DataFrame:
    """article_id, title, relevance (smaller is better) of the articles with every term, best first."""
    _checked(limit)
    literal_terms(query)
    asked = phrases_of(articles.sparkSession.createDataFrame([(0, query)], "query_id int, query string"))
    own = asked.select("tokens").collect()  # of one query
    names = sorted({t for r in own for t in r["tokens"]})
    index = index or stored(build_index(articles, only=names))
    own_terms = F.col("term").isin(SENTENCE, *names)  # pushed down to the scans
    index = index._replace(postings=index.postings.where(own_terms))
    top = Ranking(index, asked, limit).top(articles)
    if snippets:
        shown = cut(articles, index, asked, top.select("query_id", "article_id"))
        return top.join(shown, ["query_id", "article_id"]).orderBy("rank").select("article_id", "title", "relevance", "snippet")
    return top.orderBy("rank").select("article_id", "title", "relevance")


def cut(articles: DataFrame, index: Index, asked: DataFrame, matches: DataFrame, size: int = SNIPPET_TOKENS, mark: tuple[str, str] = ("[", "]"), more: str = " ... ") -> DataFrame:
    """query_id, article_id and snippet of the body, for (query_id, article_id) and phrases_of() their queries.

    Windows start at each hit, centred around the hits in them, or at its sentence. One with more distinct phrases is better,
    then one with more hits; a sentence counts 100 more, the body's start 120; the first of equal ones wins.
    """
    nth = len(WEIGHTS) - 1
    in_body = lambda rows: rows.where(F.shiftright("place", 29) == nth).withColumn("first", (F.col("place") - nth * COLUMN).cast("int"))
    listed = entries_of(index, asked).postings.select("term", "article_id", F.explode("places").alias("place"))
    width = asked.select("query_id", F.col("key").alias("term"), "phrase_no", F.size("tokens").alias("width"))
    hits = in_body(listed.join(width, "term").join(matches, ["query_id", "article_id"], "left_semi")).select("query_id", "article_id", "first", "phrase_no", (F.col("first") + F.col("width") - 1).alias("last"))
    starts = index.postings.where(F.col("term") == SENTENCE).select("article_id", F.explode("places").alias("place"))
    starts = in_body(matches.join(starts, "article_id")).select("query_id", "article_id", "first")
    bodies = articles.select("article_id", F.coalesce("body", F.lit("")).alias("body")).join(matches, "article_id").withColumn("chunks", _chunks(F.col("body"))).withColumn("size", F.size("chunks"))

    # sentences' starts and hits as one stream of events; what lies in the window from each
    events = hits.unionByName(starts, allowMissingColumns=True)
    own = Window.partitionBy("query_id", "article_id")
    ahead = own.orderBy("first").rangeBetween(0, size - 1)
    distinct = F.size(F.collect_set("phrase_no").over(ahead))
    seen = events.withColumn("score", 999 * distinct + F.count("phrase_no").over(ahead)).withColumn("ends", F.max(F.when(F.col("phrase_no").isNotNull(), F.struct("first", "phrase_no", "last"))).over(ahead)["last"] + 1)
    is_start = F.col("phrase_no").isNull()
    before = own.orderBy("first", F.col("phrase_no").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    told = seen.withColumn("sentence", F.last(F.when(is_start, F.struct("first", "score")), ignorenulls=True).over(before)).where(~is_start)
    told = told.join(bodies.select("query_id", "article_id", "size"), ["query_id", "article_id"])
    centred = F.col("first") - F.expr(f"({size} - (ends - first)) div 2").cast("int")
    centred = F.greatest(F.least(centred, F.col("size") - size), F.lit(0))
    bonus = F.when(F.col("sentence.first") == 0, 120).otherwise(100)
    offered = F.array(
        F.struct(F.col("score").alias("score"), (-F.col("first")).alias("a"), (-F.col("phrase_no")).alias("b"), F.lit(1).alias("c"), centred.alias("at")),
        F.when((F.col("size") > size) & (F.col("sentence.first") < F.col("first")), F.struct((F.col("sentence.score") + bonus).alias("score"), (-F.col("first")).alias("a"), (-F.col("phrase_no")).alias("b"), F.lit(0).alias("c"), F.col("sentence.first").alias("at"))),
    )
    best = told.groupBy("query_id", "article_id").agg(F.max(F.array_max(offered))["at"].alias("at"))

    # hits that overlap are one mark
    earlier = own.orderBy("first", "phrase_no").rowsBetween(Window.unboundedPreceding, -1)
    joined = hits.withColumn("new", (F.col("first") > F.coalesce(F.max("last").over(earlier), F.lit(-1))).cast("int"))
    joined = joined.withColumn("group", F.sum("new").over(own.orderBy("first", "phrase_no").rowsBetween(Window.unboundedPreceding, 0)))
    marks = joined.groupBy("query_id", "article_id", "group").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    stop = F.col("at") + size - 1
    shown = marks.join(best, ["query_id", "article_id"]).where((F.col("first") >= F.col("at")) & (F.col("first") <= stop))
    shown = shown.groupBy("query_id", "article_id").agg(F.collect_set("first").alias("opened"), F.collect_set(F.least("last", stop)).alias("closed"))

    found = bodies.join(best, ["query_id", "article_id"], "left").join(shown, ["query_id", "article_id"], "left").fillna(0, ["at"])

    def piece(chunk: Column, i: Column) -> Column:
        place = F.col("at") + i
        word = F.regexp_extract(chunk, rf"{TOKEN}$", 0)
        gap = F.when((i == 0) & (F.col("at") > 0), "").otherwise(F.substring(chunk, F.lit(1), F.length(chunk) - F.length(word)))
        has = lambda c: F.coalesce(F.array_contains(c, place), F.lit(False))
        return F.concat(gap, F.when(has("opened"), mark[0]).otherwise(""), word, F.when(has("closed"), mark[1]).otherwise(""))

    text = F.array_join(F.transform(F.slice("chunks", F.col("at") + 1, F.lit(size)), piece), "")
    rest = F.substr("body", F.aggregate("chunks", F.lit(1), lambda a, c: a + F.length(c)))
    whole = F.concat(F.when(F.col("at") > 0, more).otherwise(""), text, F.when(stop >= F.col("size") - 1, rest).otherwise(more))
    return found.select("query_id", "article_id", whole.alias("snippet"))


def with_paths(found: DataFrame, articles: DataFrame) -> DataFrame:
    """Results with their article's path, and whether it is a safe relative one; in the order of the results."""
    joined = found.join(articles.select("article_id", "vault_path"), "article_id")
    columns = [c for c in ("article_id", "title", "vault_path", "snippet", "relevance") if c in joined.columns]
    return joined.select(*columns, safe_relative(F.col("vault_path")).alias("safe")).orderBy("relevance", ascii_lower(F.col("title")), "article_id")


def snippet(body: str, phrases: list[list[str]], size: int = SNIPPET_TOKENS, mark: tuple[str, str] = ("[", "]"), more: str = " ... ") -> str:
    """What ``cut`` gives, for one text and folded phrases."""
    spans = [(m.start(), m.end()) for m in regex.finditer(TOKEN, body)]
    words, n = [fold_py(body[a:b]) for a, b in spans], len(spans)
    hits = sorted((i, k, i + len(p) - 1) for k, p in enumerate(phrases) for i in range(n - len(p) + 1) if p and words[i : i + len(p)] == p)
    starts = [i for i in range(n) if not i or regex.search(r"[.:][ \t\n\r]+$", body[spans[i - 1][1] : spans[i][0]])]
    offers = [(0, 0, 0, 0, 0)]
    for first, k, _ in hits:
        inside = lambda at: [h for h in hits if at <= h[0] < at + size]
        score = lambda at: 999 * len({h[1] for h in inside(at)}) + len(inside(at))
        spare = size - (inside(first)[-1][2] + 1 - first)
        offers.append((score(first), -first, -k, 1, max(0, min(first - int(spare / 2), n - size))))
        sentence = max(s for s in starts if s <= first)
        if n > size and sentence < first:
            offers.append((score(sentence) + (100 if sentence else 120), -first, -k, 0, sentence))
    best = max(offers)[4]
    stop, marks = best + size - 1, []
    for first, _, last in hits:
        if marks and first <= marks[-1][1]:
            marks[-1][1] = max(marks[-1][1], last)
        else:
            marks.append([first, last])
    out, at = more if best else "", spans[best][0] if best else 0
    for first, last in marks:
        if best <= first <= stop:
            a, b = spans[first][0], spans[min(last, stop)][1]
            out, at = out + body[at:a] + mark[0] + body[a:b] + mark[1], b
    return out + (body[at:] if stop >= n - 1 else body[at : spans[stop][1]] + more)
