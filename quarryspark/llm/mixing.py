"""Mixing by iterative proportional fitting; built-in functions only.

Token weights are summed by cell (source, language, topic). Each round rakes the cells to the
source, then the language, then the topic marginals: every margin's cells are multiplied by its
target over its present sum, and none rises above its own tokens, so that what the bound takes from
one cell goes to the others of its margin in the next round. A document is kept with its cell's
probability, raked over own tokens; the draw is a hash of doc_id and text, so a run repeats itself and any
task may be lost.

Targets. By default a margin's target shares are its observed shares to the power
``temper`` (1 leaves them, 0 makes them equal), but at most ``BOOST`` times them before they are made to add
up again, so that a value of a few tokens does not decide how much of the others may stay; ``targets`` gives
shares outright, in which case values that it does not name get none. ``rate`` is the share of tokens to keep, or less where a
sample without repeats could not meet the targets: a value with share s of the tokens and target t
allows s / t at most, and ``HEADROOM`` of the least of these is taken. ``missed`` says how far from
its targets a mixture is.

Topic: by content, the family of signs that is densest over the whole text.

Cells are aggregated by task first, so a source that holds a third of all rows is a few rows. Raking
is a chain of windows over the cells, which are dealt to one task for each ``CELLS`` of them; one task
needs no shuffle. Documents meet their cell in a join of the cells' side, broadcast if it is counted
to be small, and are filtered where they are: no text moves unless the cells are many.

Edge cases: a null source or language is a value like any other; null and empty texts have no
tokens; a cell without tokens has probability ``rate``, or 0 if a target of its is 0; repeated rows
are drawn alike, rows of one or no doc_id with other texts are not; texts are read whole; equal draws
and probabilities are no ties (a draw is kept if below); an empty table gives an empty result; other
columns are ignored, and passed on by ``keep_sampled``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryspark.llm.common import discard, sized, spill

MARGINS = ("source", "lang", "topic")
#: Powers of observed shares that make the default targets; rounds; share of tokens to keep, at most; share of what targets allow.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.9}
ROUNDS, RATE, HEADROOM, SEED = 24, 0.8, 0.95, "mix"
#: Times its observed share that a value is aimed at, at most.
BOOST = 1.4
#: Topic -> its signs; a topic needs a sign for every ``DENSE`` characters.
TOPICS = {"data": "0123456789|", "markup": "#$%&*<>{}", "talk": "?!\""}
DENSE = 40
#: Cells of a task; rounds of a job.
CELLS, JOB = 1_000_000, 6


def n_tokens(text: Column) -> Column:
    """Words: runs of other characters than white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def topic_of(text: Column) -> Column:
    signs = F.regexp_replace(text, "[^" + "".join(TOPICS.values()) + "]+", "")
    size = F.length(text)
    density = {t: F.length(signs) - F.length(F.translate(signs, own, "")) for t, own in TOPICS.items()}
    best = F.greatest(*density.values())
    out = F.when(best * DENSE < F.greatest(size, F.lit(1)), F.lit("prose"))
    for t, n in density.items():
        out = out.when(n == best, F.lit(t))
    return out


def _aimed(cells: DataFrame, total: float, targets: dict[str, dict[str, float]], temper: dict[str, float]) -> tuple[DataFrame, float]:
    """cells with the target shares t_source, t_lang, t_topic; the largest rate that each margin allows by itself."""
    room = 1.0
    for m in MARGINS:
        own = cells.groupBy(m).agg(F.sum("n").alias("own"))
        if m in targets:
            given = targets[m]
            share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), F.col(m)), F.lit(0.0)) if given else F.lit(0.0)
        else:
            power = F.pow(F.col("own") / total, F.lit(temper[m]))
            sum_of = own.agg(F.sum(power)).first()[0] or 1.0
            share = F.least(power / sum_of, BOOST * F.col("own") / total)
        own = own.withColumn("share", share.cast("double"))
        whole, least = own.agg(F.sum("share"), F.min(F.when(F.col("share") > 0, F.col("own") / total / F.col("share")))).first()
        whole = whole or 1.0
        room = min(room, (1.0 if least is None else least) * whole)
        own = own.select(F.col(m).alias(f"_{m}"), (F.col("share") / whole).alias(f"t_{m}"))
        cells = cells.join(own, cells[m].eqNullSafe(own[f"_{m}"])).drop(f"_{m}")
    return cells, room


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] = TEMPER, rate: float = RATE, rounds: int = ROUNDS, headroom: float = HEADROOM) -> DataFrame:
    """source, lang, topic, n -> the same, the target shares, raked weight ``w`` and probability ``p``."""
    cells = spill(cells.groupBy(*MARGINS).agg(F.sum("n").alias("n")).select(*MARGINS, F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("n")), "cells", dealt=True)
    count, total = cells.agg(F.count(F.lit(1)), F.sum("n")).first()
    aimed, room = _aimed(cells, total or 1.0, targets or {}, temper)
    rate = min(rate, headroom * room) if total else rate
    now = aimed.withColumn("w", F.col("n") * rate)
    for first in range(0, rounds if total else 0, JOB):
        before, now = now, now.coalesce(1) if count <= CELLS else now.repartition(-(-count // CELLS), *MARGINS)
        for _ in range(first, min(first + JOB, rounds)):
            for m in MARGINS:
                sums = F.sum("w").over(Window.partitionBy(m))
                now = now.withColumn("w", F.least("n", F.when(sums > 0, F.col("w") * (F.col(f"t_{m}") * (rate * total) / sums)).otherwise(F.col("w"))))
        now = spill(now, "raked", count)
        if first:
            discard(before)
    aim = F.least(*(F.col(f"t_{m}") for m in MARGINS))
    return now.withColumn("p", F.when(F.col("n") > 0, F.col("w") / F.col("n")).when(aim > 0, rate).otherwise(0.0))


def missed(raked: DataFrame) -> float:
    """The largest difference between a margin's expected share of the sample and its target share."""
    whole = raked.agg(F.sum("w")).first()[0]
    if not whole:
        return 0.0
    return max(raked.groupBy(m).agg(F.abs(F.sum("w") / whole - F.first(f"t_{m}")).alias("off")).agg(F.max("off")).first()[0] for m in MARGINS)


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of doc_id and text (52 bits of SHA-256)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("none")), F.lit(":"), F.sha2(text, 256))
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n"))


def _of_cell(raked: DataFrame) -> DataFrame:
    """The join's side of cells; names that can't clash."""
    return sized(raked.select(*(F.col(m).alias(f"_cell_{m}") for m in MARGINS), F.col("p").alias("_cell_p")))


def sample(df: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] = TEMPER, rate: float = RATE, rounds: int = ROUNDS, seed: str = SEED, headroom: float = HEADROOM) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, kept of every row of (doc_id, text, source, lang)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = spill(df.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic_of(text).alias("topic"), n_tokens(text).cast("long").alias("n_tokens"), draw(F.col("doc_id"), text, seed).alias("draw")), "rows")
    cell = _of_cell(rake(_cells(rows), targets, temper, rate, rounds, headroom))
    same = rows["source"].eqNullSafe(cell["_cell_source"]) & rows["lang"].eqNullSafe(cell["_cell_lang"]) & (rows["topic"] == cell["_cell_topic"])
    return rows.join(cell, same).select("doc_id", *MARGINS, "n_tokens", F.round("_cell_p", 9).alias("probability"), (F.col("draw") < F.col("_cell_p")).alias("kept"))


def keep_sampled(df: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] = TEMPER, rate: float = RATE, rounds: int = ROUNDS, seed: str = SEED, headroom: float = HEADROOM) -> DataFrame:
    """The rows of ``df`` that are drawn, with all of their columns."""
    text = F.coalesce(df["text"].cast("string"), F.lit(""))
    own = {"source": df["source"].cast("string"), "lang": df["lang"].cast("string"), "topic": topic_of(text)}
    rows = df.select(*(c.alias(m) for m, c in own.items()), n_tokens(text).cast("long").alias("n_tokens"))
    cell = _of_cell(rake(_cells(rows), targets, temper, rate, rounds, headroom))
    same = (draw(df["doc_id"], text, seed) < cell["_cell_p"]) & (own["topic"] == cell["_cell_topic"])
    for m in ("source", "lang"):
        same = same & own[m].eqNullSafe(cell[f"_cell_{m}"])
    return df.join(cell, same, "left_semi")


def oracle(temper: dict[str, float] = TEMPER, rate: float = RATE, rounds: int = ROUNDS, seed: str = SEED) -> str:
    density = {t: f"(length(t) - length(translate(t, '{s}', '')))" for t, s in TOPICS.items()}
    best = f"greatest({', '.join(density.values())})"
    topic = f"CASE WHEN {best} * {DENSE} < greatest(length(t), 1) THEN 'prose' " + " ".join(f"WHEN {n} = {best} THEN '{t}'" for t, n in density.items()) + " END"
    steps, last = [], "start"
    for r in range(rounds):
        for m in MARGINS:
            name = f"r{r}_{m}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (least(n, CASE WHEN sum(w) OVER (PARTITION BY {m}) > 0 THEN w * (t_{m} * (rate * (SELECT n FROM total)) / sum(w) OVER (PARTITION BY {m})) ELSE w END) AS w) FROM {last})")
            last = name
    goals = ", ".join(f"power_{m} AS (SELECT {m}, sum(n) AS own, pow(sum(n) / (SELECT n FROM total), {temper[m]}) AS power FROM cells GROUP BY {m}), share_{m} AS (SELECT {m}, own, least(power / (SELECT sum(power) FROM power_{m}), {BOOST} * own / (SELECT n FROM total)) AS share FROM power_{m}), whole_{m} AS (SELECT sum(share) AS whole, min(own / (SELECT n FROM total) / share) FILTER (share > 0) AS least FROM share_{m})" for m in MARGINS)
    room = ", ".join(f"(SELECT coalesce(least, 1.0::DOUBLE) * whole FROM whole_{m})" for m in MARGINS)
    aims = " ".join(f"JOIN share_{m} ON cells.{m} IS NOT DISTINCT FROM share_{m}.{m} CROSS JOIN whole_{m}" for m in MARGINS)
    same = " AND ".join(f"d.{m} IS NOT DISTINCT FROM c.{m}" for m in MARGINS)
    return f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
doc_rows AS (SELECT doc_id, source, lang, {topic} AS topic, CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens, sha256(t) AS sha FROM d),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM doc_rows GROUP BY ALL),
total AS (SELECT sum(n) AS n FROM cells),
{goals},
aimed AS (SELECT least({rate}::DOUBLE, {HEADROOM} * least(1.0::DOUBLE, {room})) AS rate),
start AS (SELECT cells.*, {", ".join(f"share_{m}.share / whole_{m}.whole AS t_{m}" for m in MARGINS)}, rate, cells.n * rate AS w FROM cells {aims} CROSS JOIN aimed),
{", ".join(steps)},
c AS (SELECT source, lang, topic, CASE WHEN n > 0 THEN w / n WHEN least({", ".join(f"t_{m}" for m in MARGINS)}) > 0 THEN rate ELSE 0 END AS p FROM {last})
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(p, 9) AS probability,
  CAST(('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'none') || ':' || sha), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < p AS kept
FROM doc_rows d JOIN c ON {same}"""
