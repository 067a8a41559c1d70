"""Where given passages stand in texts: the first place of each passage in each text.

An automaton over all passages reads a text once, whatever their number, so nothing is paired with
everything. Passages go to the workers in blocks of ``BLOCK`` bytes; each block reads the texts once more.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the passages of one automaton, at most (a longer passage is a block of its own).
BLOCK = 16 << 20


def blocks(passages: DataFrame, size: int = BLOCK) -> Iterator[list[tuple]]:
    """(item_id, text) rows, a block at a time; the driver holds one block."""
    held, total = [], 0
    for row in passages.select("item_id", "text").where("text != ''").toLocalIterator():
        n = len(row["text"].encode())
        if held and total + n > size:
            yield held
            held, total = [], 0
        held.append(tuple(row))
        total += n
    if held:
        yield held


def found(texts: DataFrame, passages: DataFrame, size: int = BLOCK) -> DataFrame:
    """page_id, item_id, start_char, end_char, quote of (page_id, text) and (item_id, text): byte places of first occurrences.

    Null texts hold nothing, null and empty passages stand nowhere; items with equal texts are all found.
    """
    spark = texts.sparkSession
    kinds = f"page_id {texts.schema['page_id'].dataType.simpleString()}, item_id {passages.schema['item_id'].dataType.simpleString()}, start_char long, end_char long, quote string"
    out = None
    for block in blocks(passages, size):
        part = _block(texts, spark.sparkContext.broadcast(block), kinds)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], kinds)


def _block(texts: DataFrame, block, kinds: str) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(kinds))

    def run(batches):
        import ahocorasick

        items: dict[str, list] = {}
        for item, text in block.value:
            items.setdefault(text, []).append(item)
        automaton = ahocorasick.Automaton()
        for text in items:
            automaton.add_word(text, text)
        automaton.make_automaton()
        for batch in batches:
            rows = []
            for page, text in zip(batch.column("page_id").to_pylist(), batch.column("text").to_pylist()):
                seen = {}
                for end, quote in automaton.iter(text or ""):
                    seen.setdefault(quote, end + 1 - len(quote))
                for quote, at in seen.items():
                    start = len(text[:at].encode())
                    rows += [(page, item, start, start + len(quote.encode()), quote) for item in items[quote]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return texts.select("page_id", F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)
