"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions sent to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

#: White space of every contract here: space and \x09-\x0D.
SPACE = " \t\n\x0b\f\r"
#: Bytes and rows of one Arrow batch, about, at most: a row can be a book, or two numbers.
ARROW_BYTES, ARROW_ROWS = 1 << 20, 20_000

#: Bytes of a file of whole texts, at least (as many as a split of the session, if that is more); rows of a file of short rows, about.
FILE_BYTES, FILE_ROWS = 16 << 20, 2_000_000
#: Rows of a side that is broadcast, at most; joins with more rows shuffle.
BROADCAST_ROWS = 200_000
#: Rows of one key that a task joins, about, where the side is not broadcast.
HOT_ROWS = 100_000

_made: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by their bytes. The same for all operators, as the setting is read when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def larger(batches, size: int):
    """Arrow batches put together until they hold ``size`` bytes."""
    import pyarrow as pa

    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(held) if len(held) > 1 else batch
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def released(run):
    """A function of batches that gives memory back to the system when its task is over: workers outlive tasks."""

    def tidy(batches):
        yield from run(batches)
        trim_memory()

    return tidy


def trim_memory() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = tempfile.mkdtemp(prefix="quarryspark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def compact(df: DataFrame) -> DataFrame:
    """``df`` in partitions of about a split's bytes, by the planner's estimate, but one a core at least.

    So a table of many small splits isn't written as many small files, nor as files of more than a task reads at once.
    """
    spark = df.sparkSession
    split = max(FILE_BYTES, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(max(spark.sparkContext.defaultParallelism, -(-size // split)), 1 << 20))


def spill(df: DataFrame, name: str, rows: int | None = None, dealt: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    rows: short rows that it, and what it is made of, have at most, for the number of its files. dealt: it is a sum of many
    more rows, and its partitions stay as the planner deals them.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/quarryspark-{uuid.uuid4().hex}-{name}"
    if not dealt:
        df = compact(df) if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(folder)
    if not _made:
        atexit.register(_remove_all)
    _made[folder] = spark
    out = spark.read.schema(df.schema).parquet(folder)
    out.spilled = folder
    trim_memory()
    return out


def discard(*spilled: DataFrame) -> None:
    """Delete spilled tables whose successors are written."""
    for df in spilled:
        _remove(df.spilled)


def _remove(folder: str) -> None:
    spark = _made.pop(folder)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    """Best effort at exit: scratch tables are of no use after the session."""
    for folder in list(_made):
        try:
            _remove(folder)
        except Exception:  # the JVM may be gone already
            return


def sized(side: DataFrame, rows: int | None = None) -> DataFrame:
    """A side of a join with a hint: broadcast if it is counted to have few rows, else a sort-merge join."""
    return side.hint("broadcast" if (side.count() if rows is None else rows) <= BROADCAST_ROWS else "merge")


def meet(rows: DataFrame, side: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined with a side that has each key once, and ``n``, the rows of that key.

    A small side is broadcast. Of a large one, keys of over HOT_ROWS rows are salted: copies of the side's row for as many
    salts as the rows need, so that no task gets all rows of a hot key.
    """
    count = side.count()
    if count <= BROADCAST_ROWS:
        return rows.join(side.hint("broadcast"), on, how)
    salts = F.greatest(F.ceil(F.col("n") / HOT_ROWS).cast("int"), F.lit(1))
    hot = side.where(F.col("n") > HOT_ROWS).select(*on, salts.alias("_salts"))
    own = F.pmod(F.xxhash64("_row"), F.coalesce("_salts", F.lit(1))).cast("int")
    # rows are numbered where they are read, before any shuffle, so that a task that runs again gives them the same salts
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    salted = numbered.join(sized(hot), on, "left").withColumn("_salt", own).drop("_salts", "_row")
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def text_sha(text: Column) -> Column:
    """32 bytes that stand for a text, so that rows with null or repeated ids can be told apart."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def keep_one(df: DataFrame, named: DataFrame, sha: Column, total: int) -> DataFrame:
    """The rows of ``df`` whose (doc_id, sha) is ``keep`` in named (doc_id, sha, keep), one of each that repeats.

    Only rows that go, or repeat, are named to ``df``; its texts stay where they are as long as those are few. total: rows
    of named, at most.
    """
    rows = spill(named.groupBy("doc_id", "sha").agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1 OR NOT keep").select(F.col("doc_id").alias("_gone_id"), F.col("sha").alias("_gone_sha"), "keep"), "gone", total)
    own_id = df["doc_id"].cast("long")
    same = lambda side: own_id.eqNullSafe(side["_gone_id"]) & (sha == side["_gone_sha"])
    gone = sized(rows)
    left = df.join(gone, same(gone), "left_anti")
    repeats = rows.where("keep")
    if repeats.isEmpty():
        return left
    repeats = sized(repeats)
    again = df.join(repeats, same(repeats), "left_semi").groupBy(own_id.alias("_id"), sha.alias("_sha")).agg(F.any_value(F.struct(*df.columns)).alias("_row"))
    return left.unionByName(again.select("_row.*"))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of rows whose labels no classifier may see."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def hex64(value: Column) -> Column:
    """A long as 16 lowercase hex digits (two's complement)."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
