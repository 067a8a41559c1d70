"""Optional: files that arrive are ingested as a stream.

Of files with equal bytes that arrive within a day of each other one comes through, as the state keeps hashes for that long;
``ingest`` finds later copies in the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).load(folder)
    return files.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["sha256"])


def start(spark: SparkSession, folder: str, checkpoint: str, on_batch, glob: str = "*"):
    """on_batch(df, id) gets the new files; the stream ends when the folder has been read."""
    return arriving(spark, folder, glob).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
