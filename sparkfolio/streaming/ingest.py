"""Incremental ingest: new files of a folder become units, each file once, by Structured Streaming's file source.

The reference engine has no streams; this is an addition. Progress is kept in the query's checkpoint, so a restart goes on where it
stopped, and each micro-batch appends whole files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkfolio.sources import detect, office

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, glob: str = "*", files_per_batch: int = 1_000) -> DataFrame:
    """A stream of files with their format."""
    source = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    return source.load(folder).withColumn("format", detect.detect(F.col("path"), F.col("content")))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, glob: str = "*", once: bool = True) -> StreamingQuery:
    """Converts new files and appends their units to the Parquet table out."""
    units = office.convert(watch(spark, folder, glob))
    writer = units.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time_col: str, key_col: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by key and tumbling window; rows later than `late` behind the watermark are dropped, and state with them."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, window), key_col).agg(F.count(F.lit(1)).alias("n"))
