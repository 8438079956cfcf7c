"""Sources as a stream: new files under a folder are decoded as they come, into the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import normalize_duration, source_kind
from ..sources import reader

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_sources(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The stream of files under path, as reader.sources() has them."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("project_id"), name.alias("name"), source_kind(name, F.lit("")).alias("kind"), "length", "content")


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Decodes new files into Parquet under out, by table; with once, what is there now, and then the query ends."""
    rows = reader.decode(stream_sources(spark, path))
    writer = rows.writeStream.format("parquet").partitionBy("kind").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def duration_windows(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """For each window of event time and user: frames, and their summed durations; events later than the watermark are dropped."""
    rows = events.withWatermark("ts", late).withColumn("duration_ms", normalize_duration(F.col("value") * 1000 / 12))
    sums = rows.groupBy(F.window("ts", size), "user_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("duration_ms").alias("total_ms"))
    return sums.select(F.col("window.start").alias("start"), "user_id", "frames", "total_ms")
