"""Stage events as a stream: tumbling windows with a watermark, and files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, latency) of windows; the same on a table and on a stream, where events
    later than the watermark are left out."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", late) if events.isStreaming else e
    w = e.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("latency"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "latency")


def arriving(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(like.schema).parquet(path)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes what there is and ends."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as they come in, whole: path, modificationTime, length, content, head."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("head", F.substring("content", 1, 4))


def each_batch(stream: DataFrame, sink, checkpoint: str):
    """Gives what there is to sink(batch, number), batch by batch, and ends. A sink that raises leaves its
    batch for the next run, so that it must put up with getting one twice."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
