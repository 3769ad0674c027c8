"""Streams of events: beyond what a ledger needs, but the same rules on rows that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How late an event may come.
LATE = "1 hour"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The events at path (files and folders that begin so) as a stream, with its watermark."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Events and their value by type in windows of the width."""
    grouped = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    return grouped.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Each user's sessions: events no further apart than the gap."""
    grouped = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return grouped.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")


def once(events: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.dropDuplicatesWithinWatermark([*keys])


def drain(stream: DataFrame, base: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now, and give what its sink then holds. base is a folder of the caller's, for the
    checkpoint and the sink: with the same one, a later call goes on where the last one ended, be it that more has
    come or that it broke off. Each batch has a folder by its number, so that one that is run twice counts once; in
    complete mode the newest batch is all."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/{number:012d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{base}/out")
