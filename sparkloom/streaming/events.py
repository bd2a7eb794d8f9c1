"""The event stream: watermarked windows, sessions and per-user state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_a_trigger: int = 64) -> DataFrame:
    """Events from a folder that Parquet files arrive in."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_stream(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums by window and type; events later than `late` behind the newest are dropped, as the watermark says."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(28,4)").alias("total")
    )
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def session_stream(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each user: runs of events with no gap as long as `gap`."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def unique_stream(events: DataFrame, late: str) -> DataFrame:
    """Each event_id once, as far back as the watermark reaches."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
