"""Prices from a stream of events, an extension of the batch panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_prices(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean value by event type and window; events later than ``late`` are left out, so that state
    is bounded."""
    means = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.avg("value").alias("price"))
    return means.select(F.col("window.start").cast("date").alias("time"), F.col("event_type").alias("series"), "price")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events, span and total value of each user's sessions."""
    each = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n_events"), F.sum("value").alias("value"))
    return each.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events", "value")
