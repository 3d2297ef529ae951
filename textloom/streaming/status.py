"""Status events as a stream: an extension, as the batch operators need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events from Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def without_repeats(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once, if its repeats come within the watermark; state is bounded by it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts_by_window(events: DataFrame, by: str, window: str = "1 day", time: str = "ts") -> DataFrame:
    """Events by time window and kind."""
    return events.groupBy(F.window(time, window), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
