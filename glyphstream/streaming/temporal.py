"""Temporal counts over a stream of events: an addition, as the batch operators have no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Rows and sum of values by window and key; rows later than the watermark are dropped by Spark."""
    if dict(events.dtypes)[time] == "timestamp_ntz":  # a watermark needs points in time: taken in the session's zone
        events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total"
    )
