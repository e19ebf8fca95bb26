"""Usage of a running stream of calls: an extension, not part of the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_by_window(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their values by type and time window; rows later than the watermark are left out."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    per = stamped.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return per.select(F.col("window.start").alias("from_ts"), "event_type", "n", "value")
