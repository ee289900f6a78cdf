"""Windows over event streams; every function takes a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_totals(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Count and sum by hour and type. On a stream, rows later than ``late`` behind the watermark are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    grouped = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: runs of events less than ``gap`` apart."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    grouped = e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("s.start").alias("started"), "n")


def running_tag_use(events: DataFrame) -> DataFrame:
    """Running counters by type, for update mode."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("uses"), F.avg("value").alias("mean_value"))
