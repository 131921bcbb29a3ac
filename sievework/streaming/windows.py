"""Windows over event streams. The same functions take batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str | None = None, ts: str = "ts") -> DataFrame:
    """Counts and sums by hour and type; with late, a watermark after which an hour is closed."""
    x = events.withColumn("_at", F.col(ts).cast("timestamp"))
    x = x.withWatermark("_at", late) if late else x
    out = x.groupBy(F.window("_at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, ts: str = "ts") -> DataFrame:
    """A user's events without a longer gap between them."""
    x = events.withColumn("_at", F.col(ts).cast("timestamp"))
    x = x.withWatermark("_at", late) if late else x
    out = x.groupBy(F.session_window("_at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def first_of(events: DataFrame, keys: list[str], late: str, ts: str = "ts") -> DataFrame:
    """Events without repeats that come within the watermark: the streaming form of a cache with a time to live."""
    return events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys).drop("_at")
