"""Event-time aggregates that run on a stream as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.numbers import total


def windowed_totals(events: DataFrame, time: str, keys: list[str], value: str, length: str = "1 day", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(window_start, window_end, keys..., events, total) per window; on a stream ``late`` bounds the state by a watermark. Rows without a time are left out."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).where(F.col("_t").isNotNull())
    if late:
        rows = rows.withWatermark("_t", late)
    window = F.window("_t", length, slide) if slide else F.window("_t", length)
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), total(F.col(value)).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "events", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(key, session_start, session_end, events): runs of events with no pause of ``gap`` or more."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).where(F.col("_t").isNotNull() & F.col(key).isNotNull())
    if late:
        rows = rows.withWatermark("_t", late)
    out = rows.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
