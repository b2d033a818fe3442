"""The daily roll-up and the outage check over a stream of telemetry.

The same aggregates as the batch operators; a day or session is emitted once
the watermark has passed it, and later rows for it are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.operators.rollup import total


def stream_daily(readings: DataFrame, delay: str = "2 hours") -> DataFrame:
    """``station, ts, value`` to day total, peak and deviation per station."""
    days = readings.withWatermark("ts", delay).groupBy("station", F.window("ts", "1 day").alias("w"))
    return days.agg(total(F.col("value")).alias("total"), F.max("value").alias("peak"),
                    F.stddev_samp("value").alias("std")).select(
        "station", F.to_date("w.start").alias("date"), "total", "peak", "std")


def stream_sessions(readings: DataFrame, gap: str = "2 hours", delay: str = "2 hours") -> DataFrame:
    """Uninterrupted transmission periods per station; a new one starts after a gap."""
    runs = readings.withWatermark("ts", delay).groupBy("station", F.session_window("ts", gap).alias("w"))
    return runs.agg(F.min("ts").alias("first_reading"), F.max("ts").alias("last_reading"),
                    F.count("*").alias("n_readings")).drop("w")
