"""Cumulative gauge counters: encode, decode, classify and fill transmission gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainloom.operators.calendar import densify
from rainloom.operators.chunks import Axis, carry, previous_row, slots
from rainloom.session import cut_lineage

# Gap classes in minutes, both ends of the middle class inclusive.
SHORT_BELOW = 120
LONG_ABOVE = 1440


def encode_counter(df: DataFrame, time: str = "ts", value: str = "value") -> DataFrame:
    """Running totals since midnight and since 1 January.

    The year total adds the day's running total to the sum of the earlier days,
    so no window holds more than one day of slots or one year of days.
    """
    keyed = df.withColumn("_day", F.to_date(time))
    running = Window.partitionBy("station", "_day").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("station", F.year("_day")).orderBy("_day") \
        .rowsBetween(Window.unboundedPreceding, -1)
    days = keyed.groupBy("station", "_day").agg(F.sum(value).alias("_total"))
    starts = days.select("station", "_day", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_start"))
    return keyed.withColumn("raw_daily", F.sum(value).over(running)).join(starts, ["station", "_day"]).select(
        "station", time, "raw_daily", (F.col("raw_daily") + F.col("_start")).alias("raw_yearly"))


def decode_counter(df: DataFrame, axis: Axis, on_reset: str = "reference") -> DataFrame:
    """Increments from the two counters, plus the missing steps before each row.

    Yearly difference; when negative the daily difference; when that is
    negative too, 0.  The first row of a station has no increment.
    ``on_reset='value'`` takes the yearly reading itself on the first row of a
    new year, which keeps the interval that the plain rule loses.
    """
    rows = previous_row(df.withColumn("_at", axis.ordinal()), axis, ["_at", axis.time, "raw_daily", "raw_yearly"])
    yearly = F.col("raw_yearly") - F.col("prev.raw_yearly")
    daily = F.col("raw_daily") - F.col("prev.raw_daily")
    plain = F.when(yearly >= 0, yearly).when(daily >= 0, daily).when(yearly.isNotNull(), F.lit(0.0))
    if on_reset == "value":
        new_year = F.year(axis.time) != F.year(F.col(f"prev.{axis.time}"))
        plain = F.when(new_year & (yearly < 0), F.col("raw_yearly")).otherwise(plain)
    return rows.withColumns({
        "increment": plain, "missing_slots": F.col("_at") - F.col("prev._at") - 1,
        "resumed": yearly >= 0}).drop("_at", "prev")


def classify_gaps(decoded: DataFrame, slot_minutes: int = 15) -> DataFrame:
    """Duration of the gap before each row (missing slots times slot length) and its class."""
    minutes = F.col("missing_slots") * slot_minutes
    kind = (F.when(minutes <= 0, F.lit("none")).when(minutes < SHORT_BELOW, F.lit("short"))
            .when(minutes <= LONG_ABOVE, F.lit("medium")).when(minutes.isNotNull(), F.lit("long")))
    return decoded.withColumns({"gap_minutes": minutes, "gap_class": kind})


def fill_gaps(classified: DataFrame, slot_minutes: int = 15) -> DataFrame:
    """Increments on the full slot grid.

    Slots of short gaps are dry.  After a medium gap whose counter resumed
    monotonically the total sits on the first slot after the gap, the absent
    slots are 0.  Slots of long gaps, and the total that ends one, are NULL.
    """
    seen = cut_lineage(classified.select("station", "ts", "increment", "gap_class", "resumed",
                                         F.lit(True).alias("_seen")))
    grid = densify(seen, time="ts", minutes=slot_minutes)
    after = F.when(F.col("_seen"), F.struct("gap_class", "resumed"))
    known = carry(grid, slots(slot_minutes), next={"_next": after})
    kind = F.col("_next.gap_class")
    own = F.when(F.col("gap_class").isNull() | (F.col("gap_class") != "long"), F.col("increment"))
    dry = (kind == "short") | ((kind == "medium") & F.col("_next.resumed"))
    value = F.when(F.col("_seen"), own).when(dry, F.lit(0.0))
    return known.select("station", "ts", value.alias("increment"))
