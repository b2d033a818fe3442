"""Calendars: densify a series, find absent timestamps, gaps and missing blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.operators.chunks import DAILY, Axis, carry, previous_row


# Days generated by one task row of a calendar.
SPINE_DAYS = 1024
SPINE_SLOT_DAYS = 32


def spine(df: DataFrame, keys: Sequence[str] = ("station",), time: str = "date",
          minutes: int | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Every expected timestamp of every key between the earliest and latest one of the table.

    ``minutes`` selects a sub-daily grid.  The list of keys is tiny next to the
    calendar it expands to, so (key, block of days) pairs are first spread over
    all shuffle partitions (a fixed number, which runtime coalescing leaves
    alone) and the rows are generated after that, a bounded block at a time.
    """
    spans = df.groupBy(*keys).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    bounds = spans.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    lo = bounds.select("lo").scalar() if start is None else start
    hi = bounds.select("hi").scalar() if end is None else end
    size = SPINE_DAYS if minutes is None else SPINE_SLOT_DAYS
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = spans.select(*keys, lo.alias("_lo"), hi.alias("_hi")).withColumn("_block", F.explode(F.sequence(
        F.to_date("_lo"), F.to_date("_hi"), F.expr(f"INTERVAL {size} DAYS")))).repartition(spread, *keys, "_block")
    last = F.least(F.date_add("_block", size - 1), F.to_date("_hi"))
    days = blocks.withColumn("_day", F.explode(F.sequence(F.col("_block"), last, F.expr("INTERVAL 1 DAY"))))
    if minutes is None:
        return days.select(*keys, F.col("_day").alias(time))
    midnight = F.col("_day").cast("timestamp_ntz")
    slot = F.explode(F.sequence(midnight, midnight + F.expr(f"INTERVAL {24 * 60 - minutes} MINUTES"),
                                F.expr(f"INTERVAL {minutes} MINUTES")))
    return days.select(*keys, "_lo", "_hi", slot.alias(time)) \
        .where(F.col(time).between(F.col("_lo"), F.col("_hi"))).select(*keys, time)


def densify(df: DataFrame, keys: Sequence[str] = ("station",), time: str = "date",
            minutes: int | None = None, start: Column | None = None, end: Column | None = None,
            off_grid: str = "fail") -> DataFrame:
    """Series on the full calendar; values are NULL where no row existed.

    Readings between two slots, or without a time, have no place on the
    calendar: ``off_grid`` "fail" raises when such a row is read, "slot" moves a
    reading to the start of its slot (several may then share one), "drop" leaves
    them out.  Rows that repeat a key and time stay repeated.  Rows outside an
    explicit ``start`` and ``end`` are not part of the result.
    """
    if off_grid not in ("fail", "slot", "drop"):
        raise ValueError(f"off_grid can't be {off_grid}")
    t = F.col(time)
    if minutes is None:
        own = F.to_date(t)
        exact = t.isNotNull() if dict(df.dtypes)[time] == "date" else t == own
    else:
        own = slot_start(t, minutes)
        exact = t == own
    if off_grid == "slot":
        rows = df.where(t.isNotNull()).withColumn(time, own)
    elif off_grid == "drop":
        rows = df.where(F.coalesce(exact, F.lit(False)))
    else:
        broken = F.raise_error(F.concat(F.lit("a reading is off the calendar: "), F.coalesce(t.cast("string"), F.lit("no time"))))
        rows = df.withColumn(time, F.when(F.coalesce(exact, F.lit(False)), t).otherwise(broken.cast(dict(df.dtypes)[time])))
    grid = spine(rows if off_grid != "fail" else df, keys, time, minutes, start, end)
    return grid.join(rows, [*keys, time], "left").select(*df.columns)


def slot_start(time: Column, minutes: int) -> Column:
    """Start of the slot of the day that a timestamp lies in."""
    midnight = F.to_date(time).cast("timestamp_ntz")
    second = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    return midnight + F.make_dt_interval(secs=(second - second % (minutes * 60)).cast("decimal(18,6)"))


def missing_timestamps(df: DataFrame, keys: Sequence[str] = ("station",), time: str = "date",
                       minutes: int | None = None) -> DataFrame:
    """Expected timestamps without a row."""
    return spine(df, keys, time, minutes).join(df, [*keys, time], "left_anti")


def date_gaps(df: DataFrame, axis: Axis = DAILY) -> DataFrame:
    """Rows whose distance to the previous row of the key is not one step."""
    distance = (axis.ordinal() - F.col("_prev_step")).cast("int")
    stepped = previous_row(df.withColumn("_own_step", axis.ordinal()), axis, ["_own_step"], "_prev")
    return (
        stepped.withColumn("_prev_step", F.col("_prev._own_step"))
        .withColumn("gap_steps", distance)
        .where("gap_steps <> 1")
        .drop("_own_step", "_prev", "_prev_step")
    )


def missing_blocks(df: DataFrame, axis: Axis = DAILY, value: str = "value") -> DataFrame:
    """Contiguous runs of missing values on a gapless series: start, end, length."""
    known = F.when(F.col(value).isNotNull(), axis.ordinal())
    runs = carry(df, axis, last={"_run": known}).where(F.col(value).isNull())
    return (
        runs.groupBy(*axis.keys, F.coalesce("_run", F.lit(-1)).alias("_run"))
        .agg(F.min(axis.time).alias("block_start"), F.max(axis.time).alias("block_end"),
             F.count("*").alias("block_length"))
        .drop("_run")
    )


def duplicate_count(df: DataFrame, keys: Sequence[str] = ("station", "ts")) -> DataFrame:
    """Rows that repeat an earlier key: pre-aggregated per key, then summed."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"),
                       F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))
