"""Gap filling: simple imputers, the observed-preserving composite and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.functions import scalars as fx
from rainloom.operators.chunks import DAILY, Axis, carry
from rainloom.operators.joins import join_stats
from rainloom.operators.quality import with_overall


def composite(observed: Column, candidate: Column, digits: int = 1) -> Column:
    """Observed cells stay as they are; others take the candidate, floored at 0 and rounded half-even."""
    return F.coalesce(observed, fx.half_even(fx.floor_at(candidate, 0.0), digits))


def finalise(df: DataFrame, candidate: str = "candidate", value: str = "value", digits: int = 1,
             eligible: Column | None = None) -> DataFrame:
    """Completed table with the ``imputed`` flag; ineligible cells stay NULL."""
    x = F.col(value)
    offered = F.col(candidate) if eligible is None else F.when(eligible, F.col(candidate))
    filled = composite(x, offered, digits)
    return df.withColumns({"imputed": (x.isNull() & filled.isNotNull()).cast("int"), "observed": x, value: filled}) \
        .drop(candidate)


def from_normalised(prediction: Column, low: Column, high: Column) -> Column:
    """Model output on the log-min-max scale back to an amount: clip to [0, 1], unscale, expm1, floor."""
    return fx.from_log(fx.min_max_inverse(fx.clip(prediction, 0.0, 1.0), low, high))


def candidates(df: DataFrame, method: str, value: str = "value", axis: Axis = DAILY) -> DataFrame:
    """Add ``candidate`` for every cell by one of the simple methods.

    ``station_mean``, ``date_mean`` (other stations of the day),
    ``forward_fill``, ``linear`` (in time) or ``month_climatology``.  Group
    means are aggregated first and joined, not computed by whole-station windows.
    """
    x = F.col(value)
    if method == "station_mean":
        means = df.groupBy(*axis.keys).agg(F.avg(x).alias("candidate"))
        return join_stats(df, means, axis.keys)
    if method == "date_mean":
        means = df.groupBy(axis.time).agg(F.avg(x).alias("candidate"))
        return join_stats(df, means, [axis.time])
    if method == "month_climatology":
        means = df.groupBy(*axis.keys, F.month(axis.time).alias("_m")).agg(F.avg(x).alias("candidate"))
        return join_stats(df.withColumn("_m", F.month(axis.time)), means, [*axis.keys, "_m"]).drop("_m")
    if method == "forward_fill":
        return carry(df, axis, last={"candidate": x})
    if method == "linear":
        step = axis.ordinal()
        point = F.when(x.isNotNull(), F.struct(step.alias("at"), x.alias("v")))
        known = carry(df, axis, last={"_a": point}, next={"_b": point})
        span = F.col("_b.at") - F.col("_a.at")
        between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (step - F.col("_a.at")) / span
        candidate = F.when(span > 0, between).otherwise(F.coalesce("_a.v", "_b.v"))
        return known.withColumn("candidate", candidate).drop("_a", "_b")
    raise ValueError(f"unknown method {method!r}")


def impute(df: DataFrame, method: str, digits: int = 1, eligible: Column | None = None, axis: Axis = DAILY) -> DataFrame:
    return finalise(candidates(df, method, axis=axis), digits=digits, eligible=eligible)


def imputation_counts(df: DataFrame) -> DataFrame:
    """Originally missing, imputed and still missing cells per station and in total."""
    return with_overall(df, [
        F.count_if(F.col("observed").isNull()).alias("n_missing_before"),
        F.sum("imputed").cast("long").alias("n_imputed"), F.count_if(F.col("value").isNull()).alias("n_still_missing")])


def assert_complete(df: DataFrame, value: str = "value") -> DataFrame:
    """Same table; the query fails when a value is still missing."""
    x = F.col(value)
    return df.withColumn(value, F.when(x.isNotNull(), x).otherwise(
        F.raise_error(F.lit("a value is still missing")).cast("double")))
