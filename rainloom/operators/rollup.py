"""Roll-ups: sub-daily to daily, daily to monthly, grid to area or cell day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.operators.chunks import MONTHLY, over_halo


def total(x: Column) -> Column:
    """Sum where nothing observed counts as 0."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def daily(df: DataFrame, time: str = "ts", value: str = "value", keys: Sequence[str] = ("station",),
          prefix: str = "") -> DataFrame:
    """Day total (0 when all readings are missing), peak and sample deviation."""
    return df.groupBy(*keys, F.to_date(time).alias("date")).agg(
        total(F.col(value)).alias(f"{prefix}total"),
        F.max(value).alias(f"{prefix}peak"),
        F.stddev_samp(value).alias(f"{prefix}std"),
    )


def daily_wide(df: DataFrame, stations: Sequence[str], time: str = "ts", value: str = "value") -> DataFrame:
    """One row per day with total, peak and deviation columns for each named station."""
    def of(s: str) -> Column:
        return F.when(F.col("station") == s, F.col(value))

    return df.groupBy(F.to_date(time).alias("date")).agg(*[
        c for s in stations for c in (
            total(of(s)).alias(f"{s}_total"), F.max(of(s)).alias(f"{s}_peak"),
            F.stddev_samp(of(s)).alias(f"{s}_std"))
    ])


def month_start(time: str = "date") -> Column:
    return F.trunc(F.col(time), "MM").alias("month")


def monthly_totals(df: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    return df.groupBy(*keys, month_start()).agg(total(F.col("value")).alias("total"))


def monthly_missing(df: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    return df.groupBy(*keys, month_start()).agg(
        F.avg(F.col("value").isNull().cast("double")).alias("missing_fraction"))


def monthly_covariates(df: DataFrame, how: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Per-column function: ``{'tp': 'sum', 't2m': 'avg'}``."""
    funcs = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    return df.groupBy(*keys, month_start()).agg(*[funcs[f](c).alias(c) for c, f in how.items()])


def monthly_real_totals(df: DataFrame, min_days: int = 15, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Monthly total of truly observed days; NULL when fewer than ``min_days`` of them."""
    real = (F.col("imputed") == 0) & F.col("value").isNotNull()
    grouped = df.groupBy(*keys, month_start()).agg(
        F.count_if(real).alias("real_days"), F.sum(F.when(real, F.col("value"))).alias("_sum"))
    return grouped.select(*keys, "month", "real_days",
                          F.when(F.col("real_days") >= min_days, F.col("_sum")).alias("total"))


def moving_average(months: DataFrame, window: int = 12, column: str = "total") -> DataFrame:
    """Trailing mean over monthly rows, fewer rows allowed at the start."""
    return over_halo(months, MONTHLY,
                     lambda w: {f"ma{window}": F.avg(column).over(w.rowsBetween(-(window - 1), 0))},
                     before=window - 1)


def monthly_lags(months: DataFrame, lags: Sequence[int] = (1, 2), window: int = 3,
                 column: str = "total") -> DataFrame:
    """Earlier months' totals, the trailing mean before the month, and log of each lag."""
    def columns(w):
        out = {f"lag{k}m": F.lag(column, k).over(w) for k in lags}
        out[f"roll{window}m"] = F.avg(column).over(w.rowsBetween(-window, -1))
        return out

    lagged = over_halo(months, MONTHLY, columns, before=max(window, *lags))
    return lagged.withColumns({
        f"log_lag{k}m": F.log1p(F.greatest(F.coalesce(f"lag{k}m", F.lit(0.0)), F.lit(0.0))) for k in lags})


def grid_daily(grid: DataFrame, mean: Sequence[str], accumulate: Sequence[str],
               keys: Sequence[str] = ()) -> DataFrame:
    """Area mean per time step, then day mean for states and day sum for accumulations.

    With ``keys=('lat', 'lon')`` the cells stay apart.
    """
    columns = [*mean, *accumulate]
    per_step = grid.groupBy(*keys, "ts").agg(*[F.avg(c).alias(c) for c in columns])
    return per_step.groupBy(*keys, F.to_date("ts").alias("date")).agg(
        *[F.avg(c).alias(c) for c in mean], *[F.sum(c).alias(c) for c in accumulate])


def cross_station_mean(df: DataFrame) -> DataFrame:
    """Mean over stations for each date (missing stations are skipped)."""
    return df.groupBy("date").agg(F.avg("value").alias("station_mean"), F.count("value").alias("n_stations"))
