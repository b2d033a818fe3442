"""Causal features: rolling statistics, lags, targets, dry spells, seasonal encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.functions import scalars as fx
from rainloom.operators.chunks import DAILY, Axis, carry, over_halo
from rainloom.operators.joins import join_stats


def _rolling_stat(stat: str, x: Column, threshold: float) -> Column:
    return {
        "mean": lambda: F.avg(x), "std": lambda: F.stddev_samp(x), "max": lambda: F.max(x), "min": lambda: F.min(x),
        "sum": lambda: F.sum(x), "wet": lambda: F.count_if(x > threshold),
    }[stat]()


def add_rolling(df: DataFrame, windows: Sequence[int], stats: Sequence[str] = ("mean",), column: str = "value",
                include_current: bool = True, min_periods: int = 1, default: float | None = None,
                threshold: float = 0.0, prefix: str = "", axis: Axis = DAILY) -> DataFrame:
    """Trailing statistics over ``w`` rows; one sort serves all of them.

    Means are named ``rm{w}`` (current row included) or ``roll{w}`` (only rows
    before), other statistics ``{stat}{w}``.
    """
    x = F.col(column)
    edge = 0 if include_current else -1

    def columns(w):
        out = {}
        for n in windows:
            frame = w.rowsBetween(-n + 1 + edge, edge)
            for stat in stats:
                value = _rolling_stat(stat, x, threshold).over(frame)
                if min_periods > 1:
                    value = F.when(F.count(x).over(frame) >= min_periods, value)
                if default is not None:
                    value = F.coalesce(value, F.lit(default))
                label = ("rm" if include_current else "roll") if stat == "mean" else stat
                out[f"{prefix}{label}{n}"] = value
        return out

    return over_halo(df, axis, columns, before=max(windows))


def add_time_rolling(df: DataFrame, days: int, min_obs: int, columns: Mapping[str, str],
                     axis: Axis = DAILY) -> DataFrame:
    """Means over the last ``days`` days by time (column -> new name); rows may be absent.

    NULL where fewer than ``min_obs`` values lie in the window.
    """
    def rolled(w):
        by_day = w.orderBy(F.datediff(F.col(axis.time), F.lit("1970-01-01").cast("date"))) \
            .rangeBetween(-(days - 1), 0)
        return {name: F.when(F.count(c).over(by_day) >= min_obs, F.avg(c).over(by_day))
                for c, name in columns.items()}

    return over_halo(df, axis, rolled, before=days, by_time=True)


def add_lags(df: DataFrame, lags: Sequence[int], column: str = "value", default: float | None = None,
             prefix: str = "", axis: Axis = DAILY) -> DataFrame:
    def columns(w):
        shifted = {k: F.lag(column, k).over(w) for k in lags}
        return {f"{prefix}lag{k}": c if default is None else F.coalesce(c, F.lit(default))
                for k, c in shifted.items()}

    return over_halo(df, axis, columns, before=max(lags))


def add_targets(df: DataFrame, horizons: Sequence[int] = (1, 7, 30), start: int = 0, column: str = "value",
                axis: Axis = DAILY) -> DataFrame:
    """Forward sums ``target{h}`` over ``h`` rows beginning ``start`` rows ahead; NULL unless complete.

    ``start=0`` goes with features that end the day before, ``start=1`` with
    features that include the current day.
    """
    def columns(w):
        out = {}
        for h in horizons:
            frame = w.rowsBetween(start, start + h - 1)
            out[f"target{h}"] = F.when(F.count(column).over(frame) == h, F.sum(column).over(frame))
        return out

    return over_halo(df, axis, columns, after=max(horizons) + start)


def add_dry_spell(df: DataFrame, threshold: float = 0.1, null_as_dry: bool = True, column: str = "value",
                  name: str = "consec_dry", axis: Axis = DAILY) -> DataFrame:
    """Length of the dry run up to and including the row, 0 on wet days (gapless series).

    The last wet step is carried across chunks; the counter is the distance to it.
    """
    x = F.col(column)
    dry = F.coalesce(x, F.lit(0.0)) < threshold if null_as_dry else F.coalesce(x < threshold, F.lit(False))
    step = axis.ordinal()
    known = carry(df, axis, last={"_wet": F.when(~dry, step)}, first_step="_origin")
    since = F.coalesce("_wet", F.col("_origin") - 1)
    return known.withColumn(name, (step - since).cast("long")).drop("_wet", "_origin")


def add_run_boundary(df: DataFrame, threshold: float = 0.1, column: str = "value", axis: Axis = DAILY) -> DataFrame:
    """1 where the dry state differs from the row before (also on the first row)."""
    dry = (F.coalesce(F.col(column), F.lit(0.0)) < threshold).cast("int")
    return over_halo(df, axis, lambda w: {
        "run_start": (~dry.eqNullSafe(F.lag(dry, 1).over(w))).cast("int")}, before=1)


def fill_forward_backward(df: DataFrame, columns: Sequence[str], axis: Axis = DAILY) -> DataFrame:
    """Last known value, and before the first known value the next one."""
    filled = carry(df, axis, last={f"_l_{c}": F.col(c) for c in columns},
                   next={f"_n_{c}": F.col(c) for c in columns})
    return filled.withColumns({c: F.coalesce(f"_l_{c}", f"_n_{c}") for c in columns}) \
        .drop(*[f"_{e}_{c}" for e in "ln" for c in columns])


def add_seasonal(df: DataFrame, period: float = 365.25, harmonics: Sequence[int] = (1,), time: str = "date",
                 of: Sequence[str] = ("doy", "month")) -> DataFrame:
    """Sine/cosine of day of year (``period`` days) and of month (12), per harmonic."""
    parts = {"doy": (F.dayofyear(time), period), "month": (F.month(time), 12.0)}
    out: dict[str, Column] = {}
    for name in of:
        ordinal, length = parts[name]
        for h in harmonics:
            sine, cosine = fx.cyclic(ordinal, length, h)
            suffix = "" if h == 1 else str(h)
            out[f"{name}_sin{suffix}"], out[f"{name}_cos{suffix}"] = sine, cosine
    return df.withColumns(out)


def add_calendar_parts(df: DataFrame, time: str = "ts") -> DataFrame:
    return df.withColumns({
        "date": F.to_date(time), "doy": F.dayofyear(time), "month_no": F.month(time),
        "month": F.trunc(F.to_date(time), "MM")})


def add_station_mean(df: DataFrame) -> DataFrame:
    """Mean of all stations of the date as a feature: aggregated first, then joined."""
    means = df.groupBy("date").agg(F.avg("value").alias("station_mean"))
    return join_stats(df, means, ["date"])


def engineered_daily(df: DataFrame, windows: Sequence[int] = (3, 7, 14), lags: Sequence[int] = (3, 7, 14),
                     threshold: float = 0.1, period: float = 365.25, axis: Axis = DAILY) -> DataFrame:
    """The daily feature table from ``station, date, total, peak`` on a gapless calendar."""
    def columns(w):
        out = {}
        for n in windows:
            frame = w.rowsBetween(-(n - 1), 0)
            out[f"total_rm{n}"] = F.avg("total").over(frame)
            out[f"peak_rm{n}"] = F.avg("peak").over(frame)
        for k in lags:
            out[f"total_lag{k}"] = F.lag("total", k).over(w)
        return out

    rolled = over_halo(df, axis, columns, before=max(*windows, *lags))
    spelled = add_dry_spell(rolled, threshold, column="total", axis=axis)
    return add_seasonal(spelled, period)


