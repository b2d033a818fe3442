"""Model windows: centred windows, look-back sequences, horizon arrays and their explosion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.operators.chunks import DAILY, Axis, over_halo


def centered_windows(df: DataFrame, half: int = 7, column: str = "value", name: str = "window",
                     axis: Axis = DAILY) -> DataFrame:
    """Array of ``2 * half + 1`` structs (value, mask) around each row; outside and missing cells are 0, mask 0."""
    x = F.col(column)

    def columns(w):
        cells = []
        for k in range(-half, half + 1):
            shifted = F.lag(x, -k).over(w) if k < 0 else F.lead(x, k).over(w) if k > 0 else x
            cells.append(F.struct(F.coalesce(shifted, F.lit(0.0)).alias("value"),
                                  shifted.isNotNull().cast("int").alias("mask")))
        return {name: F.array(*cells)}

    return over_halo(df, axis, columns, before=half, after=half)


def offset_columns(df: DataFrame, half: int = 7, column: str = "value", prefix: str = "v",
                   axis: Axis = DAILY) -> DataFrame:
    """The same neighbourhood without the own cell, as flat model columns and mask columns."""
    x = F.col(column)

    def columns(w):
        out: dict[str, Column] = {}
        for k in [*range(-half, 0), *range(1, half + 1)]:
            shifted = F.lag(x, -k).over(w) if k < 0 else F.lead(x, k).over(w)
            label = f"m{-k}" if k < 0 else f"p{k}"
            out[f"{prefix}_{label}"] = F.coalesce(shifted, F.lit(0.0))
            out[f"{prefix}_{label}_mask"] = shifted.isNotNull().cast("double")
        return out

    return over_halo(df, axis, columns, before=half, after=half)


def lookback_sequences(df: DataFrame, length: int = 45, features: Sequence[str] = ("value",),
                       name: str = "sequence", axis: Axis = DAILY) -> DataFrame:
    """Array of the ``length`` feature structs before each row; rows without a full history are dropped.

    Arrays multiply the data by ``length``; prefer the frame statistics of
    ``features`` where a model does not need the raw sequence.
    """
    entry = F.struct(*[F.col(c).alias(c) for c in features])
    out = over_halo(df, axis, lambda w: {name: F.collect_list(entry).over(w.rowsBetween(-length, -1))},
                    before=length)
    return out.where(F.size(name) == length)


def horizon_targets(df: DataFrame, horizon: int = 14, column: str = "value", name: str = "targets",
                    axis: Axis = DAILY) -> DataFrame:
    """Array of the next ``horizon`` values starting at the row itself; incomplete rows are dropped."""
    entry = F.struct(F.col(column).alias("value"))
    out = over_halo(df, axis, lambda w: {name: F.collect_list(entry).over(w.rowsBetween(0, horizon - 1))},
                    after=horizon)
    return out.where(F.size(name) == horizon)


def explode_horizon(df: DataFrame, name: str = "targets", time: str = "date") -> DataFrame:
    """One row per origin and lead day: ``forecast_date, horizon_day, value``."""
    kept = [c for c in df.columns if c not in (name, "value")]
    long = df.select(*kept, F.posexplode(name).alias("pos", "cell"))
    return long.select(*kept, F.date_add(F.col(time), F.col("pos")).alias("forecast_date"),
                       (F.col("pos") + 1).alias("horizon_day"), F.col("cell.value").alias("value"))
