"""Scalers as aggregates: fit on a filtered part, apply as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.functions import scalars as fx
from rainloom.operators.joins import join_stats
from rainloom.session import cut_lineage


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str = "minmax", where: Column | None = None,
               keys: Sequence[str] = (), pooled: bool = False) -> DataFrame:
    """Parameters ``{c}_a, {c}_b``: minimum and maximum, or mean and population deviation.

    ``where`` restricts the fit (training rows by default of the callers),
    ``pooled`` shares one minimum/maximum between the columns.  The parameters
    are written once, whatever number of columns and frames use them.
    """
    def stat(f, c: str) -> Column:
        return f(F.when(where, F.col(c))) if where is not None else f(F.col(c))

    first, second = (F.min, F.max) if kind == "minmax" else (F.avg, F.stddev_pop)
    params = df.groupBy(*keys).agg(*[e for c in columns for e in (
        stat(first, c).alias(f"{c}_a"), stat(second, c).alias(f"{c}_b"))])
    if not pooled:
        return cut_lineage(params)
    if kind != "minmax":
        raise ValueError("only min-max parameters can be pooled")
    def over(side: str, combine) -> Column:
        names = [F.col(f"{c}_{side}") for c in columns]
        return combine(*names) if len(names) > 1 else names[0]

    return cut_lineage(params.select(*keys, *[e for c in columns for e in (
        over("a", F.least).alias(f"{c}_a"), over("b", F.greatest).alias(f"{c}_b"))]))


def _apply(df: DataFrame, params: DataFrame, columns: Sequence[str], keys: Sequence[str], forward, suffix: str):
    if keys:
        joined = join_stats(df, params, keys)
        pick = F.col
    else:
        joined = df

        def pick(name: str) -> Column:
            return params.select(name).scalar()

    out = joined.withColumns({f"{c}{suffix}": forward(F.col(c), pick(f"{c}_a"), pick(f"{c}_b")) for c in columns})
    return out.drop(*[f"{c}_{e}" for c in columns for e in "ab"]) if keys else out


def scale(df: DataFrame, params: DataFrame, columns: Sequence[str], kind: str = "minmax",
          keys: Sequence[str] = (), suffix: str = "_scaled") -> DataFrame:
    return _apply(df, params, columns, keys, fx.min_max if kind == "minmax" else fx.standard, suffix)


def unscale(df: DataFrame, params: DataFrame, columns: Sequence[str], kind: str = "minmax",
            keys: Sequence[str] = (), suffix: str = "_raw") -> DataFrame:
    inverse = fx.min_max_inverse if kind == "minmax" else fx.standard_inverse
    return _apply(df, params, columns, keys, inverse, suffix)
