"""Monthly models: ridge in log space, single-covariate line, bias correction, quantile mapping."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.functions import scalars as fx
from rainloom.operators.chunks import ordered_prefix
from rainloom.operators.joins import join_stats
from rainloom.operators.ranks import with_value_bucket

# Ridge penalties tried, and the cap of log amounts.
ALPHAS = (0.5, 1.0, 5.0, 10.0, 50.0)
LOG_CAP = 8.0


def _solver(alphas: Sequence[float], width: int):
    """Ridge coefficients for every penalty from centred moments; a batch of stations is solved at once."""
    rows, cols = np.triu_indices(width)

    @F.pandas_udf("array<array<double>>")
    def solve(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        penalties = np.asarray(alphas, float)[:, None, None] * np.eye(width)
        for gram, cross in parts:
            matrix = np.zeros((len(gram), width, width))
            if len(gram):
                matrix[:, rows, cols] = matrix[:, cols, rows] = np.stack(gram.to_numpy())
            right = np.stack(cross.to_numpy()).astype(float) if len(cross) else np.zeros((0, width))
            every = np.linalg.solve(matrix[:, None] + penalties, np.repeat(right[:, None, :, None], len(alphas), axis=1))
            yield pd.Series([x.tolist() for x in every[..., 0]])

    return solve


def fit_ridge(df: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float] = ALPHAS,
              where: Column | None = None, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Ridge with an unpenalised intercept for every key and penalty: (keys, alpha, intercept, coef).

    One aggregation collects the centred second moments of all stations; only a
    small system per station is solved outside the JVM.
    """
    usable = F.col(target).isNotNull()
    for f in features:
        usable = usable & F.col(f).isNotNull()
    rows = df.where(usable if where is None else usable & where)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    moments = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.avg(target).alias("_y"), F.array(*[F.avg(f) for f in features]).alias("_m"),
        F.array(*[F.covar_pop(a, b) * F.count("*") for a, b in pairs]).alias("_gram"),
        F.array(*[F.covar_pop(f, target) * F.count("*") for f in features]).alias("_cross"))
    solve = _solver(tuple(alphas), len(features))
    solved = moments.withColumn("_all", solve("_gram", "_cross"))
    penalties = F.array(*[F.lit(float(a)) for a in alphas])
    each = solved.select(*keys, "_y", "_m", F.inline(F.arrays_zip(penalties.alias("alpha"), F.col("_all").alias("coef"))))
    shift = F.aggregate(F.zip_with("coef", "_m", lambda c, m: c * m), F.lit(0.0), lambda a, x: a + x)
    return each.select(*keys, "alpha", (F.col("_y") - shift).alias("intercept"), "coef")


def apply_linear(df: DataFrame, model: DataFrame, features: Sequence[str], keys: Sequence[str] = ("station",),
                 name: str = "fitted") -> DataFrame:
    """Linear predictions of every model row of the key (several penalties give several rows)."""
    value = F.col("intercept")
    for i, f in enumerate(features):
        value = value + F.col("coef")[i] * F.col(f)
    return df.join(model, list(keys)).withColumn(name, value).drop("intercept", "coef")


def correct_bias(df: DataFrame, train: Column, target: str, fitted: str = "fitted",
                 by: Sequence[str] = ("station",)) -> DataFrame:
    """Subtract the mean training residual of the group."""
    residual = F.when(train, F.col(fitted) - F.col(target))
    bias = df.groupBy(*by).agg(F.avg(residual).alias("bias"))
    return join_stats(df, bias, by).withColumn(fitted, F.col(fitted) - F.coalesce("bias", F.lit(0.0)))


def amount_from_log(fitted: Column, cap: float = LOG_CAP) -> Column:
    return F.expm1(fx.clip(fitted, 0.0, cap))


def choose_alpha(scored: DataFrame, validation: Column, actual: str, pred: str,
                 keys: Sequence[str] = ("station",)) -> DataFrame:
    """Penalty with the smallest validation error per key (the larger penalty wins ties)."""
    error = F.col(pred) - F.col(actual)
    losses = scored.where(validation & F.col(actual).isNotNull()).groupBy(*keys, "alpha").agg(
        F.avg(error * error).alias("loss"))
    return losses.groupBy(*keys).agg(F.min(F.struct("loss", (-F.col("alpha")).alias("a"))).alias("_best")).select(
        *keys, (-F.col("_best.a")).alias("alpha"))


def fit_line(df: DataFrame, x: str, y: str, where: Column, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Least-squares line per key: (keys, slope, intercept)."""
    return df.where(where).groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"),
                                              F.regr_intercept(y, x).alias("intercept"))


def quantile_map(train: DataFrame, other: DataFrame, keys: Sequence[str] = ("station",), actual: str = "actual",
                 pred: str = "pred", time: str = "date", name: str = "mapped") -> DataFrame:
    """Replace each prediction by the training actual at the prediction's rank among training predictions.

    Ranks come from cumulative counts; actuals are looked up by their index, so
    every step is an equi-join or a bounded sort.
    """
    fitted = train.where(F.col(actual).isNotNull() & F.col(pred).isNotNull())
    points = fitted.select(*keys, F.col(pred).alias("_v"), F.lit(1).cast("long").alias("_c")).unionByName(
        other.where(F.col(pred).isNotNull()).select(*keys, F.col(pred).alias("_v"), F.lit(0).cast("long").alias("_c")))
    values = points.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
    below = ordered_prefix(with_value_bucket(values, keys, "_v"), keys, ["_v"], F.col("_vb"), F.col("_c"), "_below", "_n")
    spots = below.select(*keys, F.col("_v").alias(pred), F.least(F.col("_below"), F.col("_n") - 1).alias("_i"))
    known = with_value_bucket(fitted.select(*keys, time, F.col(actual).alias("_a")), keys, "_a")
    ladder = ordered_prefix(known, keys, ["_a", time], F.col("_vb"), before="_i", total="_m").select(*keys, "_i", "_a")
    placed = other.join(spots, [*keys, pred], "left")
    return placed.join(ladder, [*keys, "_i"], "left").withColumn(name, F.col("_a")).drop("_i", "_m", "_a")
