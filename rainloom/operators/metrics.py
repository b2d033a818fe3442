"""Skill metrics, wet/dry scores, lead and rolling skill, model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.functions import scalars as fx
from rainloom.functions.aggregates import pearson
from rainloom.operators.chunks import DAILY, Axis
from rainloom.operators.features import add_time_rolling
from rainloom.operators.joins import join_stats
from rainloom.operators.quality import with_overall


def skill_columns(actual: str = "actual", pred: str = "pred") -> list[Column]:
    """RMSE, MAE, R2, NRMSE %, NMAE %, bias, r and n in one aggregation.

    The total sum of squares comes from ``var_pop`` (running central moments),
    which does not cancel when the actuals are nearly constant.  R2 may be
    negative, and is NULL when the actuals are constant.
    """
    both = F.col(actual).isNotNull() & F.col(pred).isNotNull()
    a, p = F.when(both, F.col(actual)), F.when(both, F.col(pred))
    e = p - a
    rmse, mae, mean, n = F.sqrt(F.avg(e * e)), F.avg(F.abs(e)), F.avg(a), F.count(a)
    sst = F.var_pop(a)
    return [n.alias("n"), rmse.alias("rmse"), mae.alias("mae"),
            F.when(sst > 0, F.lit(1.0) - F.avg(e * e) / sst).alias("r2"),
            fx.percent_of(rmse, mean).alias("nrmse_pct"), fx.percent_of(mae, mean).alias("nmae_pct"),
            F.avg(e).alias("bias"), pearson(a, p).alias("r")]


def skill(df: DataFrame, by: Sequence[str] = (), actual: str = "actual", pred: str = "pred",
          pooled: bool = True) -> DataFrame:
    """Metric table per ``by`` and station; ``pooled`` adds an OVERALL row over all points."""
    columns = skill_columns(actual, pred)
    return with_overall(df, columns, by) if pooled else df.groupBy(*by, "station").agg(*columns)


def rolling_skill(df: DataFrame, days: int, min_obs: int, axis: Axis = DAILY, pooled: bool = False,
                  by: Sequence[str] = ()) -> DataFrame:
    """Skill of the trailing ``days``-day means; rows are the real test days only."""
    rolled = add_time_rolling(df, days, min_obs, {"actual": "_a", "pred": "_p"}, axis)
    return skill(rolled.where("_a IS NOT NULL AND _p IS NOT NULL"), by, "_a", "_p", pooled)


def lead_skill(df: DataFrame, lead: str = "horizon_day") -> DataFrame:
    """Mean over stations of the per-station scores, for each lead day."""
    each = skill(df, [lead], pooled=False)
    return each.groupBy(lead).agg(F.avg("nrmse_pct").alias("nrmse_pct"), F.avg("nmae_pct").alias("nmae_pct"),
                                  F.avg("r2").alias("r2"), F.count("*").alias("n_stations"))


def wet_skill(df: DataFrame, threshold: float = 0.0, by: Sequence[str] = ("station",), actual: str = "actual",
              pred: str = "pred") -> DataFrame:
    """Accuracy, sensitivity, specificity and the four confusion counts of the wet class."""
    a, p = F.col(actual) > threshold, F.col(pred) > threshold
    counts = df.where(a.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(a & p).alias("hits"), F.count_if(~a & p).alias("false_alarms"),
        F.count_if(a & ~p).alias("misses"), F.count_if(~a & ~p).alias("correct_dry"))
    hits, dry = F.col("hits"), F.col("correct_dry")
    wet_days, dry_days = hits + F.col("misses"), dry + F.col("false_alarms")
    return counts.withColumns({
        "accuracy": (hits + dry) / F.col("n"), "sensitivity": F.when(wet_days > 0, hits / wet_days),
        "specificity": F.when(dry_days > 0, dry / dry_days)})


def masked_mse(df: DataFrame, mask: str = "holdout", actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Squared error over the masked cells only."""
    error = F.col(pred) - F.col(actual)
    m = F.col(mask).cast("double")
    return df.agg(F.try_divide(F.sum(m * error * error), F.sum(m)).alias("masked_mse"), F.sum(mask).cast("long").alias("n_cells"))


def losses(df: DataFrame, by: Sequence[str], alpha: float = 3.0, quantiles: Sequence[float] = (0.5, 0.9),
           actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Mean extreme-weighted squared error and mean pinball losses."""
    a, p = F.col(actual), F.col(pred)
    return df.groupBy(*by).agg(
        F.avg(fx.weighted_square_error(a, p, alpha)).alias("weighted_mse"),
        *[F.avg(fx.pinball(a, p, q)).alias(f"pinball_{int(q * 100)}") for q in quantiles])


def compare_models(metrics: DataFrame, baseline: str, by: Sequence[str] = ("station", "scale"),
                   metric: str = "r2") -> DataFrame:
    """Each model's metric minus the baseline model's, in percentage points."""
    base = metrics.where(F.col("model") == baseline).select(*by, F.col(metric).alias("_base"))
    return metrics.where(F.col("model") != baseline).join(base, list(by)).select(
        "model", *by, metric, ((F.col(metric) - F.col("_base")) * 100).alias("delta_pp"))


def best_model(metrics: DataFrame, by: Sequence[str] = ("station", "scale"), metric: str = "r2") -> DataFrame:
    """The model with the highest metric per group; equal scores go to the first name."""
    scored = metrics.where(F.col(metric).isNotNull())
    top = scored.groupBy(*by).agg(F.max(metric).alias(metric),
                                  F.min(F.struct((-F.col(metric)).alias("s"), "model")).alias("_top"))
    return top.select(*by, metric, F.col("_top.model").alias("best_model"))


def climatology(df: DataFrame, train: Column, value: str = "value", threshold: float = 0.0) -> DataFrame:
    """Station mean and majority wet/dry class of the training rows, joined to the other rows."""
    x = F.col(value)
    fitted = df.where(train).groupBy("station").agg(
        F.avg(x).alias("clim_mean"),
        (F.count_if(x > threshold) * 2 > F.count(x)).cast("int").alias("clim_wet"))
    return join_stats(df.where(~train), fitted, ["station"])


def blend(predictions: DataFrame, weights: dict[str, float], name: str = "blend",
          keys: Sequence[str] = ("station", "date")) -> DataFrame:
    """Weighted mean of the named models' predictions, where all of them exist."""
    total = sum(weights.values())
    share = F.create_map(*[c for m, w in weights.items() for c in (F.lit(m), F.lit(w / total))])
    return predictions.where(F.col("model").isin(list(weights))).groupBy(*keys).agg(
        F.max("actual").alias("actual"), F.sum(F.col("pred") * share[F.col("model")]).alias("pred"),
        F.count("pred").alias("_n")).where(F.col("_n") == len(weights)).drop("_n").withColumn("model", F.lit(name))
