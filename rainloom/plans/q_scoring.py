"""Metric, comparison and loss queries over simple reference predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.functions import scalars as fx
from rainloom.functions.aggregates import pearson
from rainloom.operators import features, impute, metrics, quality, split
from rainloom.operators.chunks import DENSE, over_halo
from rainloom.plans import views
from rainloom.plans.q_prepare import HOLDOUT
from rainloom.plans.registry import r6, register
from rainloom.plans.views import sql

SKILL = ("rmse", "mae", "r2", "nrmse_pct", "nmae_pct", "bias", "r")


def skill_sql(source: str, by: str = "", pooled: bool = True) -> str:
    keys = f"{by}, " if by else ""
    group = (f"GROUP BY GROUPING SETS (({keys}station), ({by}))" if pooled else f"GROUP BY {keys}station")
    name = "coalesce(station, 'OVERALL')" if pooled else "station"
    return f"""
SELECT {keys}{name} AS station, count(*) AS n, sqrt(avg((pred - actual) ** 2)) AS rmse,
       avg(abs(pred - actual)) AS mae,
       CASE WHEN var_pop(actual) > 0 THEN 1 - avg((pred - actual) ** 2) / var_pop(actual) END AS r2,
       sqrt(avg((pred - actual) ** 2)) / avg(actual) * 100 AS nrmse_pct,
       avg(abs(pred - actual)) / avg(actual) * 100 AS nmae_pct, avg(pred - actual) AS bias, corr(actual, pred) AS r
FROM {source} {group}"""


def rounded_sql(inner: str, keys: str) -> str:
    return f"SELECT {keys}, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in SKILL) + f" FROM ({inner})"


TRAILING = "(SELECT * FROM predictions WHERE model = 'trailing7')"


def trailing(spark, sf):
    return views.predictions(spark, sf).where("model = 'trailing7'")


@register("a19_metrics", sql("predictions", rounded_sql(skill_sql(TRAILING), "station")))
def a19(spark, sf):
    return r6(metrics.skill(trailing(spark, sf)), *SKILL)


@register("a20_multiscale_metrics", sql("scaled_predictions", rounded_sql(
    skill_sql("scaled_predictions", "model, scale"), "model, scale, station")))
def a20(spark, sf):
    return r6(metrics.skill(views.scaled_predictions(spark, sf), ["model", "scale"]), *SKILL)


@register("a21_lead_skill", sql("lead_predictions", f"""
SELECT horizon_day, round(avg(nrmse_pct), 6) AS nrmse_pct, round(avg(nmae_pct), 6) AS nmae_pct,
       round(avg(r2), 6) AS r2, count(*) AS n_stations
FROM ({skill_sql("lead_predictions", "horizon_day", pooled=False)}) GROUP BY horizon_day"""))
def a21(spark, sf):
    return r6(metrics.lead_skill(views.lead_predictions(spark, sf)), "nrmse_pct", "nmae_pct", "r2")


def rolling_sql(days: int, k: int) -> str:
    return sql("predictions", f"""
WITH t AS (SELECT station, count(*) OVER w AS n_in, avg(actual) OVER w AS actual, avg(pred) OVER w AS pred
    FROM predictions WHERE model = 'trailing7'
    WINDOW w AS (PARTITION BY station ORDER BY date RANGE BETWEEN INTERVAL {days - 1} DAYS PRECEDING AND CURRENT ROW))
SELECT station, n, round(r2, 6) AS r2, round(rmse, 6) AS rmse
FROM ({skill_sql(f"(SELECT * FROM t WHERE n_in >= {k})", pooled=False)})""")


@register("a22_weekly_rolling_skill", rolling_sql(7, 3))
def a22(spark, sf):
    return r6(metrics.rolling_skill(trailing(spark, sf), 7, 3), "r2", "rmse").select("station", "n", "r2", "rmse")


@register("a22_monthly_rolling_skill", rolling_sql(30, 10))
def a22b(spark, sf):
    return r6(metrics.rolling_skill(trailing(spark, sf), 30, 10), "r2", "rmse").select("station", "n", "r2", "rmse")


WET_SQL = """
SELECT {keys}, count(*) AS n, count(*) FILTER (actual > {t} AND pred > {t}) AS hits,
       count(*) FILTER (actual <= {t} AND pred > {t}) AS false_alarms,
       count(*) FILTER (actual > {t} AND pred <= {t}) AS misses,
       count(*) FILTER (actual <= {t} AND pred <= {t}) AS correct_dry
FROM predictions GROUP BY {keys}"""


@register("a23_wet_accuracy", sql("predictions", f"""
SELECT model, station, n, round((hits + correct_dry) / n, 6) AS accuracy
FROM ({WET_SQL.format(keys="model, station", t=0)})"""))
def a23(spark, sf):
    out = metrics.wet_skill(views.predictions(spark, sf), 0.0, ["model", "station"])
    return r6(out, "accuracy").select("model", "station", "n", "accuracy")


@register("a32_wet_confusion", sql("predictions", f"""
SELECT station, model, n, hits, false_alarms, misses, correct_dry, round((hits + correct_dry) / n, 6) AS accuracy,
       round(CASE WHEN hits + misses > 0 THEN hits / (hits + misses) END, 6) AS sensitivity,
       round(CASE WHEN correct_dry + false_alarms > 0 THEN correct_dry / (correct_dry + false_alarms) END, 6)
           AS specificity
FROM ({WET_SQL.format(keys="model, station", t=1.5)})"""))
def a32(spark, sf):
    out = metrics.wet_skill(views.predictions(spark, sf), 1.5, ["model", "station"])
    return r6(out, "accuracy", "sensitivity", "specificity")


@register("a24_bias_rmse", sql("predictions", """
SELECT model, station, round(avg(pred - actual), 6) AS bias, round(sqrt(avg((pred - actual) ** 2)), 6) AS rmse
FROM predictions GROUP BY 1, 2"""))
def a24(spark, sf):
    out = metrics.skill(views.predictions(spark, sf), ["model"], pooled=False)
    return r6(out, "bias", "rmse").select("model", "station", "bias", "rmse")


@register("a12_pearson_r", sql("predictions", """
SELECT model, station, round(corr(actual, pred), 6) AS r FROM predictions GROUP BY 1, 2"""))
def a12(spark, sf):
    return views.predictions(spark, sf).groupBy("model", "station").agg(
        F.round(pearson(F.col("actual"), F.col("pred")), 6).alias("r"))


@register("a30_masked_mse", sql("region_rain", f"""
WITH held AS ({HOLDOUT.format(f='0.2', view='region_rain')}),
c AS (SELECT value, holdout, avg(CASE WHEN holdout = 0 THEN value END) OVER (PARTITION BY date) AS pred FROM held)
SELECT round(sum((pred - value) ** 2) / count(*), 6) AS masked_mse, count(*) AS n_cells FROM c
WHERE holdout = 1 AND pred IS NOT NULL"""))
def a30(spark, sf):
    """Cells that were held out, against the mean of the other stations' known cells of the day."""
    held = views.cut_lineage(split.holdout_cells(views.region_rain(spark, sf), 0.2, 42))
    hidden = held.withColumnRenamed("value", "actual").withColumn("value", F.when(F.col("holdout") == 0, F.col("actual")))
    cells = impute.candidates(hidden, "date_mean").withColumnRenamed("candidate", "pred").where("pred IS NOT NULL")
    return r6(metrics.masked_mse(cells), "masked_mse")


def model_table(spark, sf):
    return metrics.skill(views.scaled_predictions(spark, sf), ["model", "scale"])


MODEL_SQL = skill_sql("scaled_predictions", "model, scale")


@register("u04_model_table", sql("scaled_predictions", f"""
SELECT model, scale, round(r2 * 100, 6) AS r2_pct, round(nrmse_pct, 6) AS nrmse_pct FROM ({MODEL_SQL})
WHERE station = 'OVERALL'"""))
def u04(spark, sf):
    pooled = model_table(spark, sf).where(f"station = '{quality.OVERALL}'")
    return r6(pooled.select("model", "scale", (F.col("r2") * 100).alias("r2_pct"), "nrmse_pct"), "r2_pct", "nrmse_pct")


@register("a31_model_delta", sql("scaled_predictions", f"""
WITH m AS ({MODEL_SQL})
SELECT m.model, m.station, m.scale, round(m.r2, 6) AS r2, round((m.r2 - b.r2) * 100, 6) AS delta_pp
FROM m JOIN m b ON b.station = m.station AND b.scale = m.scale AND b.model = 'persistence'
WHERE m.model <> 'persistence'"""))
def a31(spark, sf):
    return r6(metrics.compare_models(views.cut_lineage(model_table(spark, sf)), "persistence"), "r2", "delta_pp")


@register("l03_best_model", sql("scaled_predictions", f"""
SELECT station, scale, round(max(r2), 6) AS r2, arg_max(model, r2) AS best_model FROM ({MODEL_SQL})
GROUP BY station, scale"""))
def l03(spark, sf):
    return r6(metrics.best_model(model_table(spark, sf)), "r2")


TRAIN_END = views.cut_sql("region_filled")


@register("a33_climatology_baseline", sql("region_filled", f"""
WITH f AS (SELECT station, avg(value) AS m, CAST(count(*) FILTER (value > 0) * 2 > count(*) AS INT) AS w
           FROM region_filled WHERE imputed = 0 AND date < {TRAIN_END} GROUP BY station),
t AS (SELECT station, value AS actual, f.m AS pred, f.w FROM region_filled JOIN f USING (station)
      WHERE imputed = 0 AND date >= {TRAIN_END})
SELECT station, count(*) AS n, round(sqrt(avg((pred - actual) ** 2)), 6) AS rmse,
       round(1 - avg((pred - actual) ** 2) / var_pop(actual), 6) AS r2,
       round(avg(CASE WHEN (actual > 0) = (w = 1) THEN 1.0 ELSE 0.0 END), 6) AS majority_accuracy
FROM t GROUP BY station"""))
def a33(spark, sf):
    series = views.cut_lineage(views.region_filled(spark, sf))
    scored = metrics.climatology(quality.real_observations(series), F.col("date") < views.cuts(series)[0])
    skill = metrics.skill(scored.withColumnsRenamed({"value": "actual", "clim_mean": "pred"}), pooled=False)
    wet = metrics.wet_skill(scored.withColumnsRenamed({"value": "actual", "clim_wet": "pred"}), 0.0)
    return r6(skill.join(wet.select("station", F.col("accuracy").alias("majority_accuracy")), "station"),
              "rmse", "r2", "majority_accuracy").select("station", "n", "rmse", "r2", "majority_accuracy")


@register("u02_pooled_metrics", sql("predictions", rounded_sql(
    skill_sql("predictions", "model"), "model, station") + " WHERE station = 'OVERALL'"))
def u02(spark, sf):
    return r6(metrics.skill(views.predictions(spark, sf), ["model"]).where("station = 'OVERALL'"), *SKILL)


@register("m15_blend", sql("predictions", f"""
WITH b AS (SELECT station, date, max(actual) AS actual,
                  sum(pred * CASE model WHEN 'trailing7' THEN 0.5 ELSE 0.5 END) AS pred
           FROM predictions WHERE model IN ('trailing7', 'trailing30') GROUP BY 1, 2)
{rounded_sql("SELECT 'blend' AS model, * FROM (" + skill_sql("b") + ") UNION ALL " + skill_sql(
    "(SELECT * FROM predictions WHERE model IN ('trailing7', 'trailing30'))", "model"), "model, station")}"""))
def m15(spark, sf):
    parts = views.cut_lineage(views.predictions(spark, sf).where("model IN ('trailing7', 'trailing30')"))
    mixed = metrics.blend(parts, {"trailing7": 0.5, "trailing30": 0.5})
    return r6(metrics.skill(parts.unionByName(mixed), ["model"]), *SKILL)


@register("f15_hurdle_gate", sql("region_filled", """
SELECT station, date, round(CASE WHEN p > 0.4 THEN amount ELSE 0.0 END, 10) AS gated
FROM (SELECT station, date, avg(CAST(value > 0 AS INT)) OVER w AS p, avg(value) OVER w AS amount FROM region_filled
      WINDOW w AS (PARTITION BY station ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
WHERE p IS NOT NULL"""))
def f15(spark, sf):
    wet = views.region_filled(spark, sf).withColumn("wet", fx.wet(F.col("value"), 0.0).cast("double"))
    out = features.add_rolling(wet, [30], include_current=False)
    out = features.add_rolling(out, [30], column="wet", include_current=False, prefix="p_")
    return out.where("p_roll30 IS NOT NULL").select(
        "station", "date", F.round(fx.gate(F.col("roll30"), F.col("p_roll30"), 0.4), 10).alias("gated"))


LOSS_SQL = """
SELECT model, station, round(avg((1 + 3 * actual * actual) * (pred - actual) ** 2), 4) AS weighted_mse,
       round(avg(greatest(0.5 * (actual - pred), -0.5 * (actual - pred))), 6) AS pinball_50,
       round(avg(greatest(0.9::DOUBLE * (actual - pred), (0.9::DOUBLE - 1) * (actual - pred))), 6) AS pinball_90
FROM predictions GROUP BY 1, 2"""


@register("f16_weighted_error", sql("predictions", f"SELECT model, station, weighted_mse FROM ({LOSS_SQL})"))
def f16(spark, sf):
    out = metrics.losses(views.predictions(spark, sf), ["model", "station"])
    return out.select("model", "station", F.round("weighted_mse", 4).alias("weighted_mse"))


@register("f17_log_loss", sql("region_filled", """
WITH s AS (SELECT station, imputed, CAST(value > 1 AS DOUBLE) AS y, avg(CAST(value > 1 AS DOUBLE)) OVER (
               PARTITION BY station ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS share FROM region_filled),
p AS (SELECT station, y, greatest(least(share, 1 - 1e-7), 1e-7) AS p FROM s WHERE imputed = 0 AND share IS NOT NULL)
SELECT station, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM p GROUP BY station"""))
def f17(spark, sf):
    """The share of wet days among the thirty before as the probability of a wet day, on real days."""
    wet = fx.wet(F.col("value"), 1.0).cast("double")
    series = views.region_filled(spark, sf).withColumn("y", wet)
    known = over_halo(series, DENSE, lambda w: {"p": F.avg("y").over(w.rowsBetween(-30, -1))}, before=30).where("imputed = 0 AND p IS NOT NULL")
    return known.groupBy("station").agg(F.round(F.avg(fx.log_loss(F.col("y"), F.col("p"))), 6).alias("log_loss"))


@register("f18_pinball", sql("predictions", f"SELECT model, station, pinball_50, pinball_90 FROM ({LOSS_SQL})"))
def f18(spark, sf):
    out = metrics.losses(views.predictions(spark, sf), ["model", "station"])
    return r6(out, "pinball_50", "pinball_90").drop("weighted_mse")


@register("f19_percent_error", sql("predictions", """
SELECT model, station, round(sqrt(avg((pred - actual) ** 2)) / avg(actual) * 100, 6) AS nrmse_pct,
       round(avg(abs(pred - actual)) / avg(actual) * 100, 6) AS nmae_pct FROM predictions GROUP BY 1, 2"""))
def f19(spark, sf):
    out = metrics.skill(views.predictions(spark, sf), ["model"], pooled=False)
    return r6(out, "nrmse_pct", "nmae_pct").select("model", "station", "nrmse_pct", "nmae_pct")


@register("m19_real_rows_scored", sql("predictions", f"""
WITH late AS (SELECT * FROM predictions WHERE model = 'trailing7' AND date >= {views.cut_sql('predictions', True)}),
g AS (SELECT station, count(*) AS n_real FROM late GROUP BY station)
SELECT station, n_real, CASE WHEN n_real < 30 THEN 'sensor_offline' ELSE 'scored' END AS status,
       CASE WHEN n_real >= 30 THEN round(r2, 6) END AS r2
FROM g JOIN ({skill_sql("late", pooled=False)}) USING (station)"""))
def m19(spark, sf):
    rows = views.cut_lineage(trailing(spark, sf))
    late = rows.where(F.col("date") >= views.cuts(rows)[1])
    scored = metrics.skill(late, pooled=False)
    offline = F.col("n") < 30
    return scored.select("station", F.col("n").alias("n_real"),
                         F.when(offline, "sensor_offline").otherwise("scored").alias("status"),
                         F.when(~offline, F.round("r2", 6)).alias("r2"))


@register("s11_wide_predictions", sql("scaled_predictions", "SELECT date, " + ", ".join(
    f"max(CASE WHEN station = '{s}' AND scale = '{c}' THEN {v} END) AS s{s}_{c}_{n}"
    for s in views.REGION_STATIONS for c in ("daily", "weekly", "monthly")
    for v, n in (("actual", "actual"), ("pred", "predicted")))
    + " FROM scaled_predictions WHERE model = 'trailing7' GROUP BY date"))
def s11(spark, sf):
    from rainloom.sources.sinks import wide_predictions

    rows = views.scaled_predictions(spark, sf).where("model = 'trailing7'").withColumn(
        "station", F.concat(F.lit("s"), "station"))
    return wide_predictions(rows, [f"s{s}" for s in views.REGION_STATIONS], ["daily", "weekly", "monthly"])


@register("s12_horizon_predictions", sql("lead_predictions", "SELECT date, horizon_day, "
          "date + CAST(horizon_day - 1 AS INT) AS forecast_date, " + ", ".join(
    f"max(CASE WHEN station = '{s}' THEN {v} END) AS s{s}_{n}" for s in views.REGION_STATIONS
    for v, n in (("actual", "actual"), ("pred", "predicted"))) + " FROM lead_predictions GROUP BY date, horizon_day"))
def s12(spark, sf):
    from rainloom.sources.sinks import horizon_predictions

    rows = views.lead_predictions(spark, sf).withColumn("station", F.concat(F.lit("s"), "station"))
    return horizon_predictions(rows, [f"s{s}" for s in views.REGION_STATIONS])


@register("s13_result_sink", sql("predictions", f"""
SELECT station, n, round(r2, 6) AS r2, round(rmse, 6) AS rmse FROM ({skill_sql(TRAILING, pooled=False)})"""))
def s13(spark, sf):
    """Write the scores of every station as JSON objects, then read them."""
    from rainloom.session import scratch_path
    from rainloom.sources import sinks

    path = scratch_path(spark)
    scores = metrics.skill(trailing(spark, sf), pooled=False).select("station", "n", "r2", "rmse")
    sinks.write_results(r6(scores, "r2", "rmse"), path)
    return spark.read.schema("station string, n long, r2 double, rmse double").json(path)
