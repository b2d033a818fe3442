"""Model queries: monthly regressions, learned imputation, forecasters, search and importance."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rainloom.functions import scalars as fx
from rainloom.operators import boosting, features, learners, metrics, monthly, quality, rollup, split
from rainloom.operators.chunks import MONTHLY, over_halo
from rainloom.plans import views
from rainloom.plans.registry import r6, register
from rainloom.plans.views import cut_lineage, sql

# The ceiling of boosting rounds, depth and step; validation rows stop earlier.
FULL = learners.TreeSettings(rounds=400, depth=5, step=0.05, tolerance=1e-4)

#: Fewest real test days of a station with a hurdle model of its own; fewest test months of one with monthly scores.
LEAST_DAYS, LEAST_MONTHS = 20, 5

# ---------------------------------------------------------------- monthly models


TRAIN_UNTIL, VAL_UNTIL = views.cut_sql("mf", time="month"), views.cut_sql("mf", True, "month")
DAYS_UNTIL = views.cut_sql("predictions")


def month_frame(spark, sf):
    months = rollup.monthly_real_totals(views.region_filled(spark, sf), 15)
    covariates = rollup.monthly_covariates(views.covar(spark, sf), {"cv_tp": "sum"})
    frame = months.join(covariates, "month").withColumn("log_tp", F.round(F.log1p("cv_tp"), 9))
    frame = over_halo(frame, MONTHLY, lambda w: {"lag1m": F.lag("total", 1).over(w)}, before=1)
    return frame.select("station", "month", F.round("total", 6).alias("total"), "log_tp",
                        F.round(F.log1p(F.coalesce("lag1m", F.lit(0.0))), 9).alias("log_lag1m"),
                        F.log1p(F.round("total", 6)).alias("y"))


MONTHS = """
t AS (SELECT station, CAST(date_trunc('month', date) AS DATE) AS month,
             CASE WHEN count(*) FILTER (imputed = 0) >= 15 THEN sum(value) FILTER (imputed = 0) END AS total
      FROM region_filled GROUP BY 1, 2),
c AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(cv_tp) AS cv_tp FROM covar GROUP BY 1),
mf AS (SELECT station, month, round(total, 6) AS total, round(ln(1 + cv_tp), 9) AS log_tp,
              round(ln(1 + coalesce(lag(total) OVER (PARTITION BY station ORDER BY month), 0)), 9) AS log_lag1m,
              ln(1 + round(total, 6)) AS y
       FROM t JOIN c USING (month))"""


@register("m13_log_linear_month", sql(["region_filled", "covar"], f"""
WITH {MONTHS.strip()},
f AS (SELECT station, regr_slope(y, log_tp) AS slope, regr_intercept(y, log_tp) AS intercept FROM mf
      WHERE month < {TRAIN_UNTIL} AND y IS NOT NULL GROUP BY station)
SELECT station, month, total, round(exp(greatest(least(intercept + slope * log_tp, 8), 0)) - 1, 6) AS pred
FROM mf JOIN f USING (station) WHERE month >= {VAL_UNTIL}"""))
def m13(spark, sf):
    frame = cut_lineage(month_frame(spark, sf))
    val_from, test_from = views.cuts(frame, "month")
    line = monthly.fit_line(frame, "log_tp", "y", (F.col("month") < val_from) & F.col("y").isNotNull())
    scored = frame.where(F.col("month") >= test_from).join(line, "station")
    fitted = F.col("intercept") + F.col("slope") * F.col("log_tp")
    return scored.select("station", "month", "total", F.round(monthly.amount_from_log(fitted), 6).alias("pred"))


RIDGE = f"""
WITH {MONTHS.strip()},
tr AS (SELECT * FROM mf WHERE month < {TRAIN_UNTIL} AND y IS NOT NULL),
mo AS (SELECT station, count(*) AS n, avg(log_tp) AS m1, avg(log_lag1m) AS m2, avg(y) AS my,
              var_pop(log_tp) * count(*) AS s11, var_pop(log_lag1m) * count(*) AS s22,
              covar_pop(log_tp, log_lag1m) * count(*) AS s12, covar_pop(log_tp, y) * count(*) AS c1,
              covar_pop(log_lag1m, y) * count(*) AS c2 FROM tr GROUP BY station),
al AS (SELECT CAST(unnest([0.5, 1.0, 5.0, 10.0, 50.0]) AS DOUBLE) AS alpha),
co AS (SELECT *, ((s22 + alpha) * c1 - s12 * c2) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS b1,
              ((s11 + alpha) * c2 - s12 * c1) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS b2 FROM mo CROSS JOIN al),
fi AS (SELECT station, month, total, y, alpha, my + b1 * (log_tp - m1) + b2 * (log_lag1m - m2) AS fitted
       FROM mf JOIN co USING (station)),
bi AS (SELECT station, alpha, avg(fitted - y) AS bias FROM fi WHERE month < {TRAIN_UNTIL} GROUP BY 1, 2),
pr AS (SELECT station, month, total, alpha, exp(greatest(least(fitted - bias, 8), 0)) - 1 AS pred
       FROM fi JOIN bi USING (station, alpha)),
lo AS (SELECT station, alpha, avg((pred - total) ** 2) AS loss FROM pr
       WHERE month >= {TRAIN_UNTIL} AND month < {VAL_UNTIL} AND total IS NOT NULL GROUP BY 1, 2),
be AS (SELECT station, alpha FROM lo QUALIFY row_number() OVER (PARTITION BY station ORDER BY loss, alpha DESC) = 1)"""


def full_month_frame(spark, sf):
    """``month_frame`` with all features of the monthly model, and their names; what is missing counts as 0."""
    daily = views.covar(spark, sf)
    means = [c for c in daily.columns if c not in ("date", "cv_tp")]
    more = rollup.monthly_covariates(daily, {c: "avg" for c in means})
    frame = month_frame(spark, sf).join(more, "month")
    frame = over_halo(frame, MONTHLY, lambda w: {"lag1m": F.lag("total", 1).over(w)}, before=1)
    angle = F.month("month") * (2 * math.pi / 12)
    waves = {"sin_m": F.sin(angle), "cos_m": F.cos(angle), "sin_2m": F.sin(2 * angle), "cos_2m": F.cos(2 * angle)}
    names = ["log_tp", *means, *waves, "lag1m", "log_lag1m"]
    return frame.withColumns(waves).fillna(0.0, names), names


def ridge_predictions(spark, sf, frame=None, names=("log_tp", "log_lag1m")):
    frame = cut_lineage(month_frame(spark, sf) if frame is None else frame)
    names = list(names)
    val_from, test_from = views.cuts(frame, "month")
    trained = F.col("month") < val_from
    model = monthly.fit_ridge(frame, names, "y", where=trained)
    fitted = monthly.apply_linear(frame, cut_lineage(model), names)
    fitted = monthly.correct_bias(fitted, trained & F.col("y").isNotNull(), "y", by=["station", "alpha"])
    scored = cut_lineage(fitted.withColumn("pred", monthly.amount_from_log(F.col("fitted"))))
    checked = (F.col("month") >= val_from) & (F.col("month") < test_from)
    chosen = scored.join(monthly.choose_alpha(scored, checked, "total", "pred"), ["station", "alpha"])
    return chosen.where(F.col("month") >= test_from)


@register("m12_monthly_ridge", sql(["region_filled", "covar"], RIDGE + f"""
SELECT station, month, alpha, total, round(pred, 6) AS pred FROM pr JOIN be USING (station, alpha)
WHERE month >= {VAL_UNTIL}"""))
def m12(spark, sf):
    test = ridge_predictions(spark, sf)
    return r6(test.select("station", "month", "alpha", "total", "pred"), "pred")


@register("m12_ridge_scores", sql(["region_filled", "covar"], RIDGE + f"""
SELECT station, count(total) AS n, round(1 - avg((pred - total) ** 2) / var_pop(total), 6) AS r2,
       round(sqrt(avg((pred - total) ** 2)), 6) AS rmse, round(avg(pred - total), 6) AS bias
FROM pr JOIN be USING (station, alpha) WHERE month >= {VAL_UNTIL} AND total IS NOT NULL GROUP BY station"""))
def m12b(spark, sf):
    test = ridge_predictions(spark, sf).where("total IS NOT NULL")
    scored = metrics.skill(test.withColumnRenamed("total", "actual"), pooled=False)
    return r6(scored.select("station", "n", "r2", "rmse", "bias"), "r2", "rmse", "bias")


def solved_sql(p: int) -> str:
    """Gauss-Jordan steps over the augmented systems ``g0`` (station, alpha, a), one after the other."""
    return ",\n".join(f"""g{k} AS (SELECT station, alpha, list_transform(a, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda x: x / r[{k}])
    ELSE list_transform(r, lambda x, j: x - r[{k}] / a[{k}][{k}] * a[{k}][j]) END) AS a FROM g{k - 1})""" for k in range(1, p + 1))


#: Features of the monthly model in SQL, in the order of ``full_month_frame``.
MONTH_FEATURES = ("log_tp", "cv_disc", "cv_tax", "sin(w)", "cos(w)", "sin(2 * w)", "cos(2 * w)", "lag1m", "log_lag1m")
_P = len(MONTH_FEATURES)
FULL_RIDGE = f"""
WITH {MONTHS.strip()},
mm AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, avg(cv_disc) AS cv_disc, avg(cv_tax) AS cv_tax FROM covar GROUP BY 1),
mg AS (SELECT mf.*, cv_disc, cv_tax, lag(total) OVER (PARTITION BY station ORDER BY month) AS lag1m, month(month) * (2 * pi() / 12) AS w
       FROM mf JOIN mm USING (month)),
ff AS (SELECT station, month, total, y, [{', '.join(f'coalesce({c}, 0.0)::DOUBLE' for c in MONTH_FEATURES)}] AS f FROM mg),
tr AS (SELECT * FROM ff WHERE month < {TRAIN_UNTIL} AND y IS NOT NULL),
ks AS (SELECT unnest(range(1, {_P + 1})) AS i),
mi AS (SELECT station, i, avg(f[i]) AS m FROM tr CROSS JOIN ks GROUP BY ALL),
me AS (SELECT station, list(m ORDER BY i) AS m, (SELECT avg(y) FROM tr z WHERE z.station = mi.station) AS my FROM mi GROUP BY station),
ce AS (SELECT tr.station, list_transform(f, lambda x, i: x - m[i]) AS x, y - my AS v FROM tr JOIN me USING (station)),
sij AS (SELECT station, a.i AS i, b.i AS j, sum(x[a.i] * x[b.i]) AS s FROM ce CROSS JOIN ks a CROSS JOIN ks b GROUP BY ALL),
ci AS (SELECT station, i, sum(x[i] * v) AS c FROM ce CROSS JOIN ks GROUP BY ALL),
al AS (SELECT CAST(unnest([0.5, 1.0, 5.0, 10.0, 50.0]) AS DOUBLE) AS alpha),
ro AS (SELECT station, alpha, i, list_append(list(s + CASE WHEN i = j THEN alpha ELSE 0 END ORDER BY j), any_value(c)) AS r
       FROM sij JOIN ci USING (station, i) CROSS JOIN al GROUP BY station, alpha, i),
g0 AS (SELECT station, alpha, list(r ORDER BY i) AS a FROM ro GROUP BY ALL),
{solved_sql(_P)},
fi AS (SELECT station, month, total, y, alpha,
              my + list_sum(list_transform(f, lambda x, i: (x - m[i]) * a[i][{_P + 1}])) AS fitted
       FROM ff JOIN me USING (station) JOIN g{_P} USING (station)),
bi AS (SELECT station, alpha, avg(fitted - y) AS bias FROM fi WHERE month < {TRAIN_UNTIL} GROUP BY 1, 2),
pr AS (SELECT station, month, total, alpha, exp(greatest(least(fitted - bias, 8), 0)) - 1 AS pred FROM fi JOIN bi USING (station, alpha)),
lo AS (SELECT station, alpha, avg((pred - total) ** 2) AS loss FROM pr
       WHERE month >= {TRAIN_UNTIL} AND month < {VAL_UNTIL} AND total IS NOT NULL GROUP BY 1, 2),
be AS (SELECT station, alpha FROM lo QUALIFY row_number() OVER (PARTITION BY station ORDER BY loss, alpha DESC) = 1),
sc AS (SELECT station, count(total) AS n, 1 - avg((pred - total) ** 2) / var_pop(total) AS r2, sqrt(avg((pred - total) ** 2)) AS rmse,
              avg(pred - total) AS bias FROM pr JOIN be USING (station, alpha) WHERE month >= {VAL_UNTIL} AND total IS NOT NULL GROUP BY station)
SELECT station, n, CASE WHEN n >= {LEAST_MONTHS} THEN round(r2, 6) END AS r2, CASE WHEN n >= {LEAST_MONTHS} THEN round(rmse, 6) END AS rmse,
       CASE WHEN n >= {LEAST_MONTHS} THEN round(bias, 6) END AS bias,
       CASE WHEN n >= {LEAST_MONTHS} THEN 'scored' ELSE 'insufficient_test_months' END AS status FROM sc"""


@register("m12_full_ridge_scores", sql(["region_filled", "covar"], FULL_RIDGE))
def m12_full(spark, sf):
    """Ridge on all monthly features; a station of fewer than ``LEAST_MONTHS`` test months has a status and no scores."""
    test = ridge_predictions(spark, sf, *full_month_frame(spark, sf)).where("total IS NOT NULL")
    scored = metrics.skill(test.withColumnRenamed("total", "actual"), pooled=False)
    enough = F.col("n") >= LEAST_MONTHS
    return scored.select("station", "n", *(F.when(enough, F.round(c, 6)).alias(c) for c in ("r2", "rmse", "bias")),
                         F.when(enough, "scored").otherwise("insufficient_test_months").alias("status"))


@register("m14_bias_correction", sql("predictions", f"""
WITH b AS (SELECT model, station, avg(pred - actual) AS bias FROM predictions WHERE date < {DAYS_UNTIL} GROUP BY 1, 2)
SELECT model, station, count(*) AS n, round(any_value(bias), 6) AS bias,
       round(sqrt(avg((greatest(pred - bias, 0) - actual) ** 2)), 6) AS rmse
FROM predictions JOIN b USING (model, station) WHERE date >= {DAYS_UNTIL} GROUP BY 1, 2"""))
def m14(spark, sf):
    rows = cut_lineage(views.predictions(spark, sf))
    trained = F.col("date") < views.cuts(rows)[0]
    fixed = monthly.correct_bias(rows, trained, "actual", "pred", ["model", "station"]).where(~trained)
    scored = metrics.skill(fixed.withColumn("pred", fx.floor_at(F.col("pred"), 0.0)), ["model"], pooled=False)
    bias = fixed.groupBy("model", "station").agg(F.max("bias").alias("train_bias"))
    return r6(scored.drop("bias").join(bias, ["model", "station"]).select(
        "model", "station", "n", F.col("train_bias").alias("bias"), "rmse"), "bias", "rmse")


@register("m20_quantile_mapping", sql("predictions", f"""
WITH p AS (SELECT * FROM predictions WHERE model = 'trailing30'),
tr AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY actual) - 1 AS i,
              count(*) OVER (PARTITION BY station) AS n FROM p WHERE date < {DAYS_UNTIL}),
te AS (SELECT station, date, actual, pred, (SELECT least(count(*), (SELECT max(n) - 1 FROM tr z WHERE z.station = a.station))
                                            FROM tr b WHERE b.station = a.station AND b.pred < a.pred) AS i
       FROM p a WHERE date >= {DAYS_UNTIL})
SELECT te.station, te.date, te.actual, te.pred, tr.actual AS mapped FROM te JOIN tr ON tr.station = te.station AND tr.i = te.i"""))
def m20(spark, sf):
    rows = cut_lineage(views.predictions(spark, sf).where("model = 'trailing30'").drop("model"))
    trained = F.col("date") < views.cuts(rows)[0]
    return monthly.quantile_map(rows.where(trained), rows.where(~trained)).select(
        "station", "date", "actual", "pred", "mapped")


# ---------------------------------------------------------------- learned imputation


def learned_cells(spark, sf, seeds):
    """Hidden holdout cells with the ensemble's and its first member's predictions."""
    held = cut_lineage(split.holdout_cells(views.region_rain(spark, sf), 0.2, 42)).withColumn(
        "known", F.when(F.col("holdout") == 0, F.col("value")))
    fitted = learners.LearnedImputer(seeds=seeds).fit(held, "known")
    return fitted.predict(held, "known", F.col("holdout") == 1)


@register("m03_learned_imputer")
def m03(spark, sf):
    fitted = learners.LearnedImputer()
    series = cut_lineage(views.region_rain(spark, sf))
    return learners.learned_impute(series, fitted, digits=4)


@register("m04_seed_ensemble")
def m04(spark, sf):
    cells = learned_cells(spark, sf, learners.SEEDS).select("station", F.col("value").alias("actual"), "single", "candidate")
    long = cells.select("station", "actual", F.inline(F.array(
        F.struct(F.lit("single").alias("model"), F.col("single").alias("pred")),
        F.struct(F.lit("ensemble").alias("model"), F.col("candidate").alias("pred")))))
    return metrics.skill(long, ["model"])


# ---------------------------------------------------------------- forecasters


def forecast_frame(spark, sf):
    """Feature frame with targets and split labels, written once."""
    series = split.chronological_split(cut_lineage(views.region_filled(spark, sf)))
    series, extra = learners.station_encoding(series, F.col("split") == "train")
    series = features.add_targets(series, [1, 7, 30], start=0)
    frame, names = learners.tabular_features(series, views.covar_table(spark, sf))
    return cut_lineage(frame.withColumn("is_val", F.col("split") == "val")), [*names, *extra]


@register("m07_multi_horizon")
def m07(spark, sf):
    frame, names = forecast_frame(spark, sf)
    models = learners.fit_horizons(frame.where("split <> 'test'"), names, settings=FULL, validation="is_val", purge=True)
    scored = learners.predict_horizons(frame.where("split = 'test' AND imputed = 0"), models)
    return metrics.skill(scored, ["horizon"])


#: Days of the lead-day model.
LEADS = 14


def lead_scores(spark, sf):
    """Test origins and lead days of the embargoed split whose value was observed: (station, date, horizon_day, actual, pred)."""
    frame, names = forecast_frame(spark, sf)
    rows = learners.embargoed(learners.lead_frame(frame, LEADS, "imputed"), *views.cuts(views.region_filled(spark, sf)), LEADS)
    rows = cut_lineage(rows.withColumn("is_val", F.col("split") == "val"))
    model = learners.fit_lead_model(rows.where("split <> 'test'"), names, FULL, validation="is_val")
    return model.transform(rows.where("split = 'test'")).select(
        "station", "date", "horizon_day", F.col("value").alias("actual"), fx.from_log(F.col("prediction")).alias("pred"))


@register("m08_lead_day_model")
def m08(spark, sf):
    return metrics.lead_skill(lead_scores(spark, sf))


def hurdle_rows(spark, sf):
    frame, names = forecast_frame(spark, sf)
    return quality.real_observations(frame), names


def station_rows(spark, sf):
    """Real rows with the lags and trailing means of the four best correlated stations as further features."""
    frame, names = forecast_frame(spark, sf)
    near = learners.ranked_neighbours(frame, (F.col("split") == "train") & (F.col("imputed") == 0))
    own = [f"lag{k}" for k in learners.LAGS] + [f"roll{n}" for n in learners.WINDOWS]
    wide, more = learners.neighbour_features(frame, near, own)
    return cut_lineage(quality.real_observations(wide)), [*names, *more]


def station_hurdles(spark, sf):
    real, names = station_rows(spark, sf)
    return real, boosting.fit_station_hurdles(real.where("split <> 'test'"), names, validation="is_val")


def station_support(spark, sf, test):
    """(station, n, status) of every station by its real test rows."""
    support = cut_lineage(quality.support_status(test, LEAST_DAYS).withColumnRenamed("n_real", "n"))
    stations = views.region_filled(spark, sf).select("station").distinct()
    return stations.join(support, "station", "left").na.fill({"n": 0, "status": "sensor_offline"})


@register("m09_hurdle")
def m09(spark, sf):
    """A hurdle model for every station, all fitted in one job."""
    real, model = station_hurdles(spark, sf)
    return model.transform(real.where("split = 'test'")).select(
        "station", "date", F.col("value").alias("actual"), "p_wet", "pred")


@register("m09_hurdle_per_station")
def m09b(spark, sf):
    """Stations of fewer than ``LEAST_DAYS`` real test days are not fitted: they have a status and no scores."""
    real, names = station_rows(spark, sf)
    status = cut_lineage(station_support(spark, sf, real.where("split = 'test'")))
    rows = real.join(status.where("status = 'scored'").select("station"), "station", "left_semi")
    model = boosting.fit_station_hurdles(rows.where("split <> 'test'"), names, validation="is_val")
    scored = model.transform(rows.where("split = 'test'")).withColumnRenamed("value", "actual")
    return status.join(metrics.skill(scored, pooled=False).drop("n"), "station", "left")


@register("m09_pooled_hurdle")
def m09c(spark, sf):
    """One hurdle model over the rows of all stations."""
    real, names = hurdle_rows(spark, sf)
    model = learners.fit_hurdle(real.where("split <> 'test'"), names, validation="is_val", settings=FULL)
    return model.transform(real.where("split = 'test'")).select(
        "station", "date", F.col("value").alias("actual"), "p_wet", "pred")


@register("m10_gated_hurdle")
def m10(spark, sf):
    real, names = hurdle_rows(spark, sf)
    model = learners.fit_hurdle(real.where("split <> 'test'"), names, validation="is_val", gate=0.4, alpha=3.0,
                                threshold=0.5, settings=FULL)
    scored = model.transform(real.where("split = 'test'")).withColumnRenamed("value", "actual")
    return metrics.skill(scored).join(metrics.wet_skill(scored, 0.5).select("station", "accuracy"), "station", "left")


@register("m11_early_stopping")
def m11(spark, sf):
    """Every boosting round of every station's two models with its validation loss, and whether it is kept."""
    return station_hurdles(spark, sf)[1].rounds()


# Eight trials of depth, step and least weight of a leaf; the rounds of the first rung double on each next.
TRIALS = {k: boosting.BoostSettings(depth=d, step=s, least_weight=w) for k, (d, s, w) in enumerate(
    [(3, 0.02, 5.0), (3, 0.05, 5.0), (3, 0.1, 3.0), (4, 0.05, 3.0), (5, 0.02, 3.0), (5, 0.05, 5.0), (5, 0.1, 5.0), (6, 0.05, 10.0)])}
FIRST_ROUNDS = 25


@register("m16_parameter_search")
def m16(spark, sf):
    """Successive halving of eight trials on the chronological validation part: every trial of every rung."""
    frame, names = forecast_frame(spark, sf)
    rows = quality.real_observations(frame).where("split <> 'test'").withColumn("y", F.log1p("value"))
    settings = F.create_map(*[F.lit(x) for k, t in TRIALS.items() for x in (k, f"{t.depth}|{t.step}|{t.least_weight}")])
    found = boosting.successive_halving(rows, names, "y", TRIALS, "is_val", first_rounds=FIRST_ROUNDS)
    part = F.split(settings[F.col("trial")], "\\|")
    return found.select("rung", "trial", "rounds", part[0].cast("int").alias("depth"), part[1].cast("double").alias("step"),
                        part[2].cast("double").alias("least_weight"), F.col("loss").alias("validation_rmse"), "promoted", "chosen")


def fitted_daily(spark, sf, planted=False):
    """Rows, feature names and a fitted model of the day's value; ``planted`` adds the answer and a number drawn from a hash."""
    frame, names = forecast_frame(spark, sf)
    rows = frame.withColumn("y", F.log1p("value"))
    if planted:
        noise = F.pmod(F.xxhash64("station", "date"), F.lit(1000)) / 1000.0
        rows, names = cut_lineage(rows.withColumns({"planted": F.col("y"), "noise": noise})), [*names, "planted", "noise"]
    training = learners.small_parts(cut_lineage(rows.where("split <> 'test'").select(*names, "y", "is_val")))
    return rows, names, learners.regressor(names, "y", FULL, 42, validation="is_val").fit(training)


@register("m17_permutation_importance")
def m17(spark, sf):
    rows, names, model = fitted_daily(spark, sf)
    return learners.permutation_importance(model, rows.where("split = 'test'"), names, "y")


@register("l05_top_features")
def l05(spark, sf):
    rows, names, model = fitted_daily(spark, sf)
    return learners.top_features(learners.tree_importance(model, names, rows), 5)


@register("m18_batch_scoring")
def m18(spark, sf):
    rows, names, model = fitted_daily(spark, sf)
    return model.transform(rows).select("station", "date", fx.from_log(F.col("prediction")).alias("pred"))


@register("m21_confidence_weights")
def m21(spark, sf):
    frame, names = forecast_frame(spark, sf)
    models = learners.fit_horizons(frame.where("split <> 'test'"), names, (1,), FULL,
                                   weight=learners.observation_weight(0.3), validation="is_val")
    return metrics.skill(learners.predict_horizons(frame.where("split = 'test' AND imputed = 0"), models), ["horizon"])


# ---------------------------------------------------------------- contracts
# What holds for any well-fitted model: which rows are scored, what they were compared with, and the range of results.


def test_rows(target: str, by: str = "station") -> str:
    """Scored rows of the test part whose target is known."""
    return f"FROM rolled WHERE imputed = 0 AND {target} IS NOT NULL AND date >= {views.cut_sql('region_filled', True)}"


@register("m03_contract", sql("region_rain", """
SELECT station, date, value AS observed, CAST(value IS NULL AS INT) AS imputed, TRUE AS ok FROM region_rain"""))
def m03_contract(spark, sf):
    kept = F.col("observed").isNull() | (F.col("value") == F.col("observed"))
    return m03(spark, sf).select("station", "date", "observed", "imputed", (kept & (F.col("value") >= 0)).alias("ok"))


@register("m04_contract", sql("region_rain", f"""
WITH held AS (SELECT station, count(value) AS n FROM region_rain GROUP BY station)
SELECT model, coalesce(station, 'OVERALL') AS station, CAST(sum(floor(n * 0.2::DOUBLE)) AS BIGINT) AS n
FROM held CROSS JOIN (SELECT unnest(['single', 'ensemble']) AS model) GROUP BY GROUPING SETS ((model, station), (model))"""))
def m04_contract(spark, sf):
    return m04(spark, sf).select("model", "station", "n")


def horizon_counts(horizons) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({h} AS INT) AS horizon, coalesce(station, 'OVERALL') AS station, count(*) AS n {test_rows(f'target{h}')} "
        "GROUP BY GROUPING SETS ((station), ())" for h in horizons)


@register("m07_contract", sql(["region_filled", "rolled"], horizon_counts((1, 7, 30))))
def m07_contract(spark, sf):
    return m07(spark, sf).select("horizon", "station", "n")


@register("m08_contract", sql(["region_filled", "rolled"], f"""
SELECT a.station, a.date, CAST(k AS INT) AS horizon_day, b.value AS actual, TRUE AS ok
FROM rolled a CROSS JOIN (SELECT unnest(generate_series(1, {LEADS})) AS k)
JOIN rolled b ON b.station = a.station AND b.rn = a.rn + k - 1
WHERE a.rn <= a.n_rows - {LEADS - 1} AND a.date >= {views.cut_sql("region_filled", True)} AND b.imputed = 0"""))
def m08_contract(spark, sf):
    return lead_scores(spark, sf).select("station", "date", "horizon_day", "actual", (F.col("pred") >= 0).alias("ok"))


@register("m09_contract", sql(["region_filled", "rolled"], f"""
SELECT station, date, value AS actual, TRUE AS ok {test_rows('value')}"""))
def m09_contract(spark, sf):
    p, pred = F.col("p_wet"), F.col("pred")
    ok = p.between(0, 1) & pred.between(0, 600) & ((p > 0.5) | (pred == 0))
    return m09(spark, sf).select("station", "date", "actual", ok.alias("ok"))


@register("m09_pooled_contract", sql(["region_filled", "rolled"], f"""
SELECT station, date, value AS actual, TRUE AS ok {test_rows('value')}"""))
def m09c_contract(spark, sf):
    p, pred = F.col("p_wet"), F.col("pred")
    ok = p.between(0, 1) & pred.between(0, 600) & ((p > 0.5) | (pred == 0))
    return m09c(spark, sf).select("station", "date", "actual", ok.alias("ok"))


STATION_COUNTS = f"SELECT station, count(*) AS n {test_rows('value')} GROUP BY station"


@register("m09_contract_per_station", sql(["region_filled", "rolled"], STATION_COUNTS))
def m09b_contract(spark, sf):
    return m09b(spark, sf).where("n > 0").select("station", "n")  # SQL has no stations without rows


@register("m10_contract", sql(["region_filled", "rolled"], f"""
SELECT coalesce(station, 'OVERALL') AS station, count(*) AS n {test_rows('value')} GROUP BY GROUPING SETS ((station), ())"""))
def m10_contract(spark, sf):
    return m10(spark, sf).select("station", "n")


@register("m11_contract", sql(["region_filled"], """
SELECT DISTINCT stage, station, TRUE AS least_is_kept, TRUE AS patience_held
FROM region_filled CROSS JOIN (SELECT unnest(['occurrence', 'amount']) AS stage)"""))
def m11_contract(spark, sf):
    """The last kept round has the least of the listed losses, and the list ends where patience does."""
    s = boosting.BoostSettings()
    rounds = m11(spark, sf).groupBy("stage", "station").agg(
        F.min(F.struct("loss", "round"))["round"].alias("least"), F.max(F.when(F.col("kept"), F.col("round"))).alias("last"),
        F.max("round").alias("tried"), F.count("*").alias("n"))
    ended = (F.col("tried") == F.least(F.col("least") + s.patience, F.lit(s.rounds))) & (F.col("n") == F.col("tried") + 1)
    return rounds.select("stage", "station", (F.col("least") == F.col("last")).alias("least_is_kept"), ended.alias("patience_held"))


@register("m16_contract", sql(["region_filled"], f"""
SELECT DISTINCT CAST(rung AS INT) AS rung, CAST({FIRST_ROUNDS} * (1 << rung) AS INT) AS rounds, CAST({len(TRIALS)} >> rung AS BIGINT) AS trials,
       CAST(({len(TRIALS)} >> rung) // 2 AS BIGINT) AS promoted, CAST(({len(TRIALS)} >> rung) = 1 AS BIGINT) AS chosen, TRUE AS least_goes_on
FROM region_filled CROSS JOIN (SELECT unnest(range(0, {len(TRIALS).bit_length()})) AS rung)"""))
def m16_contract(spark, sf):
    """All trials and rungs are listed; on each rung the trial of least loss goes on, and on the last it is chosen."""
    return m16(spark, sf).groupBy("rung", "rounds").agg(
        F.count("*").alias("trials"), F.count_if("promoted").alias("promoted"), F.count_if("chosen").alias("chosen"),
        F.min(F.struct("validation_rmse", "trial", (F.col("promoted") | F.col("chosen")).alias("on")))["on"].alias("least_goes_on"))


@register("m18_contract", sql(["region_filled"], "SELECT station, date, TRUE AS ok FROM region_filled"))
def m18_contract(spark, sf):
    return m18(spark, sf).select("station", "date", (F.col("pred") >= 0).alias("ok"))


@register("m21_contract", sql(["region_filled", "rolled"], horizon_counts((1,))))
def m21_contract(spark, sf):
    return m21(spark, sf).select("horizon", "station", "n")


# The features of the forecast frame by construction.
FEATURES = ([f"lag{k}" for k in learners.LAGS] + [f"{c}{n}" for n in learners.WINDOWS for c in ("roll", "wet", "basin")]
            + ["basin_lag1", "cv_disc", "cv_tax", "cv_tp", "st_mean", "st_wet"])


@register("m17_contract", sql(["region_filled"], f"""
SELECT DISTINCT feature, feature = 'planted' AS leads FROM region_filled CROSS JOIN (SELECT unnest({FEATURES + ['noise', 'planted']}) AS feature)"""))
def m17_contract(spark, sf):
    """A feature that holds the answer matters most, by more than five of its spreads; one drawn from a hash does not."""
    rows, names, model = fitted_daily(spark, sf, planted=True)
    found = cut_lineage(learners.permutation_importance(model, rows.where("split = 'test'"), names, "y"))
    most = found.agg(F.max("importance").alias("m")).select("m").scalar()
    leads = (F.col("importance") == most) & (F.col("importance") > 5 * F.col("spread")) & (F.col("importance") > 0)
    return found.where(F.col("feature").isin(*FEATURES, "noise", "planted")).select("feature", leads.alias("leads"))


@register("l05_contract", sql(["region_filled"], "SELECT least(count(*), 5) AS n, TRUE AS ok FROM region_filled"))
def l05_contract(spark, sf):
    return l05(spark, sf).agg(F.count("*").alias("n"), F.bool_and(F.col("importance").between(0, 1)).alias("ok"))


@register("s14_model_store", sql(["region_filled", "rolled"], f"""
SELECT station, date, value AS actual, TRUE AS same {test_rows('value')}"""))
def s14(spark, sf):
    """A hurdle model that was stored and loaded predicts what the fitted one does, its gate included."""
    from rainloom.session import scratch_path

    real, names = hurdle_rows(spark, sf)
    model = learners.fit_hurdle(real.where("split <> 'test'"), names, validation="is_val", gate=0.4, settings=FULL)
    path = scratch_path(spark)
    model.save(path)
    both = learners.HurdleModel.load(path).transform(
        model.transform(real.where("split = 'test'")).withColumnsRenamed({"pred": "fitted", "p_wet": "p_fitted"}))
    return both.select("station", "date", F.col("value").alias("actual"), (F.col("pred") == F.col("fitted")).alias("same"))
