"""Feature, window and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.functions import scalars as fx
from rainloom.operators import features, rollup, windows
from rainloom.operators.chunks import BY_DATE
from rainloom.plans import views
from rainloom.plans.registry import r6, register
from rainloom.plans.views import sql

BY_STATION = "WINDOW w AS (PARTITION BY station ORDER BY date)"


def frame(expr: str, start: str, end: str, name: str, digits: int = 10) -> str:
    return f"round({expr} OVER (w ROWS BETWEEN {start} AND {end}), {digits}) AS {name}"


# ---------------------------------------------------------------- rolling, lags, targets


@register("w01_rolling_mean", sql("region_rain", "SELECT station, date, " + ", ".join(
    frame("avg(value)", f"{n - 1} PRECEDING", "CURRENT ROW", f"rm{n}") for n in (3, 7, 14, 30))
    + f" FROM region_rain {BY_STATION}"))
def w01(spark, sf):
    out = features.add_rolling(views.region_rain(spark, sf), [3, 7, 14, 30])
    return r6(out.drop("value"), "rm3", "rm7", "rm14", "rm30", digits=10)


@register("w01_rolling_complete", sql("region_rain", f"""
SELECT station, date, CASE WHEN count(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
       THEN {frame("avg(value)", "6 PRECEDING", "CURRENT ROW", "x")[:-5]} END AS rm7
FROM region_rain {BY_STATION}"""))
def w01b(spark, sf):
    out = features.add_rolling(views.region_rain(spark, sf), [7], min_periods=7)
    return r6(out.drop("value"), "rm7", digits=10)


@register("w02_causal_mean", sql("region_rain", "SELECT station, date, " + ", ".join(
    f"coalesce(round(avg(value) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 10), 0.0) AS roll{n}"
    for n in (7, 30)) + f" FROM region_rain {BY_STATION}"))
def w02(spark, sf):
    out = features.add_rolling(views.region_rain(spark, sf), [7, 30], include_current=False, default=0.0)
    return r6(out.drop("value"), "roll7", "roll30", digits=10)


LAGS = (1, 2, 3, 5, 7, 14, 30)


@register("w03_lags", sql("region_rain", "SELECT station, date, " + ", ".join(
    f"lag(value, {k}) OVER w AS lag{k}" for k in LAGS) + f" FROM region_rain {BY_STATION}"))
def w03(spark, sf):
    return features.add_lags(views.region_rain(spark, sf), LAGS).drop("value")


@register("w03_lags_default", sql("region_rain", "SELECT station, date, " + ", ".join(
    f"coalesce(lag(value, {k}) OVER w, 0.0) AS lag{k}" for k in LAGS) + f" FROM region_rain {BY_STATION}"))
def w03b(spark, sf):
    return features.add_lags(views.region_rain(spark, sf), LAGS, default=0.0).drop("value")


@register("w04_lead_target", sql("region_rain", f"""
SELECT station, date, lead(value, 1) OVER w AS target1 FROM region_rain {BY_STATION}"""))
def w04(spark, sf):
    return features.add_targets(views.region_rain(spark, sf), [1], start=1).drop("value")


def forward_sql(start: int) -> str:
    def one(h: int) -> str:
        over = f"OVER (w ROWS BETWEEN {start or 'CURRENT ROW'}{' FOLLOWING' if start else ''} " \
               f"AND {start + h - 1} FOLLOWING)"
        return f"CASE WHEN count(value) {over} = {h} THEN round(sum(value) {over}, 6) END AS target{h}"
    return f"SELECT station, date, {one(7)}, {one(30)} FROM ship_masked {BY_STATION}"


@register("w05_forward_sums", sql("ship_masked", forward_sql(0)))
def w05(spark, sf):
    return r6(features.add_targets(views.ship_masked(spark, sf), [7, 30], start=0).drop("value"),
              "target7", "target30")


@register("w05_forward_sums_next_day", sql("ship_dense", forward_sql(1).replace("ship_masked", "ship_dense")))
def w05b(spark, sf):
    return r6(features.add_targets(views.ship_dense(spark, sf), [7, 30], start=1).drop("value"),
              "target7", "target30")


DRY_SQL = """
WITH d AS (SELECT station, date, {dry} AS dry, row_number() OVER w AS rn FROM region_rain """ + BY_STATION + """)
SELECT station, date,
       rn - coalesce(max(CASE WHEN NOT dry THEN rn END) OVER (PARTITION BY station ORDER BY date), 0) AS consec_dry
FROM d"""


@register("w06_dry_spell", sql("region_rain", DRY_SQL.format(dry="coalesce(value, 0) < 0.1")))
def w06(spark, sf):
    return features.add_dry_spell(views.region_rain(spark, sf), 0.1).drop("value")


@register("w06_dry_spell_observed", sql("region_rain", DRY_SQL.format(dry="coalesce(value < 0.5, false)")))
def w06b(spark, sf):
    return features.add_dry_spell(views.region_rain(spark, sf), 0.5, null_as_dry=False).drop("value")


@register("a27_longest_dry_spell", sql("region_rain", "SELECT station, max(consec_dry) AS longest_dry FROM ("
          + DRY_SQL.format(dry="coalesce(value, 0) < 0.1") + ") GROUP BY station"))
def a27(spark, sf):
    return features.add_dry_spell(views.region_rain(spark, sf), 0.1).groupBy("station").agg(
        F.max("consec_dry").alias("longest_dry"))


@register("w08_fill_forward_backward", sql("region_rain", """
SELECT station, date, coalesce(
    last_value(value IGNORE NULLS) OVER (PARTITION BY station ORDER BY date ROWS UNBOUNDED PRECEDING),
    first_value(value IGNORE NULLS) OVER (PARTITION BY station ORDER BY date
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
FROM region_rain"""))
def w08(spark, sf):
    return features.fill_forward_backward(views.region_rain(spark, sf), ["value"])


@register("j02_left_join_fill", sql(["region_dense", "covar"], """
WITH c AS (SELECT date, CASE WHEN dayofweek(date) NOT IN (0, 6) THEN cv_disc END AS cv_disc,
                  CASE WHEN dayofweek(date) NOT IN (0, 6) THEN cv_tp END AS cv_tp FROM covar),
j AS (SELECT d.date, c.cv_disc, c.cv_tp FROM (SELECT DISTINCT date FROM region_dense) d LEFT JOIN c USING (date)),
f AS (SELECT date, coalesce(last_value(cv_disc IGNORE NULLS) OVER p, first_value(cv_disc IGNORE NULLS) OVER n) AS cv_disc,
             coalesce(last_value(cv_tp IGNORE NULLS) OVER p, first_value(cv_tp IGNORE NULLS) OVER n) AS cv_tp
      FROM j WINDOW p AS (ORDER BY date ROWS UNBOUNDED PRECEDING),
                    n AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT station, date, value, cv_disc, cv_tp FROM region_dense JOIN f USING (date)"""))
def j02(spark, sf):
    # Covariates are blank at weekends here, so these days take the last known value.
    series = views.region_dense(spark, sf)
    workday = ~F.dayofweek("date").isin(1, 7)
    blanked = views.covar_table(spark, sf).select(
        "date", *[F.when(workday, F.col(c)).alias(c) for c in ("cv_disc", "cv_tp")])
    days = series.select("date").distinct().join(blanked, ["date"], "left")
    return series.join(features.fill_forward_backward(days, ["cv_disc", "cv_tp"], BY_DATE), "date")


@register("w09_time_rolling", sql("region_raw", """
SELECT station, date,
       CASE WHEN count(value) OVER a >= 3 THEN round(avg(value) OVER a, 9) END AS value_7d,
       CASE WHEN count(value) OVER b >= 10 THEN round(avg(value) OVER b, 9) END AS value_30d
FROM region_raw
WINDOW a AS (PARTITION BY station ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW),
       b AS (PARTITION BY station ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)"""))
def w09(spark, sf):
    observed = views.cut_lineage(views.region(spark, sf))
    out = features.add_time_rolling(observed, 7, 3, {"value": "value_7d"})
    out = features.add_time_rolling(out, 30, 10, {"value": "value_30d"})
    return r6(out.drop("value"), "value_7d", "value_30d", digits=9)


SCALES = (3, 7, 14, 30, 60, 90)


@register("w20_multiscale_stats", sql("ship_masked", "SELECT station, date, " + ", ".join(
    f"round(avg(value) OVER f{n}, 6) AS roll{n}, round(stddev_samp(value) OVER f{n}, 6) AS std{n}, "
    f"max(value) OVER f{n} AS max{n}, count(*) FILTER (value > 200) OVER f{n} AS wet{n}" for n in SCALES)
    + " FROM ship_masked WINDOW " + ", ".join(
    f"f{n} AS (PARTITION BY station ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in SCALES)))
def w20(spark, sf):
    out = features.add_rolling(views.ship_masked(spark, sf), SCALES, ("mean", "std", "max", "wet"),
                               include_current=False, threshold=200.0)
    return r6(out.drop("value"), *[f"{p}{n}" for n in SCALES for p in ("roll", "std")])


@register("w22_run_boundaries", sql("region_rain", f"""
SELECT station, date, CAST(dry IS DISTINCT FROM lag(dry) OVER w AS INT) AS run_start
FROM (SELECT station, date, coalesce(value, 0) < 0.1 AS dry FROM region_rain) {BY_STATION}"""))
def w22(spark, sf):
    return features.add_run_boundary(views.region_rain(spark, sf), 0.1).drop("value")


@register("a17_station_mean_feature", sql("region_rain", """
SELECT station, date, round(avg(value) OVER (PARTITION BY date), 9) AS station_mean FROM region_rain"""))
def a17(spark, sf):
    return r6(features.add_station_mean(views.region_rain(spark, sf)).drop("value"), "station_mean", digits=9)


# ---------------------------------------------------------------- model windows


@register("w11_centered_windows", sql("ship_masked", """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date) AS rn FROM ship_masked),
o AS (SELECT unnest(generate_series(-7, 7)) AS k)
SELECT a.station, a.date, CAST(o.k + 7 AS INT) AS pos, coalesce(b.value, 0.0) AS cell,
       CAST(b.value IS NOT NULL AS INT) AS mask
FROM s a CROSS JOIN o LEFT JOIN s b ON b.station = a.station AND b.rn = a.rn + o.k"""))
def w11(spark, sf):
    out = windows.centered_windows(views.ship_masked(spark, sf), 7)
    return out.select("station", "date", F.posexplode("window").alias("pos", "c")).select(
        "station", "date", "pos", F.col("c.value").alias("cell"), F.col("c.mask").alias("mask"))


@register("w12_lookback_sequences", sql("ship_masked", f"""
WITH s AS (SELECT *, dayofyear(date) AS doy, row_number() OVER w AS rn FROM ship_masked {BY_STATION})
SELECT station, date, CAST(45 AS INT) AS n_steps, round(sum(coalesce(value, 0) * rn) OVER f - (rn - 46)
       * sum(coalesce(value, 0)) OVER f, 3) AS weighted_sum, CAST(sum(doy) OVER f AS BIGINT) AS doy_sum,
       lag(value, 45) OVER (PARTITION BY station ORDER BY date) AS first_value,
       lag(value, 1) OVER (PARTITION BY station ORDER BY date) AS last_value,
       count(value) OVER f AS n_observed
FROM s WINDOW f AS (PARTITION BY station ORDER BY date ROWS BETWEEN 45 PRECEDING AND 1 PRECEDING)
QUALIFY rn > 45"""))
def w12(spark, sf):
    series = views.ship_masked(spark, sf).withColumn("doy", F.dayofyear("date"))
    out = windows.lookback_sequences(series, 45, ["value", "doy"])
    ranked = F.zip_with("sequence", F.sequence(F.lit(1), F.lit(45)),
                        lambda c, i: F.coalesce(c["value"], F.lit(0.0)) * i)
    return out.select(
        "station", "date", F.size("sequence").alias("n_steps"),
        F.round(F.aggregate(ranked, F.lit(0.0), lambda a, x: a + x), 3).alias("weighted_sum"),
        F.aggregate("sequence", F.lit(0).cast("long"), lambda a, c: a + c["doy"]).alias("doy_sum"),
        F.col("sequence")[0]["value"].alias("first_value"), F.col("sequence")[44]["value"].alias("last_value"),
        F.size(F.filter("sequence", lambda c: c["value"].isNotNull())).cast("long").alias("n_observed"))


HORIZON_SQL = """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date) AS rn,
                  count(*) OVER (PARTITION BY station) AS n FROM ship_masked),
o AS (SELECT unnest(generate_series(0, 13)) AS k)
SELECT a.station, a.date, b.date AS forecast_date, CAST(o.k + 1 AS INT) AS horizon_day, b.value
FROM s a CROSS JOIN o JOIN s b ON b.station = a.station AND b.rn = a.rn + o.k WHERE a.rn <= a.n - 13"""


@register("w13_horizon_targets", sql("ship_masked", HORIZON_SQL))
def w13(spark, sf):
    return windows.explode_horizon(windows.horizon_targets(views.ship_masked(spark, sf), 14))


# ---------------------------------------------------------------- scalar functions


@register("f01_log_pair", sql("region_rain", """
SELECT station, date, round(ln(1 + value), 9) AS logged,
       round(CASE WHEN value IS NOT NULL THEN greatest(exp(ln(1 + value) - 0.3) - 1, 0) END, 9) AS restored
FROM region_rain"""))
def f01(spark, sf):
    logged = fx.to_log(F.col("value"))
    return views.region_rain(spark, sf).select("station", "date", F.round(logged, 9).alias("logged"),
                                               F.round(fx.from_log(logged - 0.3), 9).alias("restored"))


def seasonal_sql(view: str, period: float) -> str:
    return sql(view, f"""
SELECT station, date, round(sin(2 * pi() * dayofyear(date) / {period}), 9) AS doy_sin,
       round(cos(2 * pi() * dayofyear(date) / {period}), 9) AS doy_cos,
       round(sin(2 * pi() * month(date) / 12), 9) AS month_sin,
       round(cos(2 * pi() * month(date) / 12), 9) AS month_cos FROM {view}""")


def seasonal(df, period):
    return r6(features.add_seasonal(df, period).drop("value"), "doy_sin", "doy_cos", "month_sin", "month_cos", digits=9)


@register("f04_seasonal_mean_year", seasonal_sql("ship_dense", 365.25))
def f04(spark, sf):
    return seasonal(views.ship_dense(spark, sf), 365.25)


@register("f04_seasonal_plain_year", seasonal_sql("ship_dense", 365.0))
def f04b(spark, sf):
    return seasonal(views.ship_dense(spark, sf), 365.0)


@register("f05_second_harmonic", sql("covar", """
SELECT CAST(date_trunc('month', date) AS DATE) AS month, round(sum(cv_tp), 8) AS cv_tp,
       round(sin(2 * pi() * month(month) / 12), 9) AS month_sin, round(cos(2 * pi() * month(month) / 12), 9) AS month_cos,
       round(sin(4 * pi() * month(month) / 12), 9) AS month_sin2, round(cos(4 * pi() * month(month) / 12), 9) AS month_cos2
FROM covar GROUP BY month"""))
def f05(spark, sf):
    months = rollup.monthly_covariates(views.covar(spark, sf), {"cv_tp": "sum"})
    out = features.add_seasonal(months, harmonics=(1, 2), time="month", of=("month",))
    return r6(r6(out, "cv_tp", digits=8), "month_sin", "month_cos", "month_sin2", "month_cos2", digits=9)


@register("f06_calendar_parts", sql("telemetry", """
SELECT station, ts, value, CAST(ts AS DATE) AS date, CAST(dayofyear(ts) AS INT) AS doy,
       CAST(month(ts) AS INT) AS month_no, CAST(date_trunc('month', ts) AS DATE) AS month FROM telemetry"""))
def f06(spark, sf):
    return features.add_calendar_parts(views.telemetry(spark, sf))


@register("f07_clip", sql("region_rain", """
SELECT station, date, CASE WHEN value IS NOT NULL THEN greatest(least(value, 4.0), 0.5) END AS clipped,
       CASE WHEN value IS NOT NULL THEN greatest(round(value - 2, 6), 0.0) END AS floored FROM region_rain"""))
def f07(spark, sf):
    x = F.col("value")
    return views.region_rain(spark, sf).select("station", "date", fx.clip(x, 0.5, 4.0).alias("clipped"),
                                               fx.floor_at(F.round(x - 2, 6), 0.0).alias("floored"))


@register("f08_half_even", sql("region_rain", """
SELECT station, date, round_even(value, 1) AS rounded,
       round_even(floor(value * 10) * 0.25, 1) AS ties FROM region_rain"""))
def f08(spark, sf):
    x = F.col("value")
    return views.region_rain(spark, sf).select(
        "station", "date", fx.half_even(x, 1).alias("rounded"),
        fx.half_even(F.floor(x * 10).cast("double") * 0.25, 1).alias("ties"))


@register("f09_units", sql("grid", """
SELECT ts, lat, lon, count(*) AS n, round(sum(t2m - 273.15), 6) AS t2m_c, round(sum(sp / 100.0), 6) AS sp_hpa,
       round(sum(tp * 1000.0), 9) AS tp_mm FROM grid GROUP BY ts, lat, lon"""))
def f09(spark, sf):
    grid = views.grid(spark, sf).select(
        "ts", "lat", "lon", fx.celsius(F.col("t2m")).alias("t"), fx.hectopascal(F.col("sp")).alias("p"),
        fx.millimetres(F.col("tp")).alias("r"))
    return grid.groupBy("ts", "lat", "lon").agg(
        F.count("*").alias("n"), F.round(F.sum("t"), 6).alias("t2m_c"), F.round(F.sum("p"), 6).alias("sp_hpa"),
        F.round(F.sum("r"), 9).alias("tp_mm"))


@register("f10_relative_humidity", sql("grid", """
SELECT CAST(ts AS DATE) AS date, round(avg(100 * exp(17.625 * (d2m - 273.15) / (243.04 + d2m - 273.15))
       / exp(17.625 * (t2m - 273.15) / (243.04 + t2m - 273.15))), 6) AS rh FROM grid GROUP BY 1"""))
def f10(spark, sf):
    rh = fx.relative_humidity(fx.celsius(F.col("t2m")), fx.celsius(F.col("d2m")))
    return views.grid(spark, sf).groupBy(F.to_date("ts").alias("date")).agg(F.round(F.avg(rh), 6).alias("rh"))


@register("f11_wind_speed", sql("grid", """
SELECT CAST(ts AS DATE) AS date, round(avg(sqrt(u10 * u10 + v10 * v10)), 6) AS ws,
       round(max(sqrt(u10 * u10 + v10 * v10)), 6) AS ws_max FROM grid GROUP BY 1"""))
def f11(spark, sf):
    ws = fx.wind_speed(F.col("u10"), F.col("v10"))
    return views.grid(spark, sf).groupBy(F.to_date("ts").alias("date")).agg(
        F.round(F.avg(ws), 6).alias("ws"), F.round(F.max(ws), 6).alias("ws_max"))


@register("f13_conditional", sql("region_rain", """
SELECT station, date, CASE WHEN value IS NOT NULL THEN round(ln(1 + value), 9) ELSE 0.0 END AS filled_log
FROM region_rain"""))
def f13(spark, sf):
    x = F.col("value")
    return views.region_rain(spark, sf).select(
        "station", "date", F.when(x.isNotNull(), F.round(fx.to_log(x), 9)).otherwise(0.0).alias("filled_log"))


@register("f14_wet_label", sql("region_rain", """
SELECT station, date, CAST(value > 0 AS INT) AS wet_any, CAST(value > 0.5 AS INT) AS wet_half FROM region_rain"""))
def f14(spark, sf):
    x = F.col("value")
    return views.region_rain(spark, sf).select("station", "date", fx.wet(x, 0.0).alias("wet_any"),
                                               fx.wet(x, 0.5).alias("wet_half"))


@register("f20_log_feature", sql("region_filled", """
SELECT station, date, value, imputed, round(ln(1 + value), 9) AS value_log FROM region_filled"""))
def f20(spark, sf):
    return views.region_filled(spark, sf).withColumn("value_log", F.round(fx.to_log(F.col("value")), 9))


@register("u05_feature_block", sql(["region_filled", "covar"], f"""
WITH l AS (SELECT station, date, value, lag(value, 1) OVER w AS lag1, lag(value, 7) OVER w AS lag7,
    round(avg(value) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 9) AS roll7 FROM region_filled {BY_STATION})
SELECT station, date, lag1, lag7, roll7, round(sin(2 * pi() * dayofyear(date) / 365.25), 9) AS doy_sin,
       round(cos(2 * pi() * dayofyear(date) / 365.25), 9) AS doy_cos, cv_disc, cv_tp
FROM l JOIN covar USING (date)"""))
def u05(spark, sf):
    series = features.add_lags(views.region_filled(spark, sf), [1, 7])
    series = features.add_rolling(series, [7], include_current=False)
    series = features.add_seasonal(series, of=("doy",))
    out = series.join(views.covar_table(spark, sf), "date")
    return r6(out, "roll7", "doy_sin", "doy_cos", digits=9).select(
        "station", "date", "lag1", "lag7", "roll7", "doy_sin", "doy_cos", "cv_disc", "cv_tp")
