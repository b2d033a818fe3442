"""Counters, spatial joins, scaling, splits, statistics and simple imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.functions import scalars as fx
from rainloom.operators import (counters, features, gram, impute, metrics, quality, rollup, scaling, spatial, split,
                                stats)
from rainloom.operators.chunks import DAILY, slots
from rainloom.plans import views
from rainloom.plans.registry import r6, register
from rainloom.plans.views import cut_lineage, sql

# ---------------------------------------------------------------- counters and gaps

DECODE = """
SELECT station, {t}, {extra} CASE WHEN dy >= 0 THEN dy WHEN dd >= 0 THEN dd WHEN dy IS NOT NULL THEN 0.0 END AS increment
FROM (SELECT *, raw_yearly - lag(raw_yearly) OVER w AS dy, raw_daily - lag(raw_daily) OVER w AS dd,
             lag({t}) OVER w AS pt FROM {source} WINDOW w AS (PARTITION BY station ORDER BY {t}))"""


@register("s09_counter_table", sql("counter", """
SELECT station, ts, round(raw_daily, 4) AS raw_daily, round(raw_yearly, 4) AS raw_yearly FROM counter"""))
def s09(spark, sf):
    return r6(views.counter(spark, sf), "raw_daily", "raw_yearly", digits=4)


@register("w18_decode_counter", sql("ship_counter", "SELECT station, date, round(increment, 6) AS increment FROM ("
          + DECODE.format(t="date", source="ship_counter", extra="") + ")"))
def w18(spark, sf):
    readings = views.cut_lineage(views.ship_counter(spark, sf))
    return r6(counters.decode_counter(readings, DAILY).select("station", "date", "increment"), "increment")


@register("w18_decode_counter_reset_value", sql("ship_counter", """
SELECT station, date, round(CASE WHEN dy >= 0 THEN dy WHEN year(date) <> year(pt) THEN raw_yearly
       WHEN dd >= 0 THEN dd WHEN dy IS NOT NULL THEN 0.0 END, 6) AS increment
FROM (SELECT *, raw_yearly - lag(raw_yearly) OVER w AS dy, raw_daily - lag(raw_daily) OVER w AS dd,
             lag(date) OVER w AS pt FROM ship_counter WINDOW w AS (PARTITION BY station ORDER BY date))"""))
def w18b(spark, sf):
    readings = views.cut_lineage(views.ship_counter(spark, sf))
    return r6(counters.decode_counter(readings, DAILY, "value").select("station", "date", "increment"), "increment")


def classified(spark, sf):
    readings = views.cut_lineage(r6(views.counter(spark, sf), "raw_daily", "raw_yearly", digits=4))
    return counters.classify_gaps(counters.decode_counter(readings, slots(15)))


GAPS = """
WITH c AS (SELECT station, ts, round(raw_daily, 4) AS raw_daily, round(raw_yearly, 4) AS raw_yearly FROM counter),
d AS (""" + DECODE.format(t="ts", source="c", extra="dy >= 0 AS resumed, date_diff('minute', pt, ts) - 15 AS gap_minutes,") + """),
g AS (SELECT *, CASE WHEN gap_minutes <= 0 THEN 'none' WHEN gap_minutes < 120 THEN 'short'
                     WHEN gap_minutes <= 1440 THEN 'medium' WHEN gap_minutes IS NOT NULL THEN 'long' END AS gap_class
      FROM d)"""


@register("w19_gap_classes", sql("counter", GAPS + """
SELECT station, ts, gap_minutes, gap_class, round(increment, 4) AS increment FROM g"""))
def w19(spark, sf):
    return classified(spark, sf).select("station", "ts", "gap_minutes", "gap_class",
                                        F.round("increment", 4).alias("increment"))


@register("w19_filled_increments", sql(["counter", "telemetry_dense"], GAPS + """,
s AS (SELECT t.station, t.ts, g.ts AS seen, g.increment, g.gap_class, g.resumed FROM telemetry_dense t
      LEFT JOIN g ON g.station = t.station AND g.ts = t.ts),
n AS (SELECT *, first_value(gap_class IGNORE NULLS) OVER w AS next_class, first_value(resumed IGNORE NULLS) OVER w AS next_ok
      FROM s WINDOW w AS (PARTITION BY station ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT station, ts, round(CASE WHEN seen IS NOT NULL THEN CASE WHEN gap_class = 'long' THEN NULL ELSE increment END
       WHEN seen < ts THEN NULL
       WHEN ts < (SELECT min(ts) FROM telemetry f WHERE f.station = n.station) THEN NULL
       WHEN next_class = 'short' THEN 0.0 WHEN next_class = 'medium' AND next_ok THEN 0.0 END, 4) AS increment
FROM n"""))
def w19b(spark, sf):
    return r6(counters.fill_gaps(classified(spark, sf)), "increment", digits=4)


@register("a02_counter_daily_total", sql("counter", GAPS + """
SELECT station, CAST(ts AS DATE) AS date, round(sum(increment), 4) AS total FROM g GROUP BY 1, 2"""))
def a02(spark, sf):
    return classified(spark, sf).groupBy("station", F.to_date("ts").alias("date")).agg(
        F.round(F.sum("increment"), 4).alias("total"))


# ---------------------------------------------------------------- grid

HAVERSINE = """2 * 6371.0 * asin(sqrt(least(1.0, sin(radians(c.lat - s.lat) / 2) ** 2
    + cos(radians(s.lat)) * cos(radians(c.lat)) * sin(radians(c.lon - s.lon) / 2) ** 2)))"""
NEAREST = f"""
cells AS (SELECT DISTINCT lat, lon FROM grid),
near AS (SELECT s.station, c.lat AS cell_lat, c.lon AS cell_lon, {HAVERSINE} AS d FROM station_xy s CROSS JOIN cells c),
best AS (SELECT station, cell_lat, cell_lon, d FROM near
         QUALIFY row_number() OVER (PARTITION BY station ORDER BY d, cell_lat, cell_lon) = 1)"""


@register("j05_nearest_cell", sql(["station_xy", "grid"], f"""
WITH {NEAREST.strip()} SELECT station, cell_lat, cell_lon, round(d, 6) AS distance_km FROM best"""))
def j05(spark, sf):
    found = spatial.nearest_cell(views.station_xy(spark, sf), views.grid(spark, sf))
    return found.select("station", "cell_lat", "cell_lon", F.round("distance_km", 6).alias("distance_km"))


@register("f12_cell_distance_summary", sql(["station_xy", "grid"], f"""
WITH {NEAREST.strip()}
SELECT cell_lat, cell_lon, count(*) AS n_stations, round(avg(d), 6) AS mean_km, round(max(d), 6) AS max_km
FROM best GROUP BY 1, 2"""))
def f12(spark, sf):
    found = spatial.nearest_cell(views.station_xy(spark, sf), views.grid(spark, sf))
    return found.groupBy("cell_lat", "cell_lon").agg(
        F.count("*").alias("n_stations"), F.round(F.avg("distance_km"), 6).alias("mean_km"),
        F.round(F.max("distance_km"), 6).alias("max_km"))


@register("j09_bounding_box", sql("grid", """
SELECT lat, lon, count(*) AS n, round(avg(t2m), 9) AS t2m FROM grid
WHERE lat BETWEEN 3.5 AND 4.5 AND lon BETWEEN 101.5 AND 103.0 GROUP BY 1, 2"""))
def j09(spark, sf):
    box = spatial.bounding_box(views.grid(spark, sf), (3.5, 4.5), (101.5, 103.0))
    return box.groupBy("lat", "lon").agg(F.count("*").alias("n"), F.round(F.avg("t2m"), 9).alias("t2m"))


@register("p10_drop_repeated_columns", sql("covar", "SELECT date, cv_disc AS st0_d2m, cv_tp AS st0_tp, cv_tax AS st2_d2m FROM covar"))
def p10(spark, sf):
    mapped = views.covar_table(spark, sf).select(
        "date", F.col("cv_disc").alias("st0_d2m"), F.col("cv_tp").alias("st0_tp"),
        F.col("cv_disc").alias("st1_d2m"), F.col("cv_tp").alias("st1_tp"), F.col("cv_tax").alias("st2_d2m"))
    return spatial.drop_repeated(mapped, [c for c in mapped.columns if c != "date"])


# ---------------------------------------------------------------- scaling

NATION_XY = """
xy AS (SELECT n_nationkey AS station, round(3.0::DOUBLE + (n_nationkey * 7919 % 2501) / 1000.0::DOUBLE, 6) AS lat,
              round(101.0::DOUBLE + (n_nationkey * 104729 % 2503) / 1000.0::DOUBLE, 6) AS lon FROM nation)"""


@register("p10_shared_cells", sql("grid", f"""
WITH {NATION_XY.strip()},
cells AS (SELECT DISTINCT lat, lon FROM grid),
near AS (SELECT s.station, c.lat AS cell_lat, c.lon AS cell_lon FROM xy s CROSS JOIN cells c
         QUALIFY row_number() OVER (PARTITION BY s.station ORDER BY {HAVERSINE}, c.lat, c.lon) = 1)
SELECT 'st' || station || '_t2m' AS column_name, 'st' || min(station) OVER (PARTITION BY cell_lat, cell_lon) || '_t2m' AS first_column FROM near"""))
def p10b(spark, sf):
    """Daily readings of every nation's nearest cell side by side: nations that share a cell have the same column."""
    key = F.col("n_nationkey")
    xy = views.table(spark, sf, "nation").select(
        key.alias("station"), F.round(F.lit(3.0) + (key * 7919 % 2501) / 1000.0, 6).alias("lat"),
        F.round(F.lit(101.0) + (key * 104729 % 2503) / 1000.0, 6).alias("lon"))
    grid = views.grid(spark, sf)
    near = spatial.nearest_cell(xy, grid).select("station", F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon"))
    daily = grid.groupBy(F.to_date("ts").alias("date"), "lat", "lon").agg(F.round(F.avg("t2m"), 9).alias("t2m"))
    stations = [r["station"] for r in near.select("station").orderBy("station").collect()]
    wide = views.cut_lineage(daily.join(near, ["lat", "lon"]).groupBy("date").pivot("station", stations).agg(F.first("t2m")))
    wide = wide.withColumnsRenamed({str(s): f"st{s}_t2m" for s in stations})
    found = spatial.repeated_columns(wide, [f"st{s}_t2m" for s in stations])
    return spark.createDataFrame(list(found.items()), "column_name string, first_column string")


def train_sql(view):
    return f"date < {views.cut_sql(view)}"


def train(df):
    return F.col("date") < views.cuts(df)[0]


@register("a29_scaler_parameters", sql("region_rain", f"""
SELECT station, round(min(ln(1 + value)) FILTER ({train_sql('region_rain')}), 9) AS logged_a,
       round(max(ln(1 + value)) FILTER ({train_sql('region_rain')}), 9) AS logged_b FROM region_rain GROUP BY station"""))
def a29(spark, sf):
    logged = views.region_rain(spark, sf).withColumn("logged", fx.to_log(F.col("value")))
    return r6(scaling.fit_scaler(logged, ["logged"], where=train(logged), keys=["station"]), "logged_a", "logged_b", digits=9)


@register("f02_minmax_global", sql("region_rain", f"""
WITH l AS (SELECT station, date, value, ln(1 + value) AS logged FROM region_rain),
p AS (SELECT min(logged) AS a, max(logged) AS b FROM l WHERE {train_sql('region_rain')})
SELECT station, date, round((logged - a) / (b - a), 9) AS logged_scaled,
       round(greatest(exp(((logged - a) / (b - a)) * (b - a) + a) - 1, 0), 6) AS restored
FROM l CROSS JOIN p WHERE value IS NOT NULL"""))
def f02(spark, sf):
    logged = views.region_rain(spark, sf).withColumn("logged", fx.to_log(F.col("value")))
    params = scaling.fit_scaler(logged, ["logged"], where=train(logged))
    scaled = scaling.scale(logged.where("value IS NOT NULL"), params, ["logged"])
    back = scaling.unscale(scaled.withColumn("logged", F.col("logged_scaled")), params, ["logged"])
    return back.select("station", "date", F.round("logged_scaled", 9).alias("logged_scaled"),
                       F.round(fx.from_log(F.col("logged_raw")), 6).alias("restored"))


@register("f02_minmax_per_station", sql("region_rain", """
SELECT station, date, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 9) AS value_scaled
FROM region_rain WINDOW w AS (PARTITION BY station)"""))
def f02b(spark, sf):
    series = views.region_rain(spark, sf)
    params = scaling.fit_scaler(series, ["value"], keys=["station"])
    return r6(scaling.scale(series, params, ["value"], keys=["station"]).drop("value"), "value_scaled", digits=9)


@register("f03_standardise", sql("covar", f"""
WITH p AS (SELECT avg(cv_disc) AS da, stddev_pop(cv_disc) AS db, avg(cv_tp) AS ta, stddev_pop(cv_tp) AS tb
           FROM covar WHERE {train_sql('covar')})
SELECT date, round((cv_disc - da) / db, 6) AS cv_disc_scaled, round((cv_tp - ta) / tb, 6) AS cv_tp_scaled
FROM covar CROSS JOIN p"""))
def f03(spark, sf):
    table = views.covar_table(spark, sf)
    params = scaling.fit_scaler(table, ["cv_disc", "cv_tp"], "standard", where=train(table))
    out = scaling.scale(table, params, ["cv_disc", "cv_tp"], "standard")
    return r6(out.select("date", "cv_disc_scaled", "cv_tp_scaled"), "cv_disc_scaled", "cv_tp_scaled")


# ---------------------------------------------------------------- holdout and splits

HOLDOUT = """
SELECT station, date, value, CAST(value IS NOT NULL AND rn <= floor(n * CAST({f} AS DOUBLE)) AS INT) AS holdout
FROM (SELECT *, count(value) OVER (PARTITION BY station) AS n, row_number() OVER (
          PARTITION BY station, value IS NULL ORDER BY md5(station || '|' || CAST(date AS VARCHAR) || '|42')) AS rn
      FROM {view})"""


@register("m01_holdout", sql("ship_masked", HOLDOUT.format(f="0.2", view="ship_masked")))
def m01(spark, sf):
    return split.holdout_cells(views.ship_masked(spark, sf), 0.2, 42)


@register("m01_holdout_tenth", sql("region_rain", HOLDOUT.format(f="0.1", view="region_rain")))
def m01b(spark, sf):
    return split.holdout_cells(views.region_rain(spark, sf), 0.1, 42)


@register("a28_holdout_coverage", sql("ship_masked", f"""
SELECT station, count(value) AS n_observed, count(value) FILTER (holdout = 1) AS n_holdout,
       count(value) FILTER (holdout = 0) AS n_train FROM ({HOLDOUT.format(f="0.2", view="ship_masked")}) GROUP BY station"""))
def a28(spark, sf):
    return split.holdout_coverage(split.holdout_cells(views.ship_masked(spark, sf), 0.2, 42))


def ordinal_sql(view: str, val_edge: str, time: str = "date") -> str:
    return f"""
WITH r AS (SELECT {time}, row_number() OVER (ORDER BY {time}) - 1 AS o, count(*) OVER () AS n
           FROM (SELECT DISTINCT {time} FROM {view})),
c AS (SELECT {time}, CASE WHEN o < floor(n * 0.7::DOUBLE) THEN 'train' WHEN o < {val_edge} THEN 'val' ELSE 'test' END
             AS split FROM r)"""


SEPARATE = "floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE)"


@register("w14_chronological_split", sql("ship_masked", ordinal_sql("ship_masked", SEPARATE)
          + " SELECT station, date, split FROM ship_masked JOIN c USING (date)"))
def w14(spark, sf):
    return split.chronological_split(views.ship_masked(spark, sf)).select("station", "date", "split")


@register("w14_split_cumulative", sql("ship_masked", ordinal_sql("ship_masked", "floor(n * 0.85::DOUBLE)")
          + " SELECT station, split, count(*) AS n FROM ship_masked JOIN c USING (date) GROUP BY 1, 2"))
def w14b(spark, sf):
    return split.chronological_split(views.ship_masked(spark, sf), second="cumulative").groupBy(
        "station", "split").agg(F.count("*").alias("n"))


@register("w15_global_date_split", sql("region_dense", ordinal_sql("region_dense", SEPARATE)
          + " SELECT station, date, value, split FROM region_dense JOIN c USING (date)"))
def w15(spark, sf):
    return split.chronological_split(views.region_dense(spark, sf))


@register("p12_fixed_date_split", sql("region_dense", """
SELECT station, date, CASE WHEN date < DATE '1999-08-01' THEN 'train' WHEN date < DATE '2000-08-01' THEN 'val'
       ELSE 'test' END AS split FROM region_dense"""))
def p12(spark, sf):
    def day(s):
        return F.lit(s).cast("date")
    return split.date_split(views.region_dense(spark, sf), day("1999-08-01"), day("2000-08-01")).drop("value")


@register("w16_month_split", sql("region_dense", """
WITH m AS (SELECT station, CAST(date_trunc('month', date) AS DATE) AS month, round(coalesce(sum(value), 0), 6) AS total
           FROM region_dense GROUP BY 1, 2),
""" + ordinal_sql("m", SEPARATE, "month").strip()[5:] + " SELECT station, month, total, split FROM m JOIN c USING (month)"))
def w16(spark, sf):
    months = r6(rollup.monthly_totals(views.region_dense(spark, sf)), "total")
    return split.chronological_split(months, time="month").select("station", "month", "total", "split")


@register("l04_evenly_spaced", sql("ship_dense", """
WITH r AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS ordinal, count(*) OVER () AS n
           FROM (SELECT DISTINCT date FROM ship_dense))
SELECT date, ordinal FROM r WHERE ordinal IN (SELECT CAST(floor(i * ((n - 1) / 5.0::DOUBLE)) AS INT)
       FROM r, (SELECT unnest(generate_series(0, 5)) AS i))"""))
def l04(spark, sf):
    return split.evenly_spaced(views.ship_dense(spark, sf), 6)


# ---------------------------------------------------------------- statistics

@register("a08_describe", sql("region_rain", """
SELECT station, count(value) AS n, round_even(avg(value), 8) AS mean, round_even(stddev_samp(value), 8) AS std,
       round_even(min(value), 8) AS min, round_even(max(value), 8) AS max, round_even(quantile_cont(value, 0.25), 8) AS q25,
       round_even(quantile_cont(value, 0.5), 8) AS q50, round_even(quantile_cont(value, 0.75), 8) AS q75
FROM region_rain GROUP BY station"""))
def a08(spark, sf):
    return stats.describe(views.region_rain(spark, sf), digits=8)


@register("a08_exact_quantiles", """
SELECT l_returnflag AS station, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95
FROM lineitem GROUP BY 1""")
def a08b(spark, sf):
    items = views.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("station"), "l_extendedprice")
    out = stats.exact_quantiles(items, ["station"], "l_extendedprice", (0.05, 0.5, 0.95), ("p05", "p50", "p95"))
    return r6(out, "p05", "p50", "p95")


COLUMNS = ("cv_disc", "cv_tax", "cv_tp", "lag1", "roll7", "value")


@register("a11_correlations", sql(["region_rain", "covar"], """
WITH f AS (SELECT date, value, lag(value) OVER w AS lag1, avg(value) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS roll7
           FROM region_rain WINDOW w AS (PARTITION BY station ORDER BY date)),
j AS (SELECT * FROM f JOIN covar USING (date))
""" + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM j"
                         for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1:])))
def a11(spark, sf):
    series = features.add_rolling(features.add_lags(views.region_rain(spark, sf), [1]), [7], include_current=False)
    return r6(stats.correlations(series.join(views.covar_table(spark, sf), "date"), COLUMNS), "r")


@register("j10_station_correlations", sql("region_dense", """
SELECT 's' || a.station AS x, 's' || b.station AS y, round(corr(a.value, b.value), 6) AS r
FROM region_dense a JOIN region_dense b ON a.date = b.date AND a.station < b.station GROUP BY 1, 2"""))
def j10(spark, sf):
    found = gram.pair_correlations(cut_lineage(views.region_dense(spark, sf)))
    return r6(found.select(F.concat(F.lit("s"), "a").alias("x"), F.concat(F.lit("s"), "b").alias("y"), "r"), "r")


@register("a13_lag_rank_correlation", sql("region_rain", """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date) AS rn FROM region_rain),
p AS (SELECT a.station, k AS lag, a.value AS x, b.value AS y FROM s a CROSS JOIN (SELECT unnest([1, 7, 30]) AS k)
      JOIN s b ON b.station = a.station AND b.rn = a.rn - k WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
r AS (SELECT station, lag,
             rank() OVER (PARTITION BY station, lag ORDER BY x) + (count(*) OVER (PARTITION BY station, lag, x) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY station, lag ORDER BY y) + (count(*) OVER (PARTITION BY station, lag, y) - 1) / 2.0 AS ry
      FROM p)
SELECT station, CAST(lag AS INT) AS lag, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1, 2"""))
def a13(spark, sf):
    return r6(stats.lag_rank_correlation(views.region_rain(spark, sf), [1, 7, 30]), "rho")


# ---------------------------------------------------------------- simple imputation

CANDIDATES = {
    "station_mean": "avg(value) OVER (PARTITION BY station)",
    "date_mean": "avg(value) OVER (PARTITION BY date)",
    "month_climatology": "avg(value) OVER (PARTITION BY station, month(date))",
    "forward_fill": "last_value(value IGNORE NULLS) OVER (PARTITION BY station ORDER BY date ROWS UNBOUNDED PRECEDING)",
}
LINEAR = """
SELECT station, date, value, CASE WHEN bd > ad THEN av + (bv - av) * (date - ad) / (bd - ad) ELSE coalesce(av, bv) END
       AS candidate
FROM (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER p AS ad,
             last_value(value IGNORE NULLS) OVER p AS av,
             first_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER n AS bd,
             first_value(value IGNORE NULLS) OVER n AS bv
      FROM region_rain WINDOW p AS (PARTITION BY station ORDER BY date ROWS UNBOUNDED PRECEDING),
           n AS (PARTITION BY station ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def candidate_sql(method: str) -> str:
    if method == "linear":
        return LINEAR
    return f"SELECT station, date, value, {CANDIDATES[method]} AS candidate FROM region_rain"


for _method in [*CANDIDATES, "linear"]:
    def _plan(spark, sf, method=_method):
        return r6(impute.candidates(views.region_rain(spark, sf), method), "candidate", digits=8).select(
            "station", "date", "candidate")

    register(f"m02_{_method}", sql("region_rain",
             f"SELECT station, date, round(candidate, 8) AS candidate FROM ({candidate_sql(_method)})"))(_plan)


FINAL = """
SELECT station, date, value AS observed,
       coalesce(value, round_even(greatest(candidate, 0), 9)) AS value, CAST(value IS NULL AS INT) AS imputed
FROM ({0})"""


def completed(spark, sf, method="month_climatology"):
    return impute.impute(views.region_rain(spark, sf), method, digits=9)


@register("p11_composite", sql("region_rain",
          f"SELECT station, date, observed, round(value, 8) AS value, imputed FROM ({FINAL.format(candidate_sql('linear'))})"))
def p11(spark, sf):
    return r6(completed(spark, sf, "linear"), "value", digits=8)


@register("m05_completed_table", sql("region_rain",
          f"SELECT station, date, round(value, 8) AS value, imputed FROM ({FINAL.format(candidate_sql('month_climatology'))})"))
def m05(spark, sf):
    done = impute.assert_complete(completed(spark, sf)).select("station", "date", "value", "imputed")
    return r6(done, "value", digits=8)


@register("a25_imputation_counts", sql("region_dense", """
WITH g AS (SELECT *, count(*) FILTER (value IS NULL) OVER (PARTITION BY date) < 3 AS ok,
                  avg(value) OVER (PARTITION BY date) AS candidate FROM region_dense),
f AS (SELECT station, value AS observed, coalesce(value, CASE WHEN ok THEN candidate END) AS value FROM g)
SELECT coalesce(station, 'OVERALL') AS station, count(*) FILTER (observed IS NULL) AS n_missing_before,
       count(*) FILTER (observed IS NULL AND value IS NOT NULL) AS n_imputed,
       count(*) FILTER (value IS NULL) AS n_still_missing FROM f GROUP BY GROUPING SETS ((station), ())"""))
def a25(spark, sf):
    series = quality.with_eligibility(views.region_dense(spark, sf), 3)
    done = impute.impute(series, "date_mean", digits=4, eligible=F.col("eligible") == 1)
    return impute.imputation_counts(done)


@register("a14_imputation_report", sql("region_rain", f"""
SELECT station, round(avg(observed), 6) AS mean_before, round(stddev_samp(observed), 6) AS std_before,
       round(max(observed), 6) AS max_before, round(avg(value), 6) AS mean_after,
       round(stddev_samp(value), 6) AS std_after, round(max(value), 6) AS max_after,
       round(quantile_cont(observed, 0.5), 6) AS median_before, round(quantile_cont(value, 0.5), 6) AS median_after,
       round((avg(value) - avg(observed)) / avg(observed) * 100, 6) AS shift_pct
FROM ({FINAL.format(candidate_sql('month_climatology'))}) GROUP BY station"""))
def a14(spark, sf):
    report = stats.imputation_report(views.cut_lineage(completed(spark, sf)))
    return r6(report, *[c for c in report.columns if c != "station"])


@register("a15_histogram", sql("region_rain", f"""
WITH v AS (SELECT station, imputed, value FROM ({FINAL.format(candidate_sql('linear'))}) WHERE value > 0.1),
r AS (SELECT station, imputed, min(value) AS lo, max(value) AS hi, count(*) AS n FROM v GROUP BY 1, 2),
b AS (SELECT station, imputed, CAST(least(floor((value - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, lo, hi, r.n AS total
      FROM v JOIN r USING (station, imputed))
SELECT station, imputed, bin, round(min(lo + bin * ((hi - lo) / 50)), 6) AS bin_start, count(*) AS n,
       round(count(*) / min(total * ((hi - lo) / 50)), 6) AS density
FROM b GROUP BY station, imputed, bin"""))
def a15(spark, sf):
    wet = quality.wet_values(completed(spark, sf, "linear"), 0.1)
    return r6(stats.histogram(wet, ["station", "imputed"]), "bin_start", "density")


@register("m06_holdout_scores", sql("region_rain", f"WITH held AS ({HOLDOUT.format(f='0.2', view='region_rain')}) "
          + " UNION ALL ".join(f"""
SELECT '{m}' AS model, coalesce(station, 'OVERALL') AS station, count(*) AS n,
       round(sqrt(avg((candidate - truth) ** 2)), 6) AS rmse,
       round(1 - avg((candidate - truth) ** 2) / var_pop(truth), 6) AS r2
FROM (SELECT station, truth, holdout, {c} AS candidate FROM (
    SELECT station, date, value AS truth, holdout, CASE WHEN holdout = 0 THEN value END AS value FROM held))
WHERE holdout = 1 AND candidate IS NOT NULL GROUP BY GROUPING SETS ((station), ())""" for m, c in CANDIDATES.items())
          + f"""
UNION ALL SELECT 'linear' AS model, coalesce(station, 'OVERALL') AS station, count(*) AS n,
       round(sqrt(avg((candidate - truth) ** 2)), 6) AS rmse,
       round(1 - avg((candidate - truth) ** 2) / var_pop(truth), 6) AS r2
FROM ({LINEAR.replace("station, date, value, CASE", "station, truth, holdout, CASE").replace("FROM region_rain", """
      FROM (SELECT station, date, value AS truth, holdout, CASE WHEN holdout = 0 THEN value END AS value FROM held)""")})
WHERE holdout = 1 AND candidate IS NOT NULL GROUP BY GROUPING SETS ((station), ())"""))
def m06(spark, sf):
    held = views.cut_lineage(split.holdout_cells(views.region_rain(spark, sf), 0.2, 42))
    hidden = held.select("station", "date", "holdout", F.col("value").alias("truth"),
                         F.when(F.col("holdout") == 0, F.col("value")).alias("value"))
    scored = None
    for method in (*CANDIDATES, "linear"):
        cells = impute.candidates(hidden, method).where("holdout = 1 AND candidate IS NOT NULL").select(
            F.lit(method).alias("model"), "station", F.col("truth").alias("actual"), F.col("candidate").alias("pred"))
        scored = cells if scored is None else scored.unionByName(cells)
    return r6(metrics.skill(scored, ["model"]), "rmse", "r2").select("model", "station", "n", "rmse", "r2")
