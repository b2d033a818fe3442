"""Scans, quality rules, calendar checks, joins and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.operators import calendar, features, joins, quality, rollup
from rainloom.plans import views
from rainloom.plans.registry import r6, register
from rainloom.plans.views import sql
from rainloom.sources import tables

# ---------------------------------------------------------------- projection, flags, limits


@register("p01_project", "SELECT event_type AS station, ts, value FROM events")
def p01(spark, sf):
    return views.table(spark, sf, "events").select(F.col("event_type").alias("station"), "ts", "value")


@register("p02_missing_flag", sql("telemetry_dense",
          "SELECT station, ts, value, CAST(value IS NULL AS INT) AS missing FROM telemetry_dense"))
def p02(spark, sf):
    return quality.with_missing_flag(views.telemetry_dense(spark, sf))


@register("p03_any_all_missing", sql("region_dense", """
SELECT date, CAST(max(m) AS INT) AS any_missing, CAST(min(m) AS INT) AS all_missing, CAST(sum(m) AS BIGINT) AS n_missing
FROM (SELECT date, CAST(value IS NULL AS INT) AS m FROM region_dense) GROUP BY date"""))
def p03(spark, sf):
    return quality.missing_by_date(views.region_dense(spark, sf))


@register("p04_real_observations", sql("region_filled",
          "SELECT station, date, value FROM region_filled WHERE value IS NOT NULL AND imputed = 0"))
def p04(spark, sf):
    return quality.real_observations(views.region_filled(spark, sf)).select("station", "date", "value")


LIMITED = """
SELECT station, date, {value} AS value,
       CAST(coalesce(x > 3.0, false) AS INT) AS above_soft, CAST(coalesce(x < 0, false) AS INT) AS below_lower{flag}
FROM (SELECT station, date, value - 0.8 AS x FROM region_dense)"""
UPPER_FLAG = ", CAST(coalesce(x > 6.0, false) AS INT) AS above_upper"


def limited(spark, sf, policy):
    shifted = views.region_dense(spark, sf).withColumn("value", F.col("value") - 0.8)
    return r6(quality.apply_limits(shifted, 0.0, 6.0, 3.0, policy), "value")


@register("p05_limits_null", sql("region_dense", LIMITED.format(
    value="round(CASE WHEN x > 6.0 THEN NULL WHEN x < 0 THEN 0.0 ELSE x END, 6)", flag=UPPER_FLAG)))
def p05(spark, sf):
    return limited(spark, sf, "null")


@register("p05_limits_flag", sql("region_dense", LIMITED.format(
    value="round(CASE WHEN x < 0 THEN 0.0 ELSE x END, 6)", flag=UPPER_FLAG)))
def p05b(spark, sf):
    return limited(spark, sf, "flag")


@register("p05_limits_keep", sql("region_dense", LIMITED.format(value="round(x, 6)", flag="")))
def p05c(spark, sf):
    return limited(spark, sf, "keep")


@register("p06_complete_rows", sql("region_dense", "SELECT date, " + ", ".join(
    f"max(CASE WHEN station = '{s}' THEN value END) AS s{s}" for s in views.REGION_STATIONS)
    + " FROM region_dense GROUP BY date HAVING " + " AND ".join(f"s{s} IS NOT NULL" for s in views.REGION_STATIONS)))
def p06(spark, sf):
    wide = joins.long_to_wide(views.region_dense(spark, sf), views.REGION_STATIONS)
    named = wide.withColumnsRenamed({s: f"s{s}" for s in views.REGION_STATIONS})
    return quality.complete_rows(named, [f"s{s}" for s in views.REGION_STATIONS])


@register("p07_eligible_cells", sql("region_dense", """
SELECT station, date, n_missing, CAST(value IS NULL AND n_missing < 4 AS INT) AS eligible
FROM (SELECT *, count(*) FILTER (value IS NULL) OVER (PARTITION BY date) AS n_missing FROM region_dense)"""))
def p07(spark, sf):
    return quality.with_eligibility(views.region_dense(spark, sf), 4).select(
        "station", "date", "n_missing", "eligible")


@register("p08_support_gate", sql("region_filled", f"""
SELECT station, count(*) AS n_real FROM region_filled
WHERE imputed = 0 AND value IS NOT NULL AND date >= {views.cut_sql("region_filled", True)} GROUP BY station HAVING count(*) >= 20"""))
def p08(spark, sf):
    series = views.cut_lineage(views.region_filled(spark, sf))
    late = series.where(F.col("date") >= views.cuts(series)[1])
    return quality.support_status(late, 20).where("status = 'scored'").select("station", "n_real")


@register("p09_wet_values", sql("region_rain", "SELECT station, date, value FROM region_rain WHERE value > 0.1"))
def p09(spark, sf):
    return quality.wet_values(views.region_rain(spark, sf), 0.1)


@register("p13_default_fill", sql("region_rain",
          "SELECT station, date, coalesce(value, 0.0) AS value FROM region_rain"))
def p13(spark, sf):
    return views.region_rain(spark, sf).na.fill(0.0, ["value"])


@register("p14_offline_status", sql("region_filled", """
SELECT station, count(*) FILTER (imputed = 0 AND value IS NOT NULL) AS n_real,
       CASE WHEN count(*) FILTER (imputed = 0 AND value IS NOT NULL) < 1890 THEN 'sensor_offline' ELSE 'scored' END
           AS status
FROM region_filled GROUP BY station"""))
def p14(spark, sf):
    return quality.support_status(views.region_filled(spark, sf), 1890)


# ---------------------------------------------------------------- calendar


@register("j06_missing_timestamps", sql("telemetry", """
SELECT s.station, c.ts
FROM (SELECT DISTINCT station FROM telemetry) s
CROSS JOIN (SELECT unnest(generate_series((SELECT min(ts) FROM telemetry), (SELECT max(ts) FROM telemetry),
                   INTERVAL 15 MINUTE)) AS ts) c
WHERE NOT EXISTS (SELECT 1 FROM telemetry t WHERE t.station = s.station AND t.ts = c.ts)"""))
def j06(spark, sf):
    return calendar.missing_timestamps(views.cut_lineage(views.telemetry(spark, sf)), time="ts", minutes=15)


@register("j07_densify_daily", sql("region_dense", "SELECT station, date, value FROM region_dense"))
def j07(spark, sf):
    return views.region_dense(spark, sf)


@register("j07_densify_slots", sql("telemetry_dense", "SELECT station, ts, value FROM telemetry_dense"))
def j07b(spark, sf):
    return views.telemetry_dense(spark, sf)


@register("u03_absent_dates", sql("region_raw", """
SELECT s.station, c.date FROM (SELECT DISTINCT station FROM region_raw) s CROSS JOIN (
    SELECT CAST(unnest(generate_series((SELECT min(date) FROM region_raw), (SELECT max(date) FROM region_raw),
           INTERVAL 1 DAY)) AS DATE) AS date) c
EXCEPT SELECT station, date FROM region_raw"""))
def u03(spark, sf):
    series = views.cut_lineage(views.region(spark, sf))
    return calendar.spine(series).select("station", "date").exceptAll(series.select("station", "date"))


@register("w17_date_gaps", sql("region_raw", """
SELECT station, date, CAST(gap AS INT) AS gap_steps
FROM (SELECT *, datediff('day', lag(date) OVER (PARTITION BY station ORDER BY date), date) AS gap FROM region_raw)
WHERE gap <> 1"""))
def w17(spark, sf):
    return calendar.date_gaps(views.cut_lineage(views.region(spark, sf))).select("station", "date", "gap_steps")


@register("w07_missing_blocks", sql("region_dense", """
SELECT station, min(date) AS block_start, max(date) AS block_end, count(*) AS block_length
FROM (SELECT *, date - CAST(row_number() OVER (PARTITION BY station ORDER BY date) AS INT) AS g
      FROM region_dense WHERE value IS NULL)
GROUP BY station, g"""))
def w07(spark, sf):
    return calendar.missing_blocks(views.region_dense(spark, sf))


@register("a10_duplicates", """
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT event_type, date_trunc('minute', ts) FROM events))
           AS n_keys,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_type, date_trunc('minute', ts) FROM events))
           AS n_duplicates
FROM events""")
def a10(spark, sf):
    minutes = views.table(spark, sf, "events").select(
        F.col("event_type").alias("station"), F.window("ts", "1 minute").start.alias("ts"))
    return calendar.duplicate_count(minutes)


# ---------------------------------------------------------------- roll-ups


@register("a01_rollup_daily", """
SELECT event_type AS station, CAST(ts AS DATE) AS date, round(coalesce(sum(value), 0.0), 6) AS total,
       max(value) AS peak, round(stddev_samp(value), 6) AS std
FROM events GROUP BY 1, 2""")
def a01(spark, sf):
    events = views.table(spark, sf, "events").withColumnRenamed("event_type", "station")
    return r6(rollup.daily(events), "total", "std")


@register("a01_rollup_dense_days", sql("telemetry_dense", """
SELECT station, CAST(ts AS DATE) AS date, round(coalesce(sum(value), 0.0), 6) AS total, max(value) AS peak,
       round(stddev_samp(value), 6) AS std
FROM telemetry_dense GROUP BY 1, 2"""))
def a01b(spark, sf):
    return r6(rollup.daily(views.telemetry_dense(spark, sf)), "total", "std")


@register("u01_rollup_wide", sql("telemetry", "SELECT CAST(ts AS DATE) AS date, " + ", ".join(
    f"round(coalesce(sum(value) FILTER (station = '{s}'), 0.0), 6) AS {s}_total, "
    f"max(value) FILTER (station = '{s}') AS {s}_peak, "
    f"round(stddev_samp(value) FILTER (station = '{s}'), 6) AS {s}_std" for s in views.EVENT_STATIONS)
    + " FROM telemetry GROUP BY 1"))
def u01(spark, sf):
    wide = rollup.daily_wide(views.telemetry(spark, sf), views.EVENT_STATIONS)
    return r6(wide, *[f"{s}_{c}" for s in views.EVENT_STATIONS for c in ("total", "std")])


@register("a02_increment_total", sql("telemetry", """
SELECT station, CAST(ts AS DATE) AS date, round(sum(value), 6) AS total FROM telemetry GROUP BY 1, 2"""))
def a02(spark, sf):
    return r6(views.telemetry(spark, sf).groupBy("station", F.to_date("ts").alias("date"))
              .agg(rollup.total(F.col("value")).alias("total")), "total")


@register("a03_missing_summary", sql("region_dense", """
SELECT coalesce(station, 'OVERALL') AS station, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_missing,
       round(100.0 * count(*) FILTER (value IS NULL) / count(*), 6) AS pct_missing
FROM region_dense GROUP BY GROUPING SETS ((station), ())"""))
def a03(spark, sf):
    return r6(quality.missing_summary(views.region_dense(spark, sf)), "pct_missing")


@register("a04_monthly_missing", sql("region_dense", """
SELECT station, CAST(date_trunc('month', date) AS DATE) AS month,
       round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_fraction
FROM region_dense GROUP BY 1, 2"""))
def a04(spark, sf):
    return r6(rollup.monthly_missing(views.region_dense(spark, sf)), "missing_fraction")


@register("a05_monthly_totals", sql("region_dense", """
SELECT station, CAST(date_trunc('month', date) AS DATE) AS month, round(coalesce(sum(value), 0.0), 6) AS total
FROM region_dense GROUP BY 1, 2"""))
def a05(spark, sf):
    return r6(rollup.monthly_totals(views.region_dense(spark, sf)), "total")


@register("a06_monthly_covariates", sql("covar", """
SELECT CAST(date_trunc('month', date) AS DATE) AS month, round(sum(cv_tp), 8) AS cv_tp,
       round(avg(cv_disc), 6) AS cv_disc, round(avg(cv_tax), 6) AS cv_tax
FROM covar GROUP BY 1"""))
def a06(spark, sf):
    how = {"cv_tp": "sum", "cv_disc": "avg", "cv_tax": "avg"}
    out = rollup.monthly_covariates(views.covar(spark, sf), how)
    return r6(r6(out, "cv_disc", "cv_tax"), "cv_tp", digits=8)


@register("a07_monthly_real_totals", sql("region_filled", """
SELECT station, CAST(date_trunc('month', date) AS DATE) AS month, count(*) FILTER (imputed = 0) AS real_days,
       round(CASE WHEN count(*) FILTER (imputed = 0) >= 24 THEN sum(value) FILTER (imputed = 0) END, 6) AS total
FROM region_filled GROUP BY 1, 2"""))
def a07(spark, sf):
    return r6(rollup.monthly_real_totals(views.region_filled(spark, sf), 24), "total")


@register("w10_moving_average", sql("region_dense", """
WITH m AS (SELECT station, CAST(date_trunc('month', date) AS DATE) AS month, coalesce(sum(value), 0.0) AS total
           FROM region_dense GROUP BY 1, 2)
SELECT station, month, round(total, 6) AS total,
       round(avg(total) OVER (PARTITION BY station ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 9) AS ma12
FROM m"""))
def w10(spark, sf):
    months = rollup.monthly_totals(views.region_dense(spark, sf))
    return r6(r6(rollup.moving_average(months, 12), "total"), "ma12", digits=9)


@register("w21_monthly_lags", sql("region_filled", """
WITH m AS (SELECT station, CAST(date_trunc('month', date) AS DATE) AS month,
           CASE WHEN count(*) FILTER (imputed = 0) >= 24 THEN sum(value) FILTER (imputed = 0) END AS total
           FROM region_filled GROUP BY 1, 2),
l AS (SELECT station, month, total, lag(total, 1) OVER w AS lag1m, lag(total, 2) OVER w AS lag2m,
             avg(total) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS roll3m
      FROM m WINDOW w AS (PARTITION BY station ORDER BY month))
SELECT station, month, round(total, 6) AS total, round(lag1m, 6) AS lag1m, round(lag2m, 6) AS lag2m,
       round(roll3m, 6) AS roll3m, round(ln(1 + coalesce(lag1m, 0)), 6) AS log_lag1m,
       round(ln(1 + coalesce(lag2m, 0)), 6) AS log_lag2m
FROM l"""))
def w21(spark, sf):
    months = rollup.monthly_real_totals(views.region_filled(spark, sf), 24).drop("real_days")
    return r6(rollup.monthly_lags(months), "total", "lag1m", "lag2m", "roll3m", "log_lag1m", "log_lag2m")


@register("a16_integrity", sql("region_rain", """
WITH f AS (SELECT value, lag(value, 3) OVER w AS lag3, lag(value, 7) OVER w AS lag7,
                  avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rm7
           FROM region_rain WINDOW w AS (PARTITION BY station ORDER BY date))
SELECT unnest(['value', 'lag3', 'lag7', 'rm7']) AS column_name,
       unnest([count(*) - count(value), count(*) - count(lag3), count(*) - count(lag7), count(*) - count(rm7)])
           AS n_null,
       count(*) AS n_rows
FROM f"""))
def a16(spark, sf):
    series = views.region_rain(spark, sf)
    wide = features.add_rolling(features.add_lags(series, [3, 7]), [7])
    return quality.integrity(wide, ["value", "lag3", "lag7", "rm7"])


@register("a17_cross_station_mean", sql("region_dense", """
SELECT date, round(avg(value), 6) AS station_mean, count(value) AS n_stations FROM region_dense GROUP BY date"""))
def a17(spark, sf):
    return r6(rollup.cross_station_mean(views.region_dense(spark, sf)), "station_mean")


@register("a18_grid_daily_area", sql("grid", """
WITH s AS (SELECT ts, avg(t2m) AS t2m, avg(sp) AS sp, avg(tp) AS tp FROM grid GROUP BY ts)
SELECT CAST(ts AS DATE) AS date, round(avg(t2m), 9) AS t2m, round(avg(sp), 8) AS sp, round(sum(tp), 15) AS tp
FROM s GROUP BY 1"""))
def a18(spark, sf):
    area = rollup.grid_daily(views.grid(spark, sf), mean=["t2m", "sp"], accumulate=["tp"])
    return area.withColumns({"t2m": F.round("t2m", 9), "sp": F.round("sp", 8), "tp": F.round("tp", 15)})


@register("s08_grid_cell_daily", sql("grid", """
WITH s AS (SELECT lat, lon, ts, avg(t2m) AS t2m, avg(tp) AS tp FROM grid GROUP BY ALL)
SELECT lat, lon, CAST(ts AS DATE) AS date, round(avg(t2m), 9) AS t2m, round(sum(tp), 15) AS tp FROM s GROUP BY ALL"""))
def s08(spark, sf):
    cells = rollup.grid_daily(views.grid(spark, sf), ["t2m"], ["tp"], keys=("lat", "lon"))
    return cells.withColumns({"t2m": F.round("t2m", 9), "tp": F.round("tp", 15)})


@register("a26_station_profile", sql("region_rain", """
SELECT station, round(avg(value), 6) AS mean_value, max(value) AS max_value,
       round(100.0 * count(*) FILTER (value = 0) / count(value), 6) AS zero_pct,
       round(avg(value) FILTER (value > 0), 6) AS wet_mean, count(*) FILTER (value IS NULL) AS n_missing,
       round(100.0 * count(*) FILTER (value > 5) / count(value), 6) AS extreme_pct
FROM region_rain GROUP BY station"""))
def a26(spark, sf):
    return r6(quality.station_profile(views.region_rain(spark, sf), 5.0),
              "mean_value", "zero_pct", "wet_mean", "extreme_pct")


@register("a09_cooccurrence", sql("region_dense", """
WITH m AS (SELECT station, date, value IS NULL AS gone FROM region_dense),
al AS (SELECT count(*) AS all_missing FROM (SELECT date FROM m GROUP BY date HAVING bool_and(gone)))
SELECT a.station AS station_a, b.station AS station_b, count(*) FILTER (a.gone AND b.gone) AS both_missing,
       count(*) FILTER (a.gone AND NOT b.gone) AS only_a_missing,
       count(*) FILTER (NOT a.gone AND b.gone) AS only_b_missing, (SELECT all_missing FROM al) AS all_missing
FROM m a JOIN m b ON a.date = b.date AND a.station < b.station GROUP BY 1, 2"""))
def a09(spark, sf):
    return quality.cooccurrence(views.region_dense(spark, sf), views.REGION_STATIONS)


@register("a09_missing_patterns", sql("region_dense", """
SELECT pattern, count(*) AS n_dates
FROM (SELECT date, coalesce(string_agg(station, '+' ORDER BY station) FILTER (value IS NULL), '') AS pattern
      FROM region_dense GROUP BY date) GROUP BY pattern"""))
def a09b(spark, sf):
    return quality.missing_patterns(views.region_dense(spark, sf), views.REGION_STATIONS)


# ---------------------------------------------------------------- joins, reshaping, preview


@register("s03_wide_to_long", sql("telemetry", """
SELECT station, date, total AS value
FROM (SELECT CAST(ts AS DATE) AS date, station, round(sum(value), 6) AS total FROM telemetry GROUP BY 1, 2)"""))
def s03(spark, sf):
    wide = rollup.daily_wide(views.telemetry(spark, sf), views.EVENT_STATIONS)
    named = wide.select("date", *[F.round(f"{s}_total", 6).alias(s) for s in views.EVENT_STATIONS])
    return joins.wide_to_long(named, ["date"], views.EVENT_STATIONS)


@register("s01_interval_export", sql("telemetry", """
SELECT t.station, c.ts, c.ts + INTERVAL 15 MINUTE AS ts_end, v.value
FROM (SELECT DISTINCT station FROM telemetry) t CROSS JOIN (SELECT DISTINCT ts FROM telemetry) c
LEFT JOIN telemetry v ON v.station = t.station AND v.ts = c.ts"""))
def s01(spark, sf):
    """Write the telemetry as an interval export (metadata and name lines first), then read it."""
    from rainloom.session import scratch_path
    from rainloom.sources.interval_export import read_interval_series

    named = views.EVENT_STATIONS
    wide = joins.align_by_date(views.telemetry(spark, sf), named, ["value"], time="ts")
    blank = F.lit("")
    lines = wide.select(F.concat_ws(
        ",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.date_format(F.col("ts") + F.expr("INTERVAL 15 MINUTES"), "yyyy-MM-dd HH:mm:ss"),
        *[F.coalesce(F.col(f"{s}_value").cast("string"), blank) for s in named]).alias("value"))
    head = spark.createDataFrame([(t,) for t in ("export", "ids", "names", "units", "Start,End" + ",Total" * len(named))],
                                 "value string")
    path = scratch_path(spark)
    head.unionByName(lines).write.text(path)
    return read_interval_series(spark, path, named)


@register("s04_csv_round_trip", sql("region_dense", "SELECT station, date, value FROM region_dense"))
def s04(spark, sf):
    from rainloom.session import scratch_path
    from rainloom.sources import sinks, tables

    path = scratch_path(spark)
    sinks.write_csv(views.region_dense(spark, sf).withColumnRenamed("date", "Date"), path)
    return tables.canonical_date(tables.read_csv(spark, path, "station string, Date date, value double"))


@register("s10_series_sink", sql("ship", "SELECT station, date, value FROM ship"))
def s10(spark, sf):
    from rainloom.session import scratch_path
    from rainloom.sources import sinks

    path = scratch_path(spark)
    sinks.write_series(views.ship(spark, sf), path)
    return spark.read.schema("date date, value double, station string").parquet(path).select("station", "date", "value")


@register("s15_map_covariates", sql("covar", """
SELECT date, cv_disc AS era5_d2m, cv_tax AS era5_t2m, cv_tp AS era5_tp FROM covar"""))
def s15(spark, sf):
    from rainloom.sources.tables import map_columns

    return map_columns(views.covar(spark, sf),
                       {"date": "date", "cv_disc": "era5_d2m", "cv_tax": "era5_t2m", "cv_tp": "era5_tp"})


@register("j01_validated_left_join", sql(["ship_dense", "covar"], """
SELECT s.station, s.date, s.value, c.cv_disc, c.cv_tp FROM ship_dense s LEFT JOIN covar c USING (date)"""))
def j01(spark, sf):
    right = views.covar_table(spark, sf).select("date", "cv_disc", "cv_tp")
    return joins.validated_join(views.ship_dense(spark, sf), right, ["date"], "left", "m:1")


@register("j01_one_to_one", sql("telemetry_dense", """
WITH d AS (SELECT station, CAST(ts AS DATE) AS date, round(coalesce(sum(value), 0), 6) AS total FROM telemetry_dense
           GROUP BY 1, 2),
e AS (SELECT event_type AS station, CAST(ts AS DATE) AS date, count(*) AS n_events FROM events GROUP BY 1, 2)
SELECT station, date, total, n_events FROM d LEFT JOIN e USING (station, date)"""))
def j01b(spark, sf):
    days = r6(rollup.daily(views.telemetry_dense(spark, sf)).select("station", "date", "total"), "total")
    counts = views.table(spark, sf, "events").groupBy(
        F.col("event_type").alias("station"), F.to_date("ts").alias("date")).agg(F.count("*").alias("n_events"))
    return joins.validated_join(days, counts, ["station", "date"], "left", "1:1")


@register("j03_inner_covariates", sql(["region_dense", "covar"], """
SELECT r.station, r.date, r.value, c.cv_disc, c.cv_tax, c.cv_tp FROM region_dense r JOIN covar c USING (date)"""))
def j03(spark, sf):
    return views.region_dense(spark, sf).join(views.covar_table(spark, sf), ["date"])


@register("j04_monthly_join", sql(["region_dense", "covar"], """
WITH m AS (SELECT station, CAST(date_trunc('month', date) AS DATE) AS month, round(coalesce(sum(value), 0), 6) AS total
           FROM region_dense GROUP BY 1, 2),
c AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, round(sum(cv_tp), 8) AS cv_tp FROM covar GROUP BY 1)
SELECT station, month, total, cv_tp FROM m JOIN c USING (month)"""))
def j04(spark, sf):
    months = r6(rollup.monthly_totals(views.region_dense(spark, sf)), "total")
    covariates = r6(rollup.monthly_covariates(views.covar(spark, sf), {"cv_tp": "sum"}), "cv_tp", digits=8)
    return months.join(covariates, "month")


@register("j08_align_frames", sql("predictions", "SELECT date, " + ", ".join(
    f"max(CASE WHEN station = '{s}' THEN actual END) AS s{s}_actual, "
    f"max(CASE WHEN station = '{s}' THEN pred END) AS s{s}_pred" for s in views.REGION_STATIONS)
    + " FROM predictions WHERE model = 'trailing7' GROUP BY date"))
def j08(spark, sf):
    """Actuals and one model's predictions of all stations side by side."""
    frames = views.predictions(spark, sf).where("model = 'trailing7'").select(
        F.concat(F.lit("s"), "station").alias("station"), "date", "actual", "pred")
    return joins.align_by_date(frames, [f"s{s}" for s in views.REGION_STATIONS], ["actual", "pred"])


@register("s05_date_column", sql("ship", "SELECT station, date, value FROM ship"))
def s05(spark, sf):
    """The date column is found whatever its case."""
    return tables.canonical_date(views.ship(spark, sf).withColumnRenamed("date", "DATE"))


@register("l01_sorted_series", sql("ship", "SELECT station, date, value FROM ship ORDER BY station, date"))
def l01(spark, sf):
    return views.ship(spark, sf).orderBy("station", "date")


@register("l02_head", "SELECT event_id, ts, event_type, value FROM events ORDER BY ts, event_id LIMIT 20")
def l02(spark, sf):
    return views.table(spark, sf, "events").orderBy("ts", "event_id").limit(20).select(
        "event_id", "ts", "event_type", "value")


@register("l02_tail", "SELECT event_id, ts, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def l02b(spark, sf):
    return views.table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select(
        "event_id", "ts", "event_type", "value")


@register("l06_distinct_dates", sql(["ship", "region_raw"],
          "SELECT date FROM ship UNION SELECT date FROM region_raw"))
def l06(spark, sf):
    return views.ship(spark, sf).select("date").union(views.region(spark, sf).select("date")).distinct()


# ---------------------------------------------------------------- flagship


@register("flagship_daily_features", """
WITH d AS (
  SELECT event_type AS station, CAST(ts AS DATE) AS date, coalesce(sum(value), 0.0) AS total, max(value) AS peak,
         stddev_samp(value) AS std
  FROM events GROUP BY 1, 2),
c AS (
  SELECT s.station, x.date, d.total, d.peak, d.std
  FROM (SELECT DISTINCT station FROM d) s
  CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(date) FROM d), (SELECT max(date) FROM d),
                     INTERVAL 1 DAY)) AS DATE) AS date) x
  LEFT JOIN d ON d.station = s.station AND d.date = x.date),
f AS (
  SELECT *, coalesce(total, 0) < 20000 AS dry,
         row_number() OVER w AS rn,
         avg(total) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS total_rm3,
         avg(total) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS total_rm7,
         avg(total) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS total_rm14,
         avg(peak) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS peak_rm3,
         avg(peak) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS peak_rm7,
         avg(peak) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS peak_rm14,
         lag(total, 3) OVER w AS total_lag3, lag(total, 7) OVER w AS total_lag7, lag(total, 14) OVER w AS total_lag14
  FROM c WINDOW w AS (PARTITION BY station ORDER BY date))
SELECT station, date, round(total, 6) AS total, peak, round(std, 6) AS std,
       round(total_rm3, 6) AS total_rm3, round(total_rm7, 6) AS total_rm7, round(total_rm14, 6) AS total_rm14,
       round(peak_rm3, 6) AS peak_rm3, round(peak_rm7, 6) AS peak_rm7, round(peak_rm14, 6) AS peak_rm14,
       round(total_lag3, 6) AS total_lag3, round(total_lag7, 6) AS total_lag7, round(total_lag14, 6) AS total_lag14,
       rn - coalesce(max(CASE WHEN NOT dry THEN rn END) OVER (PARTITION BY station ORDER BY date), 0) AS consec_dry,
       round(sin(2 * pi() * dayofyear(date) / 365.25), 6) AS doy_sin,
       round(cos(2 * pi() * dayofyear(date) / 365.25), 6) AS doy_cos,
       round(sin(2 * pi() * month(date) / 12), 6) AS month_sin, round(cos(2 * pi() * month(date) / 12), 6) AS month_cos
FROM f""")
def flagship(spark, sf):
    events = views.table(spark, sf, "events").select(F.col("event_type").alias("station"), "ts", "value")
    days = calendar.densify(views.cut_lineage(rollup.daily(events)))
    table = features.engineered_daily(days, threshold=20000.0)
    return r6(table, *[c for c in table.columns if c not in ("station", "date", "peak", "consec_dry")])


@register("a16_gap_report", sql("ship", """
WITH g AS (SELECT station, date_diff('day', lag(date) OVER (PARTITION BY station ORDER BY date), date) AS d FROM ship)
SELECT station, count(*) AS n_rows, count(*) FILTER (d <> 1) AS n_gaps, coalesce(CAST(max(d) FILTER (d <> 1) AS INT), 0) AS widest
FROM g GROUP BY station"""))
def a16_gaps(spark, sf):
    """Rows, steps that are not one day, and the widest of them, per station."""
    series = views.cut_lineage(views.ship(spark, sf))
    gaps = calendar.date_gaps(series).groupBy("station").agg(F.count("*").alias("n_gaps"), F.max("gap_steps").alias("widest"))
    rows = series.groupBy("station").agg(F.count("*").alias("n_rows"))
    return rows.join(gaps, "station", "left").select(
        "station", "n_rows", F.coalesce("n_gaps", F.lit(0).cast("bigint")).alias("n_gaps"), F.coalesce("widest", F.lit(0)).alias("widest"))


@register("s02_positional_rename", sql("region_dense", "SELECT station AS place, date AS day, value AS amount FROM region_dense"))
def s02(spark, sf):
    from rainloom.sources.interval_export import rename_by_position

    return rename_by_position(views.region_dense(spark, sf).select("station", "date", "value"), ["place", "day", "amount"])


@register("s06_name_pattern", sql("telemetry", "SELECT CAST(ts AS DATE) AS date, " + ", ".join(
    f"round(sum(CASE WHEN station = '{s}' THEN value END), 6) AS {s}_total" for s in views.EVENT_STATIONS) + " FROM telemetry GROUP BY 1"))
def s06(spark, sf):
    from rainloom.sources.tables import matching

    wide = rollup.daily_wide(views.telemetry(spark, sf), views.EVENT_STATIONS)
    return wide.select("date", *[F.round(c, 6).alias(c) for c in matching(wide.columns, suffix="_total")])


@register("s07_result_files", sql("predictions", """
WITH s AS (SELECT model, station, count(*) AS n, sqrt(avg((pred - actual) ** 2)) AS rmse, avg(pred - actual) AS bias,
                  1 - avg((pred - actual) ** 2) / var_pop(actual) AS r2 FROM predictions GROUP BY 1, 2),
b AS (SELECT station, model AS r2_daily_model, r2 AS r2_daily FROM s
      QUALIFY row_number() OVER (PARTITION BY station ORDER BY r2 DESC, model) = 1)
SELECT station, n AS n_real_test, round(rmse, 6) AS rmse_mm, round(bias, 6) AS bias_mm, r2_daily_model, round(r2_daily, 6) AS r2_daily
FROM s JOIN b USING (station) WHERE model = 'trailing7'"""))
def s07(spark, sf):
    """Scores and the best model of each station, written as one result file per station and read again."""
    from rainloom.operators import metrics
    from rainloom.session import scratch_path
    from rainloom.sources import results, sinks

    every = views.cut_lineage(metrics.skill(views.predictions(spark, sf), ["model"], pooled=False))
    best = metrics.best_model(every, ["station"]).select(
        "station", F.round("r2", 6).alias("r2_daily"), F.col("best_model").alias("r2_daily_model"))
    scores = every.where("model = 'trailing7'").select(
        "station", F.col("n").alias("n_real_test"), F.round("rmse", 6).alias("rmse_mm"), F.round("bias", 6).alias("bias_mm"))
    path = scratch_path(spark)
    sinks.results_map(scores.join(best, "station", "left")).write.option("maxRecordsPerFile", 1).text(path)
    return results.read_results(spark, path).select("station", "n_real_test", "rmse_mm", "bias_mm", "r2_daily_model", "r2_daily")
