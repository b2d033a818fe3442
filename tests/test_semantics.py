"""Missing-value, threshold and window rules on small literal tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rainloom.functions import scalars as fx
from rainloom.operators import (calendar, features, gram, impute, joins, metrics, monthly, quality, rollup, scaling, spatial,
                                split, stats, windows)
from rainloom.operators.chunks import DAILY
from rainloom.session import cut_lineage
from tests.conftest import as_pandas, column, day


def slots(spark, rows):
    return spark.createDataFrame(rows, "station string, ts string, value double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))


def test_all_missing_day_sums_to_zero_but_has_no_peak(spark):
    df = slots(spark, [("a", "2020-01-01 00:00:00", None), ("a", "2020-01-01 00:15:00", None),
                       ("a", "2020-01-02 00:00:00", 2.0)])
    rows = rollup.daily(df).orderBy("date").collect()
    assert (rows[0].total, rows[0].peak, rows[0].std) == (0.0, None, None)
    assert (rows[1].total, rows[1].peak, rows[1].std) == (2.0, 2.0, None)


def test_rolling_skips_missing_and_counts_rows(series):
    df = series({"a": [1, None, 3, None, None, None, 7]})
    assert column(features.add_rolling(df, [3]), "rm3") == [1, 1, 2, 3, 3, None, 7]
    assert column(features.add_rolling(df, [3], min_periods=2), "rm3") == [None, None, 2, None, None, None, None]
    assert column(features.add_rolling(df, [2], include_current=False, default=0.0), "roll2") == [0, 1, 1, 3, 3, 0, 0]


def test_time_rolling_uses_days_not_rows(spark):
    rows = [("a", day(d), float(v)) for d, v in ((0, 1), (1, 2), (2, 3), (9, 4), (10, 5))]
    df = spark.createDataFrame(rows, "station string, date date, value double")
    want = pd.Series([1., 2., 3., 4., 5.], pd.to_datetime([day(d) for d in (0, 1, 2, 9, 10)])).rolling(
        "7D", min_periods=2).mean()
    got = column(features.add_time_rolling(df, 7, 2, {"value": "m"}), "m")
    assert got == [None if math.isnan(v) else v for v in want]


def test_lags_and_targets(series):
    df = series({"a": [1, None, 3, 4]})
    assert column(features.add_lags(df, [1]), "lag1") == [None, 1, None, 3]
    assert column(features.add_lags(df, [1], default=0.0), "lag1") == [0, 1, 0, 3]
    assert column(features.add_targets(df, [2], start=0), "target2") == [None, None, 7, None]
    assert column(features.add_targets(df, [1], start=1), "target1") == [None, 3, 4, None]


def test_fill_forward_then_backward(series):
    df = series({"a": [None, None, 3, None, 5, None]})
    for chunk in (1, 2, 1024):
        assert column(features.fill_forward_backward(df, ["value"], DAILY.with_chunk(chunk)), "value") == [3, 3, 3, 3, 5, 5]


def test_missing_blocks_and_gaps(series, spark):
    df = series({"a": [None, 1, None, None, 2, None]})
    blocks = as_pandas(calendar.missing_blocks(df, DAILY.with_chunk(2)), "block_start")
    assert blocks["block_length"].tolist() == [1, 2, 1]
    assert blocks["block_end"].tolist() == [day(0), day(3), day(5)]
    gapped = spark.createDataFrame([("a", day(i), 1.0) for i in (0, 1, 5, 6)], "station string, date date, value double")
    assert calendar.date_gaps(gapped).collect()[0].gap_steps == 4
    dense = calendar.densify(gapped)
    assert dense.count() == 7 and dense.where("value IS NULL").count() == 3
    assert calendar.missing_timestamps(gapped).count() == 3


def test_slot_spine_has_every_quarter_hour(spark):
    df = slots(spark, [("a", "2020-02-28 23:30:00", 1.0), ("b", "2020-03-01 00:15:00", 1.0)])
    grid = calendar.densify(df, time="ts", minutes=15)
    assert grid.count() == 2 * (2 + 96 + 2)
    assert grid.where("value IS NOT NULL").count() == 2


def test_month_and_year_periods_differ(series):
    df = series({"a": [0.0] * 3}, start=120)
    rows = as_pandas(features.add_seasonal(df, 365.0), "date")
    other = as_pandas(features.add_seasonal(df, 365.25), "date")
    doy = np.array([day(120 + i).timetuple().tm_yday for i in range(3)])
    np.testing.assert_allclose(rows["doy_sin"], np.sin(2 * np.pi * doy / 365))
    np.testing.assert_allclose(other["doy_sin"], np.sin(2 * np.pi * doy / 365.25))


def test_scalars_keep_null_and_round_half_even(spark):
    df = spark.createDataFrame([(None,), (0.25,), (0.35,), (-1.0,), (9.0,)], "x double")
    x = F.col("x")
    rows = df.select(fx.half_even(x, 1).alias("r"), fx.clip(x, 0, 5).alias("c"), fx.floor_at(x, 0).alias("f"),
                     fx.from_log(fx.to_log(fx.floor_at(x, 0))).alias("l"), fx.wet(x, 0.25).alias("w")).collect()
    assert [r.r for r in rows] == [None, 0.2, 0.4, -1.0, 9.0]
    assert [r.c for r in rows] == [None, 0.25, 0.35, 0.0, 5.0]
    assert [r.w for r in rows] == [None, 0, 1, 0, 1]
    assert rows[0].l is None and rows[4].l == pytest.approx(9.0)


def test_losses_and_units(spark):
    one = spark.range(1)
    row = one.select(
        fx.relative_humidity(F.lit(25.0), F.lit(25.0)).alias("rh"), fx.celsius(F.lit(273.15)).alias("c"),
        fx.hectopascal(F.lit(101325.0)).alias("p"), fx.wind_speed(F.lit(3.0), F.lit(4.0)).alias("w"),
        fx.log_loss(F.lit(1.0), F.lit(0.0)).alias("ll"), fx.pinball(F.lit(2.0), F.lit(1.0), 0.9).alias("pb"),
        fx.weighted_square_error(F.lit(1.0), F.lit(0.0), 3.0).alias("we"),
        fx.gate(F.lit(5.0), F.lit(0.4), 0.4).alias("g"), fx.millimetres(F.lit(0.002)).alias("mm")).first()
    assert row.rh == pytest.approx(100) and row.c == 0 and row.p == 1013.25 and row.w == 5
    assert row.ll == pytest.approx(-math.log(1e-7)) and row.pb == pytest.approx(0.9) and row.we == 4
    assert row.g == 0 and row.mm == pytest.approx(2)


def test_limits_policies(series):
    df = series({"a": [-1, 10, 550, 700, None]})
    assert column(quality.apply_limits(df), "value") == [0, 10, 550, None, None]
    assert column(quality.apply_limits(df, policy="flag"), "value") == [0, 10, 550, 700, None]
    assert column(quality.apply_limits(df, policy="keep"), "value") == [-1, 10, 550, 700, None]
    flagged = as_pandas(quality.apply_limits(df, policy="flag"), "date")
    assert flagged["above_upper"].tolist() == [0, 0, 0, 1, 0] and flagged["above_soft"].tolist() == [0, 0, 1, 1, 0]


def test_missing_summary_and_patterns(series):
    df = series({"a": [1, None], "b": [None, None]})
    rows = {r.station: r for r in quality.missing_summary(df).collect()}
    assert rows["OVERALL"].n_missing == 3 and rows["a"].pct_missing == 50.0
    patterns = {r.pattern: r.n_dates for r in quality.missing_patterns(df, ["a", "b"]).collect()}
    assert patterns == {"b": 1, "a+b": 1}
    pair = quality.cooccurrence(df, ["a", "b"]).first()
    assert (pair.both_missing, pair.only_a_missing, pair.only_b_missing, pair.all_missing) == (1, 0, 1, 1)
    assert quality.dtype_counts(df) == {"string": 1, "date": 1, "double": 1}


def test_validated_join_fails_on_a_repeated_key_and_names_it(spark, series):
    df = series({"a": [1, 2], "b": [3, 4]})
    twice = spark.createDataFrame([(day(0), 1.0), (day(0), 2.0), (day(1), 3.0)], "date date, c double")
    joined = joins.validated_join(df, twice, ["date"], "left", "m:1")  # no job yet
    with pytest.raises(Exception, match=r'right side repeats key \{"date":"2020-01-01"\}'):
        joined.collect()
    with pytest.raises(Exception, match="left side repeats key"):
        joins.validated_join(df, twice.dropDuplicates(["date"]), ["date"], "left", "1:1").collect()
    with pytest.raises(joins.KeyViolation):
        joins.validated_join(df, twice, ["date"], validate="one:one")
    once = twice.where("c > 1")
    seen = Observation()
    assert joins.validated_join(df, once.where("c > 2"), ["date"], "left", "m:1", seen).count() == 4
    assert seen.get == {"rows": 4, "matched": 2}
    assert joins.validated_join(df, twice, ["date"], "inner", "m:m").count() == 6
    nulls = spark.createDataFrame([(None, 1.0), (None, 2.0)], "date date, c double")
    assert joins.validated_join(df, nulls, ["date"], "left", "m:1").where("c is null").count() == 4  # they join nothing


def test_validated_join_reads_each_side_once_in_the_joins_own_shuffle(spark, tmp_path):
    spark.range(1000).selectExpr("id % 100 k", "id v").write.parquet(str(tmp_path / "l"))
    spark.range(100).selectExpr("id k", "id w").write.parquet(str(tmp_path / "r"))
    left, right = spark.read.parquet(str(tmp_path / "l")), spark.read.parquet(str(tmp_path / "r"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.validated_join(left, right, ["k"], "left", "m:1")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("FileScan") == 2 and plan.count("SortMergeJoin") == 1


def test_join_stats_has_a_way_beyond_the_size_limit(spark, series):
    df = series({"a": [1, 2, 3], "b": [4, 5, 6]})
    means = df.groupBy("date").agg(F.avg("value").alias("m"))
    small = joins.join_stats(df, means, ["date"])
    small_plan, small_rows = small._jdf.queryExecution().sparkPlan().toString(), sorted(map(tuple, small.collect()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        large = joins.join_stats(df, means, ["date"])
        large_plan, large_rows = large._jdf.queryExecution().sparkPlan().toString(), sorted(map(tuple, large.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in small_plan and "BroadcastHashJoin" not in large_plan
    assert small_rows == large_rows


def test_wide_long_round_trip_and_alignment(series):
    df = series({"a": [1, 2], "b": [3, None]})
    wide = joins.long_to_wide(df, ["a", "b"])
    back = joins.wide_to_long(wide, ["date"], ["a", "b"])
    assert sorted(map(str, back.select("station", "date", "value").collect())) == sorted(map(str, df.collect()))
    aligned = joins.align_by_date(df.where("value IS NOT NULL"), ["a", "b"], ["value"]).orderBy("date").collect()
    assert aligned[1].b_value is None and aligned[1].a_value == 2


def test_monthly_real_totals_need_enough_days(spark):
    rows = [("a", day(i), 1.0, int(i >= 14)) for i in range(31)] + [("a", day(31 + i), 2.0, int(i >= 15)) for i in range(29)]
    df = spark.createDataFrame(rows, "station string, date date, value double, imputed int")
    got = rollup.monthly_real_totals(df, 15).orderBy("month").collect()
    assert [(r.real_days, r.total) for r in got] == [(14, None), (15, 30.0)]
    lags = rollup.monthly_lags(rollup.monthly_totals(df)).orderBy("month").collect()
    assert lags[1].lag1m == 31.0 and lags[1].log_lag1m == pytest.approx(math.log(32)) and lags[0].log_lag1m == 0.0


def test_grid_daily_mean_and_sum(spark):
    rows = [("2020-01-01 00:00:00", 3.0, 101.0, 10.0, 1.0), ("2020-01-01 00:00:00", 3.25, 101.0, 20.0, 3.0),
            ("2020-01-01 06:00:00", 3.0, 101.0, 30.0, 5.0)]
    grid = spark.createDataFrame(rows, "ts string, lat double, lon double, t double, tp double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    row = rollup.grid_daily(grid, ["t"], ["tp"]).first()
    assert (row.t, row.tp) == (22.5, 7.0)


def test_window_arrays(series):
    df = series({"a": [1, None, 3, 4, 5]})
    first = windows.centered_windows(df, 2).orderBy("date").first()["window"]
    assert [(c["value"], c["mask"]) for c in first] == [(0, 0), (0, 0), (1, 1), (0, 0), (3, 1)]
    seq = windows.lookback_sequences(df, 3).orderBy("date").collect()
    assert [r.date for r in seq] == [day(3), day(4)] and [c["value"] for c in seq[0]["sequence"]] == [1, None, 3]
    out = windows.explode_horizon(windows.horizon_targets(df, 2)).orderBy("date", "horizon_day").collect()
    assert [(r.forecast_date, r.horizon_day, r.value) for r in out[:2]] == [(day(0), 1, 1.0), (day(1), 2, None)]
    assert len(out) == 8


def test_scaler_round_trip_and_train_only_fit(series):
    df = series({"a": [0, 5, 10, 100]})
    train = F.col("date") < F.lit(day(3))
    params = scaling.fit_scaler(df, ["value"], where=train)
    assert params.first().asDict() == {"value_a": 0.0, "value_b": 10.0}
    scaled = scaling.scale(df, params, ["value"])
    assert column(scaled, "value_scaled") == [0, 0.5, 1, 10]
    back = scaling.unscale(scaled.withColumn("value", F.col("value_scaled")), params, ["value"])
    assert column(back, "value_raw") == [0, 5, 10, 100]
    constant = series({"a": [3, 3]})
    assert column(scaling.scale(constant, scaling.fit_scaler(constant, ["value"]), ["value"]), "value_scaled") == [0, 0]
    wide = joins.long_to_wide(series({"a": [1, 2], "b": [5, 9]}), ["a", "b"])
    assert scaling.fit_scaler(wide, ["a", "b"], pooled=True).first().asDict() == {
        "a_a": 1.0, "a_b": 9.0, "b_a": 1.0, "b_b": 9.0}


def test_holdout_is_exact_and_stable(series):
    df = series({"a": [float(i) for i in range(90)] + [None] * 9, "b": [1.0] * 11})
    held = split.holdout_cells(df, 0.2, 42)
    counts = {r.station: r for r in split.holdout_coverage(held).collect()}
    assert counts["a"].n_holdout == 18 and counts["b"].n_holdout == 2 and counts["a"].n_train == 72
    assert held.where("holdout = 1 AND value IS NULL").count() == 0
    again = split.holdout_cells(df.repartition(7), 0.2, 42)
    key = ["station", "date", "holdout"]
    assert sorted(map(tuple, held.select(*key).collect())) == sorted(map(tuple, again.select(*key).collect()))
    other = split.holdout_cells(df, 0.2, 43)
    assert sorted(map(tuple, held.select(*key).collect())) != sorted(map(tuple, other.select(*key).collect()))


@pytest.mark.parametrize("n,second", [(90, "separate"), (90, "cumulative"), (100, "separate"), (7, "separate")])
def test_split_sizes(series, n, second):
    df = series({"a": [1.0] * n, "b": [2.0] * n})
    sizes = {r.split: r["count"] // 2 for r in split.chronological_split(df, second=second).groupBy("split").count().collect()}
    train = int(n * 0.70)
    val = int(n * 0.85) - train if second == "cumulative" else int(n * 0.15)
    assert (sizes.get("train", 0), sizes.get("val", 0), sizes.get("test", 0)) == (train, val, n - train - val)
    ordered = as_pandas(split.chronological_split(df, second=second).groupBy("split").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi")), "lo")
    assert ordered["split"].tolist() == [s for s in ("train", "val", "test") if s in sizes]


def test_evenly_spaced_dates(series):
    got = split.evenly_spaced(series({"a": [1.0] * 11}), 4).orderBy("date").collect()
    assert [r.ordinal for r in got] == list(np.linspace(0, 10, 4, dtype=int))


def test_metrics_by_hand(spark):
    rows = [("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 2.0, 0.0), ("b", 4.0, 8.0), ("c", 5.0, 4.0), ("c", 5.0, 5.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "station string, actual double, pred double")
    got = {r.station: r for r in metrics.skill(df).collect()}
    assert got["a"].rmse == pytest.approx(math.sqrt(0.5)) and got["a"].r2 == pytest.approx(0.5)
    assert got["b"].r2 == pytest.approx(-9.0) and got["b"].bias == pytest.approx(1.0)
    assert got["c"].r2 is None and got["c"].n == 2 and got["c"].r is None
    assert got["a"].nrmse_pct == pytest.approx(math.sqrt(0.5) / 2 * 100)
    assert got["OVERALL"].n == 6 and got["OVERALL"].mae == pytest.approx(8 / 6)


def test_r2_does_not_cancel_for_large_means(spark):
    rows = [("a", 1e9 + i % 2 * 1e-3, 1e9) for i in range(100)]
    df = spark.createDataFrame(rows, "station string, actual double, pred double")
    actual = np.array([r[1] for r in rows])
    want = 1 - ((actual - 1e9) ** 2).sum() / ((actual - actual.mean()) ** 2).sum()
    assert metrics.skill(df, pooled=False).first().r2 == pytest.approx(want, rel=1e-3)


def test_wet_skill_counts(spark):
    rows = [("a", 1.0, 1.0), ("a", 0.0, 1.0), ("a", 2.0, 0.0), ("a", 0.0, 0.0), ("a", 0.0, 0.0)]
    got = metrics.wet_skill(spark.createDataFrame(rows, "station string, actual double, pred double")).first()
    assert (got.hits, got.false_alarms, got.misses, got.correct_dry) == (1, 1, 1, 2)
    assert got.accuracy == 0.6 and got.sensitivity == 0.5 and got.specificity == pytest.approx(2 / 3)


def test_model_tables(spark):
    rows = [("m1", "a", "daily", 0.2), ("m2", "a", "daily", 0.3), ("m0", "a", "daily", 0.3), ("m2", "b", "daily", None)]
    table = spark.createDataFrame(rows, "model string, station string, scale string, r2 double")
    best = metrics.best_model(table).collect()
    assert [(r.station, r.best_model, r.r2) for r in best] == [("a", "m0", 0.3)]
    delta = {r.model: r.delta_pp for r in metrics.compare_models(table.where("station = 'a'"), "m1").collect()}
    assert delta == {"m2": pytest.approx(10.0), "m0": pytest.approx(10.0)}
    preds = spark.createDataFrame([("x", "a", day(0), 1.0, 2.0), ("y", "a", day(0), 1.0, 4.0), ("x", "a", day(1), 1.0, 2.0)],
                                  "model string, station string, date date, actual double, pred double")
    mixed = metrics.blend(preds, {"x": 1, "y": 3}).collect()
    assert [(r.date, r.pred) for r in mixed] == [(day(0), 3.5)]


def test_spearman_matches_pandas(series):
    rng = np.random.default_rng(4)
    values = [None if rng.random() < 0.1 else round(float(rng.gamma(0.4)), 1) for _ in range(200)]
    got = {r.lag: r.rho for r in stats.lag_rank_correlation(series({"a": values}), [1, 3]).collect()}
    s = pd.Series(values, dtype=float)
    for k in (1, 3):
        pair = pd.DataFrame({"x": s, "y": s.shift(k)}).dropna().rank()
        assert got[k] == pytest.approx(pair["x"].corr(pair["y"]))


def test_histogram_density_integrates_to_one(series):
    df = series({"a": [float(i % 13) for i in range(100)], "b": [2.0] * 5})
    got = as_pandas(stats.histogram(df, ["station"], bins=10), "station", "bin")
    want, edges = np.histogram([float(i % 13) for i in range(100)], bins=10, density=True)
    a = got[got.station == "a"].set_index("bin")["density"].reindex(range(10), fill_value=0.0)
    np.testing.assert_allclose(a, want)
    assert got[got.station == "b"]["n"].tolist() == [5]


def test_describe_matches_pandas(series):
    values = [0, 0, 1.25, 7, None, 3.5, 100]
    row = stats.describe(series({"a": values}), digits=3).first()
    want = pd.Series(values, dtype=float).describe().round(3)
    assert [row.n, row["mean"], row["std"], row["min"], row.q25, row.q50, row.q75, row["max"]] == want.tolist()


def test_imputers_keep_observed_cells(series):
    df = series({"a": [1.04, None, 3, None, None, 9.06], "b": [2, 2, None, 4, None, 5]})
    for method in ("station_mean", "date_mean", "forward_fill", "linear", "month_climatology"):
        out = as_pandas(impute.impute(df, method), "station", "date")
        seen = out["observed"].notna()
        assert (out.loc[seen, "value"] == out.loc[seen, "observed"]).all() and (out.loc[seen, "imputed"] == 0).all()
        filled = out[~seen & out["value"].notna()]
        assert (filled["imputed"] == 1).all() and (filled["value"] == filled["value"].round(1)).all()
    linear = as_pandas(impute.candidates(df.where("station = 'a'"), "linear"), "date")["candidate"].tolist()
    assert linear == pytest.approx([1.04, 2.02, 3, 5.02, 7.04, 9.06])


def test_ineligible_cells_stay_missing(series):
    df = series({"a": [1, None], "b": [2, None], "c": [None, 3]})
    marked = quality.with_eligibility(df, 2)
    out = impute.impute(marked, "date_mean", eligible=F.col("eligible") == 1)
    counts = {r.station: r for r in impute.imputation_counts(out).collect()}
    assert (counts["OVERALL"].n_missing_before, counts["OVERALL"].n_imputed, counts["OVERALL"].n_still_missing) == (3, 1, 2)
    with pytest.raises(Exception, match="still missing"):
        impute.assert_complete(out).collect()


def test_normalised_prediction_is_clipped_and_floored(spark):
    df = spark.createDataFrame([(-0.2,), (0.5,), (1.5,), (None,)], "p double")
    low, high = F.lit(0.0), F.lit(math.log(11.0))
    got = [r.v for r in df.select(impute.from_normalised(F.col("p"), low, high).alias("v")).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(math.sqrt(11) - 1) and got[2] == pytest.approx(10) and got[3] is None


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=40) * 0.1
    rows = [("a", *map(float, r), float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, "station string, x1 double, x2 double, x3 double, y double")
    names = ["x1", "x2", "x3"]
    for r in monthly.fit_ridge(df, names, "y", (0.5, 10.0)).collect():
        centred = x - x.mean(0)
        want = np.linalg.solve(centred.T @ centred + r.alpha * np.eye(3), centred.T @ (y - y.mean()))
        np.testing.assert_allclose(r.coef, want, rtol=1e-6)
        assert r.intercept == pytest.approx(y.mean() - x.mean(0) @ want)


def test_quantile_mapping_by_hand(series, spark):
    train = spark.createDataFrame([("a", day(i), float(i * 10), float(i)) for i in range(5)],
                                  "station string, date date, actual double, pred double")
    other = spark.createDataFrame([("a", day(9), 0.0, -1.0), ("a", day(10), 0.0, 2.5), ("a", day(11), 0.0, 99.0)],
                                  train.schema)
    got = column(monthly.quantile_map(train, other), "mapped")
    assert got == [0.0, 30.0, 40.0]


def test_nearest_cell_with_holes_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    cells = [(round(3 + i * 0.25, 2), round(101 + j * 0.25, 2)) for i in range(12) for j in range(12) if rng.random() < 0.15]
    points = [(f"s{k}", float(3 + rng.random() * 3), float(101 + rng.random() * 3)) for k in range(60)]
    grid = spark.createDataFrame(cells, "lat double, lon double")
    stations = spark.createDataFrame(points, "station string, lat double, lon double")

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    got = {r.station: r for r in spatial.nearest_cell(stations, grid).collect()}
    for s, lat, lon in points:
        assert got[s].distance_km == pytest.approx(min(km(lat, lon, *c) for c in cells))


def test_published_station_cells(spark):
    # Five station positions and their known distances to the nearest 0.25 degree cell.
    stations = spark.createDataFrame([("p", 3.873, 103.191), ("f", 3.836, 103.161), ("k", 3.830, 103.290),
                                      ("b", 3.762, 103.236), ("c", 4.130, 103.394)], "station string, lat double, lon double")
    grid = spark.createDataFrame([(3.0 + i * 0.25, 101.0 + j * 0.25) for i in range(11) for j in range(11)],
                                 "lat double, lon double")
    got = {r.station: r for r in spatial.nearest_cell(stations, grid).collect()}
    expected = {"p": 15.1, "f": 13.7, "k": 9.9, "b": 2.0, "c": 17.8}
    for s, distance in expected.items():
        assert got[s].distance_km == pytest.approx(distance, abs=0.15)
    assert (got["c"].cell_lat, got["c"].cell_lon) == (4.25, 103.5)


def test_repeated_columns_are_dropped(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0, None), (3.0, 3.0, 4.0, None)], "a double, b double, c double, d double")
    assert spatial.drop_repeated(df, ["a", "b", "c", "d"]).columns == ["a", "c", "d"]


def test_grid_bounding_box_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(3.0, 101.0), (6.0, 110.0)], "lat double, lon double").write.parquet(str(tmp_path / "g"))
    box = spatial.bounding_box(spark.read.parquet(str(tmp_path / "g")), (2.5, 4.0), (100.0, 102.0))
    assert "GreaterThanOrEqual(lat,2.5)" in box._jdf.queryExecution().executedPlan().toString()
    assert box.count() == 1


@pytest.mark.parametrize("block, steps", [(64, 512), (2, 7), (1, 1000)])
def test_pair_statistics_in_any_blocks(series, block, steps):
    rng = np.random.default_rng(8)
    names = ["b", "a", "é", "c", "d10", "d2"]
    values = {s: [None if rng.random() < 0.3 else float(rng.integers(0, 9)) for _ in range(40)] for s in names}
    values["a"][20:] = [None] * 20
    values["c"][:20] = [None] * 20  # shares no day with a
    df = series(values)
    got = {(r.station_a, r.station_b): tuple(r)[2:] for r in quality.cooccurrence(df, names, block=block, steps=steps).collect()}
    gone = {s: np.array([v is None for v in x]) for s, x in values.items()}
    every = int(np.logical_and.reduce(list(gone.values())).sum())
    assert got == {(a, b): (int((gone[a] & gone[b]).sum()), int((gone[a] & ~gone[b]).sum()), int((~gone[a] & gone[b]).sum()), every)
                   for i, a in enumerate(names) for b in names[i + 1:]}
    want = pd.DataFrame(values, dtype=float).corr()
    long = {(r.a, r.b): r.r for r in gram.pair_correlations(df, block=block, steps=steps).collect()}
    assert set(long) == {(a, b) for a in names for b in names if a < b} - {("a", "c")}
    wide = {(r.x, r.y): r.r for r in stats.correlations(joins.long_to_wide(df, names), names).collect()}
    assert len(wide) == 15 and wide.pop(("a", "c")) is None
    for found in (long, wide):
        assert all(v == pytest.approx(want.loc[k]) for k, v in found.items())


def test_a_thousand_stations_without_an_expression_per_pair(spark):
    days = spark.range(30).selectExpr("date_add(date'2020-01-01', cast(id as int)) date", "id d")
    many = days.crossJoin(spark.range(1000).selectExpr("cast(id as string) station", "id s")).selectExpr(
        "station", "date", "case when s % 2 = d % 2 or s % 3 = 0 then (s * 7919 + d * 104729) % 101 end value")
    found = gram.pair_correlations(many.withColumn("value", F.col("value").cast("double")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 40_000
    odd, even = F.pmod(F.col("a").cast("int"), F.lit(2)), F.pmod(F.col("b").cast("int"), F.lit(2))
    third = (F.col("a").cast("int") % 3 == 0) | (F.col("b").cast("int") % 3 == 0)
    rows = cut_lineage(found)
    assert rows.count() == rows.where((odd == even) | third).count() == sum(
        1 for a in range(1000) for b in range(a) if a % 2 == b % 2 or a % 3 == 0 or b % 3 == 0)


def test_constant_and_distant_values_have_no_correlation(series):
    df = series({"a": [1e9] * 10, "b": [1e9 + k for k in range(10)], "c": [1e9 + 2 * k for k in range(10)]})
    got = {(r.a, r.b): r.r for r in gram.pair_correlations(df).collect()}
    assert got[("a", "b")] is None and got[("a", "c")] is None and got[("b", "c")] == pytest.approx(1.0)


def test_rank_correlation_with_nine_tenths_dry_days(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", day(i), 0.0 if rng.random() < 0.9 else round(float(rng.gamma(1, 9)), 3)) for i in range(3000)] + [
        (f"s{k}", day(i), float(rng.integers(0, 4))) for k in range(5) for i in range(50)]
    df = spark.createDataFrame(rows, "station string, date date, value double")
    got = {(r.station, r.lag): r.rho for r in stats.lag_rank_correlation(df, [1, 7]).collect()}
    frame = pd.DataFrame(rows, columns=["station", "date", "value"])
    for s, g in frame.groupby("station"):
        for lag in (1, 7):
            both = pd.DataFrame({"x": g.value, "y": g.value.shift(lag)}).dropna().rank()
            want = both.x.corr(both.y)
            assert got[s, lag] == pytest.approx(want, abs=1e-9)


def test_no_key_of_the_shuffled_part_of_a_spread_join_is_hot(spark):
    rows = spark.range(20_000).selectExpr("case when id % 10 < 9 then 0 else id end k", "id v")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("rank", F.col("k") + 0.5)
    joined = joins.spread_join(rows, table, ["k"], "n", 100)
    assert joined.count() == 20_000 and joined.where("rank <> k + 0.5").count() == 0 and joined.columns == ["k", "v", "rank"]
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "strategy=broadcast" in plan


def test_approximate_quantiles_option(series):
    df = series({"a": [float(i) for i in range(101)]})
    row = stats.approximate_quantiles(df, ["station"], "value", (0.25, 0.5), ("q25", "q50")).first()
    assert (row.q25, row.q50) == (25.0, 50.0)
