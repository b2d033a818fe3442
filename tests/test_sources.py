"""Readers and writers on small files."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rainloom.sources import grids, interval_export, results, sinks, tables
from tests.conftest import as_pandas, day

EXPORT = """tag
ids
names
params
Start of Interval (UTC+08:00),End of Interval (UTC+08:00),Total (mm),Total (mm),Total (mm)
2009-01-01 00:00:00,2009-01-01 00:15:00,1.5,,0.0
2009-01-01 00:15:00,2009-01-01 00:30:00,0.0,0.2,NaN
"""


def test_interval_export(spark, tmp_path):
    (tmp_path / "a.csv").write_text(EXPORT)
    (tmp_path / "b.csv").write_text(EXPORT.replace("2009-01-01", "2009-01-02"))
    names = ["n1", "n2", "n3"]
    wide = interval_export.read_interval_export(spark, str(tmp_path), names)
    assert dict(wide.dtypes) == {"ts_start": "timestamp_ntz", "ts_end": "timestamp_ntz", **{n: "double" for n in names}}
    rows = wide.orderBy("ts_start").collect()
    assert len(rows) == 4 and rows[0].ts_start == dt.datetime(2009, 1, 1) and rows[0].n2 is None
    assert rows[1].n2 == 0.2 and rows[1].n3 is None
    long = interval_export.read_interval_series(spark, str(tmp_path / "a.csv"), names)
    assert long.columns == ["station", "ts", "ts_end", "value"] and long.count() == 6
    daily = interval_export.read_interval_series(spark, str(tmp_path / "a.csv"), names, daily=True)
    assert daily.columns == ["station", "date", "value"]


def test_interval_export_ignores_the_session_time_zone(spark, tmp_path):
    (tmp_path / "a.csv").write_text(EXPORT.replace("2009-01-01 00:00:00", "2009-03-08 02:30:00"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = interval_export.read_interval_export(spark, str(tmp_path / "a.csv"), ["a", "b", "c"]).orderBy("ts_start").collect()
        assert [r.ts_start for r in row] == [dt.datetime(2009, 1, 1, 0, 15), dt.datetime(2009, 3, 8, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_positional_rename(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["t", "Total", "Total"])
    assert interval_export.rename_by_position(df, ["t", "a", "b"]).first().asDict() == {"t": 1, "a": 2, "b": 3}
    with pytest.raises(ValueError):
        interval_export.rename_by_position(df, ["t"])


def test_plain_csv_and_column_helpers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Date,era5_tp,st_tp\n2020-01-02,1.5,\n2020-01-01,,2\n")
    df = tables.canonical_date(tables.read_csv(spark, str(tmp_path / "x.csv"), "Date date, era5_tp double, st_tp double"))
    assert df.columns == ["date", "era5_tp", "st_tp"] and df.where("era5_tp IS NULL").count() == 1
    assert tables.matching(df.columns, prefix="era5_") == ["era5_tp"]
    assert tables.matching(df.columns, suffix="_tp") == ["era5_tp", "st_tp"]
    assert tables.matching(df.columns, contains="t_t") == ["st_tp"]
    assert tables.map_columns(df, {"era5_tp": "tp"}).columns == ["tp"]
    with pytest.raises(ValueError):
        tables.canonical_date(df.drop("date"))


def test_results_json_with_defaults(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(
        {"a": {"r2_daily": 0.2, "n_real_test": 40}, "b": {"r2_daily": None, "note": "sensor offline"}}, indent=1))
    rows = as_pandas(results.read_results(spark, str(tmp_path), defaults={"status": "scored", "n_real_test": 0}), "station")
    assert rows["file"].tolist() == ["r.json"] * 2 and rows["n_real_test"].tolist() == [40, 0]
    assert rows["note"].tolist()[1] == "sensor offline" and rows["r2_daily"].isna().tolist() == [False, True]


def test_result_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, None), ("b", None, "offline")], "station string, r2 double, note string")
    sinks.write_results(df, str(tmp_path / "out"))
    lines = [json.loads(line) for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    assert {"station": "b", "r2": None, "note": "offline"} in lines and len(lines) == 2
    merged: dict = {}
    for r in sinks.results_map(df).collect():
        merged.update(json.loads(r.value))
    assert merged == {"a": {"r2": 0.5, "note": None}, "b": {"r2": None, "note": "offline"}}


def test_series_and_csv_sinks(spark, series, tmp_path):
    df = series({"a": [1, None], "b": [2.5, 3]})
    sinks.write_series(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {"station=a", "station=b"}
    sinks.write_csv(df, str(tmp_path / "c"))
    again = tables.read_csv(spark, str(tmp_path / "c"), "station string, date date, value double")
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))


def test_prediction_sinks(spark):
    rows = [("a", "daily", day(0), 1.0, 2.0), ("b", "weekly", day(0), 3.0, 4.0)]
    df = spark.createDataFrame(rows, "station string, scale string, date date, actual double, pred double")
    wide = sinks.wide_predictions(df, ["a", "b"], ["daily", "weekly"]).first()
    assert wide.a_daily_actual == 1.0 and wide.b_weekly_predicted == 4.0 and wide.a_weekly_actual is None
    lead = df.withColumn("horizon_day", F.lit(3)).drop("scale")
    row = sinks.horizon_predictions(lead, ["a", "b"]).first()
    assert row.forecast_date == day(2) and row.b_predicted == 4.0


def test_declared_schemas(spark, tmp_path):
    (tmp_path / "s.csv").write_text("station,lat,lon\na,3.5,101.25\n")
    assert grids.read_stations(spark, str(tmp_path / "s.csv")).first().lon == 101.25
    (tmp_path / "c.csv").write_text("station,ts,raw_daily,raw_yearly\na,2020-01-01 00:15:00,1.0,1.0\n")
    row = grids.read_counters(spark, str(tmp_path / "c.csv"), "csv").first()
    assert row.ts == dt.datetime(2020, 1, 1, 0, 15) and row.raw_daily == 1.0
    grids_path = str(tmp_path / "g")
    spark.sql("SELECT timestamp_ntz'2020-01-01 06:00:00' AS ts, 3.0D AS lat, 101.0D AS lon, 300.0D AS t2m, 295.0D AS d2m, "
              "1e5D AS sp, 0.0D AS u10, 0.0D AS v10, 50.0D AS tcwv, 0.001D AS tp").write.parquet(grids_path)
    assert grids.read_grid(spark, grids_path).first().tp == 0.001
