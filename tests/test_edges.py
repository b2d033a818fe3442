"""Inputs off the beaten track: gaps, off-grid readings, NULL keys, odd grids, skewed values, sessions without settings."""

from __future__ import annotations

import datetime as dt
import math
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.functions import scalars as fx
from rainloom.operators import calendar, features, joins, ranks, spatial, split
from rainloom.operators.chunks import Axis, over_halo
from rainloom.session import clear_scratch, cut_lineage, shared_folder


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(h, 1)))


def grid_of(kind, rng):
    if kind == "offset with holes":
        cells = [(3.125 + 0.25 * i, 101.125 + 0.25 * j) for i in range(12) for j in range(12)]
        return [c for c in cells if rng.random() < 0.4]
    if kind == "far":
        return [(-40.0 + 0.25 * i, -70.0 + 0.25 * j) for i in range(15) for j in range(15)]
    if kind == "around the date line":
        return [(0.1 + 0.25 * i, lon) for i in range(4) for lon in (-179.9, 179.6, 178.0)]
    return [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)]


@pytest.mark.parametrize("kind", ["offset with holes", "far", "around the date line", "anywhere"])
def test_nearest_cell_is_the_nearest(spark, kind):
    rng = np.random.default_rng(5)
    cells = grid_of(kind, rng)
    where = [(rng.uniform(2.5, 6.5), rng.uniform(100.5, 104.5)) for _ in range(30)] + [(89.9, 0.0), (-89.0, 179.0), (0.0, 179.95), (0.2, -179.99)]
    stations = spark.createDataFrame([(f"s{i}", a, b) for i, (a, b) in enumerate(where)] + [("none", None, 1.0)], "station string, lat double, lon double")
    out = {r.station: r for r in spatial.nearest_cell(stations, spark.createDataFrame([*cells, (None, 1.0)], "lat double, lon double")).collect()}
    assert len(out) == len(where) + 1 and out["none"].distance_km is None and out["none"].cell_lat is None
    for i, (a, b) in enumerate(where):
        assert out[f"s{i}"].distance_km == pytest.approx(min(haversine(a, b, c, d) for c, d in cells), abs=1e-6), (kind, a, b)


def test_nearest_cell_of_an_empty_grid(spark):
    stations = spark.createDataFrame([("a", 1.0, 2.0)], "station string, lat double, lon double")
    empty = spark.createDataFrame([], "lat double, lon double")
    assert [(r.cell_lat, r.distance_km) for r in spatial.nearest_cell(stations, empty).collect()] == [(None, None)]


def test_distance_of_a_missing_position_is_missing(spark):
    row = spark.range(1).select(fx.haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("d")).first()
    assert row.d is None


def stamps(spark, minutes):
    start = dt.datetime(2020, 1, 1)
    rows = [("a", None if m is None else start + dt.timedelta(minutes=m), float(v)) for m, v in minutes]
    return spark.createDataFrame(rows, "station string, ts timestamp_ntz, value double")


def test_readings_between_slots_are_never_lost_in_silence(spark):
    df = stamps(spark, [(0, 1), (7, 2), (30, 4)])
    with pytest.raises(Exception, match="off the calendar"):
        calendar.densify(df, time="ts", minutes=15).collect()
    with pytest.raises(Exception, match="no time"):
        calendar.densify(stamps(spark, [(0, 1), (None, 2)]), time="ts", minutes=15).collect()
    moved = calendar.densify(df, time="ts", minutes=15, off_grid="slot").collect()
    assert sum(r.value or 0 for r in moved) == 7.0 and len(moved) == 4
    assert sum(r.value or 0 for r in calendar.densify(df, time="ts", minutes=15, off_grid="drop").collect()) == 5.0
    with pytest.raises(ValueError):
        calendar.densify(df, time="ts", minutes=15, off_grid="other")


def test_lags_are_rows_back_on_gapped_series(spark):
    first = dt.date(2020, 1, 1)
    rows = [("a", first + dt.timedelta(days=40 * i), float(i)) for i in range(75)] + [("a", None, -1.0)]
    df = spark.createDataFrame(rows, "station string, date date, value double")
    out = features.add_lags(df, [1, 3]).collect()
    assert len(out) == 76
    for r in out:
        if r.date is not None and r.value >= 3:
            assert (r.lag1, r.lag3) == (r.value - 1, r.value - 3)


def test_halo_of_rows_equals_a_plain_window(spark):
    rng = np.random.default_rng(2)
    days = np.cumsum(rng.integers(1, 30, 400))
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(days=int(d)), float(i)) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "station string, date date, value double")
    out = over_halo(df, Axis(chunk_steps=50), lambda w: {
        "b": F.sum("value").over(w.rowsBetween(-3, -1)), "c": F.sum("value").over(w.rowsBetween(1, 2))}, before=3, after=2)
    for r in out.collect():
        i = int(r.value)
        assert (r.b or 0) == sum(range(max(0, i - 3), i)) and (r.c or 0) == sum(range(i + 1, min(400, i + 3)))


def test_missing_keys_are_a_group_like_others(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "station string, value double")
    stats = df.groupBy("station").agg(F.avg("value").alias("m"))
    assert sorted((r.value, r.m) for r in joins.join_stats(df, stats, ["station"]).collect()) == [(1.0, 2.0), (3.0, 2.0), (5.0, 5.0)]


def test_no_value_bucket_holds_a_narrow_band(spark):
    """200,000 values close together and one outlier."""
    df = spark.range(200_000).select(F.lit("a").alias("station"), (F.lit(5.0) + F.col("id") / 1e9).alias("value")) \
        .union(spark.createDataFrame([("a", 1e9)], "station string, value double"))
    sized = ranks.with_value_bucket(df, ["station"], "value").groupBy("_vb").count()
    assert sized.agg(F.max("count")).first()[0] < 0.05 * 200_001
    ordered = ranks.with_value_bucket(df, [], "value").groupBy("_vb").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("_vb").collect()
    assert all(a.hi <= b.lo for a, b in zip(ordered, ordered[1:]))


def test_ordinals_of_times_within_days(spark):
    start = dt.datetime(2020, 2, 28, 20)
    rows = [(start + dt.timedelta(minutes=17 * i),) for i in range(300)]
    out = split.ranked_dates(spark.createDataFrame(rows + rows[:9], "ts timestamp_ntz"), "ts").orderBy("ts").collect()
    assert [r.ordinal for r in out] == list(range(300)) and {r.n_dates for r in out} == {300}


def test_tables_of_an_application_can_be_removed(spark):
    folder = shared_folder(spark)
    kept = cut_lineage(spark.range(5))
    assert kept.count() == 5
    path = Path(kept.inputFiles()[0].replace("file://", "")).parent
    assert path.exists() and str(path).startswith(folder.replace("file:", "").replace("//", "/"))
    clear_scratch(spark)
    assert not path.exists()


def test_a_session_without_checkpoint_folder_runs_queries(tmp_path):
    """A new process with an empty configuration folder: nothing is set at run time, tables go below the warehouse and away."""
    script = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, {root!r})
spark = SparkSession.builder.master("local[2]").config("spark.sql.warehouse.dir", {warehouse!r}).config("spark.ui.enabled", "false") \\
    .config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__ as e
assert e.entry(spark).count() > 0
"""
    root = str(Path(__file__).resolve().parents[1])
    (tmp_path / "conf").mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_SUBMIT", "SPARK_CONF"))} | {"SPARK_CONF_DIR": str(tmp_path / "conf")}
    run = subprocess.run([sys.executable, "-c", script.format(root=root, warehouse=str(tmp_path / "wh"))], env=env, cwd=tmp_path,
                         capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-2000:]
    left = [p for p in (tmp_path / "wh").rglob("*.parquet")]
    assert not left


def test_lines_that_are_not_read_are_listed(spark, tmp_path):
    from rainloom.sources import interval_export as ie

    (tmp_path / "a.csv").write_text(
        "station export\nstart,end,x,y\n2020-01-01 00:00,2020-01-01 00:15,1.5,\n2020-01-01 00:15,2020-01-01 00:30,1.5x,NaN\n"
        "2020-01-02 made by hand\n01/02/2020 00:00,01/02/2020 00:15,3,4\n")
    path = str(tmp_path / "a.csv")
    assert [(r.x, r.y) for r in ie.read_interval_export(spark, path, ["x", "y"]).orderBy("ts_start").collect()] == [(1.5, None), (None, None)]
    assert sorted(r.reason for r in ie.rejected_lines(spark, path, ["x", "y"]).collect()) == [
        "no data line"] * 3 + ["no number: x", "no timestamps"]
    with pytest.raises(Exception, match="bad line"):
        ie.read_interval_export(spark, path, ["x", "y"], strict=True).collect()


def test_broken_result_files_are_not_skipped(spark, tmp_path):
    from rainloom.sources import results

    (tmp_path / "good.json").write_text('{"a": {"r2_daily": 0.5, "r_monthly": 0.9}}')
    (tmp_path / "bad.json").write_text("not json")
    with pytest.raises(Exception, match="no result object"):
        results.read_results(spark, str(tmp_path)).collect()
    rows = {r.file: r for r in results.read_results(spark, str(tmp_path), strict=False).collect()}
    assert rows["bad.json"].station is None and rows["good.json"].r_monthly == 0.9
