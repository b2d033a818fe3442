"""All features of the monthly ridge, and stations with too little test data."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rainloom.plans import q_models, views


class Mean:
    def transform(self, df):
        return df.withColumn("pred", F.lit(1.0))


def test_stations_with_few_real_test_days_are_not_fitted(spark, monkeypatch):
    asked = []

    def fit(frame, names, **_):
        asked.extend(r["station"] for r in frame.select("station").distinct().collect())
        return Mean()

    rows = [(s, date(2020, 1, 1) + timedelta(i), float(i % 3), 0, part) for s, n in (("a", 25), ("b", 19))
            for part, days in (("train", range(5)), ("test", range(5, 5 + n))) for i in days]
    frame = spark.createDataFrame(rows, "station string, date date, value double, imputed int, split string")
    every = spark.createDataFrame([("a",), ("b",), ("c",)], "station string")
    monkeypatch.setattr(views, "region_filled", lambda *_: every)
    monkeypatch.setattr(q_models, "station_rows", lambda *_: (frame, ["value"]))
    monkeypatch.setattr(q_models.boosting, "fit_station_hurdles", fit)
    out = {r["station"]: r for r in q_models.m09b(spark, "").collect()}
    assert asked == ["a"]
    assert {s: (r["n"], r["status"]) for s, r in out.items()} == {"a": (25, "scored"), "b": (19, "sensor_offline"), "c": (0, "sensor_offline")}
    assert out["b"]["rmse"] is None and out["a"]["rmse"] is not None


def months(spark):
    """Two stations of four years; the second has no real days after its third test month."""
    days = [date(2016, 1, 1) + timedelta(i) for i in range(1461)]
    rain = [(s, d, float((i * 7 + d.month * 5) % 23), int(s == "b" and d >= date(2019, 9, 1))) for s in "ab" for i, d in enumerate(days)]
    cover = [(d, (i % 11) / 11, (i % 7) / 7, float(i % 29)) for i, d in enumerate(days)]
    return (spark.createDataFrame(rain, "station string, date date, value double, imputed int"),
            spark.createDataFrame(cover, "date date, cv_disc double, cv_tax double, cv_tp double"))


def test_monthly_ridge_has_all_features_and_a_least_number_of_months(spark, monkeypatch):
    rain, cover = months(spark)
    monkeypatch.setattr(views, "region_filled", lambda *_: rain)
    monkeypatch.setattr(views, "covar", lambda *_: cover)
    frame, names = q_models.full_month_frame(spark, "")
    assert names == ["log_tp", "cv_disc", "cv_tax", "sin_m", "cos_m", "sin_2m", "cos_2m", "lag1m", "log_lag1m"]
    by = {(r["station"], r["month"].isoformat()[:7]): r for r in frame.collect()}
    march, may = by["a", "2017-03"], by["a", "2017-05"]
    assert march["sin_m"] == pytest.approx(1) and march["cos_2m"] == pytest.approx(-1) and may["lag1m"] == by["a", "2017-04"]["total"]
    assert by["a", "2016-01"]["lag1m"] == 0 and march["cv_tax"] == pytest.approx(
        sum(r["cv_tax"] for r in cover.where("year(date) = 2017 and month(date) = 3").collect()) / 31)
    out = {r["station"]: r for r in q_models.m12_full(spark, "").collect()}
    assert out["a"]["status"] == "scored" and out["a"]["rmse"] is not None and out["a"]["n"] >= 5
    assert out["b"]["status"] == "insufficient_test_months" and out["b"]["rmse"] is None and 0 < out["b"]["n"] < 5
