"""Boosted models of all stations in one job: fit, patience, scoring, search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.operators import boosting
from rainloom.operators.boosting import BoostSettings
from tests.conftest import day

QUICK = BoostSettings(rounds=60, patience=8, depth=3, step=0.2, least_weight=1.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for s, scale in (("a", 1.0), ("b", 3.0), ("c", -2.0)):
        for i in range(300):
            x, z = rng.normal(), rng.normal()
            wet = x + 0.3 * rng.normal() > 0
            out.append((s, day(i), float(x), float(z), float(np.expm1(abs(scale) * 0.5 + 0.4 * max(x, 0))) if wet else 0.0,
                        scale * x + 0.1 * rng.normal(), i >= 220))
    return spark.createDataFrame(out, "station string, date date, x double, z double, value double, y double, is_val boolean")


def test_a_tree_finds_the_best_cut():
    x = np.array([[0.0, 5], [1, 4], [2, 5], [3, 4], [4, 5], [5, 4]])
    y = np.array([0.0, 0, 0, 10, 10, 10])
    s = BoostSettings(rounds=1, depth=1, step=1.0, rows=1.0, columns=1.0, least_weight=1.0, shrink=0.0)
    found = boosting.boost(x, y, np.ones(6), np.zeros(6, bool), "squared", s, 1)
    assert found[1]["feature"][0] == 0 and 2 <= found[1]["threshold"][0] < 3 and found[0]["base"] == 5
    tree = [np.array(found[1][k]) for k in ("feature", "threshold", "leaf")]
    assert (5 + boosting.outputs(x, *tree)).tolist() == y.tolist()


def test_every_station_has_its_own_model_in_one_job(rows):
    model = boosting.fit_boosted(rows, ["x", "z"], "y", validation="is_val", settings=QUICK)
    scored = boosting.predict_boosted(rows.where("is_val"), model, ["x", "z"], "pred")
    error = {r.station: r.e for r in scored.groupBy("station").agg(F.sqrt(F.avg((F.col("pred") - F.col("y")) ** 2)).alias("e")).collect()}
    spread = {r.station: r.s for r in rows.groupBy("station").agg(F.stddev("y").alias("s")).collect()}
    assert set(error) == {"a", "b", "c"} and all(error[s] < 0.45 * spread[s] for s in error)
    assert scored.columns == [*rows.columns, "pred"]


def test_scores_of_the_model_are_its_listed_losses(rows):
    model = boosting.fit_boosted(rows, ["x", "z"], "y", validation="is_val", settings=QUICK).cache()
    scored = boosting.predict_boosted(rows.where("is_val"), model, ["x", "z"], "pred")
    error = {r.station: r.e for r in scored.groupBy("station").agg(F.sqrt(F.avg((F.col("pred") - F.col("y")) ** 2)).alias("e")).collect()}
    for r in model.where("kept").groupBy("station").agg(F.max_by("loss", "round").alias("loss")).collect():
        assert error[r.station] == pytest.approx(r.loss, abs=1e-9)


def test_patience_keeps_the_least_loss(rows):
    model = boosting.fit_boosted(rows, ["x", "z"], "y", validation="is_val", settings=QUICK)
    by = {}
    for r in model.select("station", "round", "loss", "kept").orderBy("station", "round").collect():
        by.setdefault(r.station, []).append(r)
    for found in by.values():
        losses = [r.loss for r in found]
        best = losses.index(min(losses))
        assert [r.kept for r in found] == [k <= best for k in range(len(found))]
        assert len(found) - 1 == min(QUICK.rounds, best + QUICK.patience)
        assert all(min(losses[k + 1:k + 1 + QUICK.patience]) < min(losses[:k + 1]) for k in range(best)), "it would have stopped before"


def test_row_order_and_other_stations_do_not_matter(rows):
    names = ["x", "z"]
    one = boosting.fit_boosted(rows.where("station = 'a'"), names, "y", validation="is_val", settings=QUICK)
    all_ = boosting.fit_boosted(rows.repartition(7).orderBy(F.rand(5)), names, "y", validation="is_val", settings=QUICK)
    key = ["round", "loss", "leaf"]
    assert one.select(*key).orderBy("round").collect() == all_.where("station = 'a'").select(*key).orderBy("round").collect()


def test_hurdles_beat_the_climatology_and_respect_the_gate(rows):
    model = boosting.fit_station_hurdles(rows, ["x", "z"], validation="is_val", settings=QUICK)
    scored = model.transform(rows.where("is_val"))
    assert scored.where("p_wet <= 0.5 and pred <> 0 or pred < 0 or pred > 600").count() == 0
    mean = rows.where("not is_val").groupBy("station").agg(F.avg("value").alias("m"))
    r = scored.join(mean, "station").groupBy("station").agg(
        F.avg((F.col("pred") - F.col("value")) ** 2).alias("e"), F.avg((F.col("m") - F.col("value")) ** 2).alias("c")).collect()
    assert len(r) == 3 and all(x.e < 0.7 * x.c for x in r)
    assert {x.stage for x in model.rounds().select("stage").distinct().collect()} == {"occurrence", "amount"}


def test_edge_cases(spark, rows):
    dry = rows.withColumn("value", F.when(F.col("station") == "a", 0.0).otherwise(F.col("value")))
    model = boosting.fit_station_hurdles(dry, ["x", "z"], validation="is_val", settings=QUICK)
    strange = rows.where("is_val").withColumn("station", F.when(F.col("station") == "b", "new").otherwise(F.col("station")))
    got = {r.station: (r.lo, r.hi, r.n) for r in model.transform(strange).groupBy("station").agg(
        F.min("pred").alias("lo"), F.max("pred").alias("hi"), F.count("pred").alias("n")).collect()}
    assert got["a"] == (0.0, 0.0, 80) and got["new"] == (None, None, 0) and got["c"][2] == 80
    constant = boosting.fit_boosted(rows.withColumn("y", F.lit(2.0)), ["x"], "y", validation="is_val", settings=QUICK)
    assert {r.loss for r in constant.where("kept").collect()} == {0.0}
    empty = boosting.fit_boosted(rows.limit(0), ["x"], "y", settings=QUICK)
    assert empty.collect() == [] and boosting.predict_boosted(rows, empty, ["x"], "p").where("p is null").count() == rows.count()
    without = boosting.fit_boosted(rows, ["x"], "y", settings=QUICK)
    assert without.where("not kept").count() == 0 and without.count() == 3 * (QUICK.rounds + 1)


def test_a_group_that_is_no_daily_series_is_refused(rows):
    with pytest.raises(Exception, match="one a day is expected"):
        boosting.fit_boosted(rows, ["x"], "y", settings=QUICK, most_rows=299).collect()


def test_halving_lists_all_rungs_and_chooses_the_least(rows):
    trials = {k: BoostSettings(depth=d, step=s, least_weight=1.0) for k, (d, s) in enumerate(
        [(1, 0.001), (1, 0.01), (2, 0.05), (3, 0.05), (3, 0.2), (4, 0.2), (2, 0.1), (1, 0.3)])}
    found = boosting.successive_halving(rows, ["x", "z"], "y", trials, "is_val", first_rounds=4).collect()
    assert [sum(r.rung == k for r in found) for k in range(4)] == [8, 4, 2, 1]
    assert [r.rounds for r in found if r.trial == next(x.trial for x in found if x.chosen)] == [4, 8, 16, 32]
    for k in range(3):
        rung = sorted((r.loss, r.trial) for r in found if r.rung == k)
        assert {t for _, t in rung[:len(rung) // 2]} == {r.trial for r in found if r.rung == k + 1} == {
            r.trial for r in found if r.rung == k and r.promoted}
    assert sum(r.chosen for r in found) == 1 and [r.rung for r in found if r.chosen] == [3]
