"""Fitted models: determinism, ranges, leakage and improvement over simple methods."""

from __future__ import annotations

import random
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from rainloom.operators import features, impute, learners, metrics, split
from rainloom.session import cut_lineage
from rainloom.sources import sinks
from tests.conftest import as_pandas, day

QUICK = learners.TreeSettings(rounds=3, depth=3, step=0.3)


@pytest.fixture(scope="module")
def linked(spark):
    """Three stations that share a basin signal, with some missing cells."""
    rng = random.Random(11)
    rows = []
    for i in range(240):
        basin = max(0.0, rng.gauss(3, 6)) * (1 + (i // 30) % 2)
        for s, scale in (("a", 1.0), ("b", 1.4), ("c", 0.7)):
            value = None if rng.random() < 0.15 else round(max(0.0, basin * scale + rng.gauss(0, 0.5)), 1)
            rows.append((s, day(i), value))
    return cut_lineage(spark.createDataFrame(rows, "station string, date date, value double"))


@pytest.fixture(scope="module")
def frame(spark, linked):
    series = features.add_targets(impute.impute(linked, "date_mean"), [1, 7], start=0)
    table, names = learners.tabular_features(series, lags=(1, 2, 7))
    table = split.chronological_split(table)
    table, extra = learners.station_encoding(table, F.col("split") == "train")
    names = [n for n in names if not n.startswith("target")] + extra
    return cut_lineage(table.withColumn("is_val", F.col("split") == "val").na.fill(0.0, ["value"])), names


def test_learned_imputer_beats_station_mean(linked):
    held = cut_lineage(split.holdout_cells(linked, 0.2, 42)).withColumn(
        "known", F.when(F.col("holdout") == 0, F.col("value")))
    model = learners.LearnedImputer(seeds=(42, 123), trees=10, depth=6).fit(held, "known")
    scored = model.predict(held, "known", F.col("holdout") == 1).select(
        "station", F.col("value").alias("actual"), F.col("candidate").alias("pred"))
    learned = metrics.skill(scored).where("station = 'OVERALL'").first()
    hidden = held.withColumn("truth", F.col("value")).withColumn("value", F.col("known"))
    plain = metrics.skill(impute.candidates(hidden, "station_mean").where("holdout = 1").select(
        "station", F.col("truth").alias("actual"), F.col("candidate").alias("pred"))).where("station = 'OVERALL'").first()
    assert learned.rmse < 0.8 * plain.rmse and learned.n == plain.n
    assert "x_own" not in model.names and not any(n.startswith("known") for n in model.names)


def test_learned_imputation_keeps_observed_cells_and_is_stable(linked):
    def run():
        return as_pandas(learners.learned_impute(linked, learners.LearnedImputer(seeds=(42,), trees=4, depth=4)),
                         "station", "date")
    first, second = run(), run()
    seen = first["observed"].notna()
    assert (first.loc[seen, "value"] == first.loc[seen, "observed"]).all()
    assert first["value"].notna().all() and (first["value"] >= 0).all()
    assert first["value"].tolist() == second["value"].tolist()
    assert first.loc[~seen, "imputed"].eq(1).all() and first.loc[seen, "imputed"].eq(0).all()


def test_hurdle_range_and_persistence(spark, frame, tmp_path):
    table, names = frame
    model = learners.fit_hurdle(table.where("split <> 'test'"), names, validation="is_val", gate=0.4, alpha=3.0,
                                settings=QUICK)
    test = table.where("split = 'test'")
    scored = model.transform(test)
    bounds = scored.agg(F.min("pred").alias("lo"), F.max("pred").alias("hi"),
                        F.count_if((F.col("p_wet") <= 0.4) & (F.col("pred") != 0)).alias("leaks")).first()
    assert bounds.lo >= 0 and bounds.hi <= 600 and bounds.leaks == 0
    model.save(str(tmp_path / "h"))
    loaded = learners.HurdleModel.load(str(tmp_path / "h"), gate=0.4)
    key = ["station", "date", "pred"]
    assert sorted(map(tuple, loaded.transform(test).select(*key).collect())) == sorted(
        map(tuple, scored.select(*key).collect()))


def test_hurdle_stages_are_fitted_at_once_and_alike(frame, monkeypatch):
    table, names = frame
    fit, both, key = learners.Pipeline.fit, threading.Barrier(2, timeout=60), ["station", "date", "p_wet", "pred"]

    def scored():
        model = learners.fit_hurdle(table.where("split <> 'test'"), names, validation="is_val", alpha=3.0, settings=QUICK)
        return sorted(map(tuple, model.transform(table.where("split = 'test'")).select(*key).collect()))

    with monkeypatch.context() as m:  # one after the other
        m.setattr(learners, "ThreadPoolExecutor", lambda n: ThreadPoolExecutor(1))
        alone = scored()
    monkeypatch.setattr(learners.Pipeline, "fit", lambda self, rows: both.wait() is not None and fit(self, rows))
    assert scored() == alone  # a stage that waits for the other's end breaks the barrier


def test_a_stage_that_fails_is_named(frame):
    table, names = frame
    with pytest.raises(Exception, match="no_such_column"):
        learners.fit_together((learners.regressor(["no_such_column"], "value", QUICK, 1), table),
                              (learners.regressor(names[:2], "value", QUICK, 1), table))


def test_horizons_and_model_store(spark, frame, tmp_path):
    table, names = frame
    models = learners.fit_horizons(table.where("split = 'train'"), names, (1, 7), QUICK,
                                   weight=learners.observation_weight(0.3))
    scored = learners.predict_horizons(table.where("split = 'test'"), models)
    assert {r.horizon for r in scored.select("horizon").distinct().collect()} == {1, 7}
    assert scored.where("pred < 0 OR pred IS NULL").count() == 0
    params = spark.createDataFrame([(0.0, 1.0)], "x_a double, x_b double")
    sinks.save_model(models[7], str(tmp_path / "m"), params, names)
    loaded, stored, listed = sinks.load_model(spark, str(tmp_path / "m"))
    assert listed == names and stored.first().x_b == 1.0
    key = ["station", "date", "prediction"]
    test = table.where("split = 'test'")
    assert sorted(map(tuple, loaded.transform(test).select(*key).collect())) == sorted(
        map(tuple, models[7].transform(test).select(*key).collect()))


def test_search_and_importance(frame):
    table, names = frame
    rows = table.withColumn("y", F.log1p("value"))
    found = learners.search(rows.where("split = 'train'"), rows.where("split = 'val'"), names, "y",
                            {"depth": (1, 3)}, QUICK).collect()
    assert len(found) == 2 and all(r.validation_rmse > 0 for r in found)
    marked = rows.withColumn("signal", F.col("y"))
    used = [*names[:3], "signal"]
    model = learners.regressor(used, "y", QUICK, 1).fit(marked.where("split = 'train'"))
    top = learners.top_features(learners.tree_importance(model, used, marked), 2).collect()
    assert top[0].feature == "signal" and len(top) == 2
    shuffled = learners.permutation_importance(model, marked, used, "y").orderBy(F.desc("importance")).collect()
    assert shuffled[0].feature == "signal" and len(shuffled) == len(used) and {r.repeats for r in shuffled} == {3}
    assert shuffled[0].importance > 5 * shuffled[0].spread > 0
    alone = learners.permutation_importance(model, marked, used, "y", block_days=1).collect()
    assert all(r.importance == 0 for r in alone)  # a row alone in its block keeps its values


def test_neighbours_are_the_best_correlated_and_their_columns_are_joined(spark, series):
    rng = random.Random(5)
    base = [rng.random() for _ in range(60)]
    df = series({"a": base, "b": [x + 0.1 * rng.random() for x in base], "c": [-x for x in base], "d": [rng.random() for _ in base]})
    near = {(r.station, r["rank"]): r.other for r in learners.ranked_neighbours(df, F.lit(True), 2).collect()}
    assert len(near) == 8 and near["a", 1] == "b" and near["b", 1] == "a" and "c" not in (near["a", 1], near["a", 2])
    some = spark.createDataFrame([("a", "c", 1), ("a", "d", 2), ("b", "a", 1)], "station string, other string, rank int")
    wide, names = learners.neighbour_features(df.withColumn("lag1", F.col("value") * 10), some, ["lag1"], 2)
    assert names == ["near1_lag1", "near2_lag1"]
    row = wide.where("station = 'a'").orderBy("date").first()
    assert row.near1_lag1 == pytest.approx(-10 * base[0]) and wide.where("station = 'b'").orderBy("date").first().near2_lag1 == 0.0
    assert wide.where("station in ('c', 'd') and (near1_lag1 <> 0 or near2_lag1 <> 0)").count() == 0 and wide.count() == 240


def test_no_origin_reaches_past_the_end_of_its_part(series):
    df = series({"a": [float(k) for k in range(60)]}).withColumn("imputed", (F.dayofmonth("date") % 5 == 0).cast("int"))
    rows = learners.embargoed(learners.lead_frame(df, 14, "imputed"), F.lit(day(30)), F.lit(day(45)), 14)
    got = [(r.split, r.date, r.forecast_date, r.value) for r in rows.collect()]
    assert all(v == (f - day(0)).days and f.day % 5 for _, _, f, v in got)
    ends = {"train": day(30), "val": day(45), "test": day(60)}
    assert {s for s, *_ in got} == {"train", "val", "test"} and all(f < ends[s] for s, _, f, _ in got)
    assert max(d for s, d, *_ in got if s == "train") == day(16) and max(d for s, d, *_ in got if s == "val") == day(31)


def test_features_do_not_see_the_target_day(series):
    base = [float(i % 5) for i in range(60)]
    first, names = learners.tabular_features(series({"a": base, "b": base}))
    second, _ = learners.tabular_features(series({"a": base[:-1] + [77.0], "b": base[:-1] + [55.0]}))
    last = F.col("date") == F.lit(day(59))
    assert first.where(last).select("station", *names).orderBy("station").collect() == \
        second.where(last).select("station", *names).orderBy("station").collect()
