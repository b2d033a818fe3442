"""Boosted trees for every station at once: one job fits all models, another scores them.

A model belongs to a group of rows (a station, or a station under one trial of a
search) and is fitted where the group's rows meet.  A group is bounded: it has
at most one row per station and day, ``MOST_DAYS`` at the most, which is checked.
So the number of jobs does not depend on the number of stations, models are rows
of a table, and nothing of them passes through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType, _parse_datatype_string

from rainloom.functions import scalars as fx

#: Daily rows that one group may have: 270 years.
MOST_DAYS = 100_000


@dataclass(frozen=True)
class BoostSettings:
    """Rounds, patience, depth, step, shares of rows and columns, least weight of a leaf, least gain."""

    rounds: int = 400
    patience: int = 30
    depth: int = 5
    step: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    least_weight: float = 5.0
    least_gain: float = 0.1
    shrink: float = 1.0
    bins: int = 64


MODEL = ("round int, loss double, kept boolean, base double, "
         "feature array<int>, threshold array<double>, leaf array<double>")
_TREE = [("round", pa.int32()), ("loss", pa.float64()), ("kept", pa.bool_()), ("base", pa.float64()),
         ("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("leaf", pa.list_(pa.float64()))]


# ---------------------------------------------------------------- one group


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per column the values that bound its bins: a value belongs to the first bin whose bound is not below it."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]


def _tree(binned: np.ndarray, bounds: list[np.ndarray], used: np.ndarray, grad: np.ndarray, hess: np.ndarray,
          s: BoostSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1 in leaves), threshold and leaf value of each place of a full binary tree, grown level by level."""
    size = 2 ** (s.depth + 1) - 1
    feature, threshold, leaf = np.full(size, -1, np.int32), np.zeros(size), np.zeros(size)
    place = np.zeros(len(binned), np.int64)
    width, count = s.bins, len(used)
    for level in range(s.depth + 1):
        first, nodes = 2 ** level - 1, 2 ** level
        inside = place >= first
        at = place[inside] - first
        g, h = np.bincount(at, grad[inside], nodes), np.bincount(at, hess[inside], nodes)
        leaf[first:first + nodes] = -g / np.where(h > 0, h + s.shrink, 1.0) * s.step
        if level == s.depth or not inside.any():
            break
        spot = ((at[:, None] * count + np.arange(count)) * width + binned[inside][:, used]).ravel()
        sums = [np.bincount(spot, np.repeat(v[inside], count), nodes * count * width).reshape(nodes, count, width).cumsum(axis=2)
                for v in (grad, hess)]
        left_g, left_h = sums
        right_g, right_h = g[:, None, None] - left_g, h[:, None, None] - left_h
        with np.errstate(invalid="ignore"):  # nodes without rows
            gain = 0.5 * (left_g ** 2 / (left_h + s.shrink) + right_g ** 2 / (right_h + s.shrink)
                          - (g ** 2 / (h + s.shrink))[:, None, None])
        gain[(left_h < s.least_weight) | (right_h < s.least_weight)] = -np.inf
        flat = gain.reshape(nodes, -1)
        best = flat.argmax(axis=1)
        split = flat[np.arange(nodes), best] > s.least_gain
        column, cut = used[best // width], best % width
        for n in np.flatnonzero(split):
            feature[first + n], threshold[first + n] = column[n], bounds[column[n]][cut[n]]
        going = np.flatnonzero(inside)[split[at]]
        n = place[going] - first
        place[going] = 2 * place[going] + 1 + (binned[going, column[n]] > cut[n])
    return feature, threshold, leaf


def outputs(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """What one tree adds for each row."""
    place = np.zeros(len(x), np.int64)
    for _ in range(int(np.log2(len(leaf) + 1)) - 1):
        f = feature[place]
        going = np.flatnonzero(f >= 0)
        if not len(going):
            break
        n = place[going]
        place[going] = 2 * n + 1 + (x[going, f[going]] > threshold[n])
    return leaf[place]


def _loss(raw: np.ndarray, y: np.ndarray, w: np.ndarray, kind: str) -> float:
    if kind == "logistic":
        each = np.logaddexp(0, raw) - y * raw
        return float(np.average(each, weights=w))
    return float(np.sqrt(np.average((raw - y) ** 2, weights=w)))


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, check: np.ndarray, kind: str, s: BoostSettings, seed: int) -> list[dict]:
    """The rounds of one group as rows of :data:`MODEL`, up to ``patience`` rounds after the one of least validation loss.

    ``check`` marks validation rows.  Round 0 is the model without trees.  Rounds
    up to the best one are ``kept``; without validation rows all are, and the
    loss is that of the training rows.  Without training rows there is no model.
    """
    train = ~check & (w > 0)
    if not train.any():
        return []
    own, judge = np.flatnonzero(train), np.flatnonzero(check & (w > 0)) if (check & (w > 0)).any() else np.flatnonzero(train)
    mean = float(np.average(y[own], weights=w[own]))
    base = float(np.log(np.clip(mean, 1e-6, 1 - 1e-6) / np.clip(1 - mean, 1e-6, 1))) if kind == "logistic" else mean
    bounds = _edges(x[own], s.bins)
    binned = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(bounds, x[own].T)], axis=1).astype(np.uint8)
    rng = np.random.default_rng(seed)
    raw, seen = np.full(len(own), base), np.full(len(judge), base)
    rows = [{"round": 0, "loss": _loss(seen, y[judge], w[judge], kind), "base": base, "feature": [-1], "threshold": [0.0], "leaf": [0.0]}]
    best = 0
    for k in range(1, s.rounds + 1):
        if kind == "logistic":
            p = 1 / (1 + np.exp(-raw))
            grad, hess = w[own] * (p - y[own]), w[own] * np.maximum(p * (1 - p), 1e-12)
        else:
            grad, hess = w[own] * (raw - y[own]), w[own].copy()
        picked = np.flatnonzero(rng.random(len(own)) < s.rows)
        used = np.sort(rng.permutation(x.shape[1])[:max(1, int(np.ceil(s.columns * x.shape[1])))])
        if not len(picked):
            picked = np.arange(len(own))
        tree = _tree(binned[picked], bounds, used, grad[picked], hess[picked], s)
        raw += outputs(x[own], *tree)
        seen += outputs(x[judge], *tree)
        rows.append({"round": k, "loss": _loss(seen, y[judge], w[judge], kind), "base": base,
                     **{n: v.tolist() for n, v in zip(("feature", "threshold", "leaf"), tree)}})
        if rows[k]["loss"] < rows[best]["loss"]:
            best = k
        if k - best >= s.patience and check.any():
            break
    last = best if check.any() else len(rows) - 1
    return [{**r, "kept": r["round"] <= last} for r in rows]


# ---------------------------------------------------------------- all groups


def _bounded(table: pa.Table, key: tuple, most: int) -> None:
    if table.num_rows > most:
        raise ValueError(f"group {tuple(k.as_py() for k in key)} has {table.num_rows} rows; one a day is expected, {most} at most")


def _columns(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.stack([table[n].to_numpy().astype(float) for n in names], axis=1)


def fit_boosted(frame: DataFrame, names: Sequence[str], label: str, kind: str = "squared", by: Sequence[str] = ("station",),
                validation: str | None = None, weight: Column | None = None, settings: BoostSettings = BoostSettings(),
                trials: Mapping[object, BoostSettings] | None = None, seed: int = 42, most_rows: int = MOST_DAYS) -> DataFrame:
    """A model per group of ``by``: a row for each round with its validation loss, its tree, and whether it is kept.

    ``kind`` is ``squared`` or ``logistic`` (0/1 labels).  With ``trials`` the
    first column of ``by`` names the settings of a group.  Rows whose label is
    NULL are left out; missing features count as 0.  One job whatever the number
    of groups; rows with equal keys are all used.
    """
    rows = frame.where(F.col(label).isNotNull()).select(
        *by, *(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, n in enumerate(names)),
        F.col(label).cast("double").alias("_y"), (F.lit(1.0) if weight is None else weight).cast("double").alias("_w"),
        (F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)).alias("_check"))
    inputs = [f"_x{i}" for i in range(len(names))]

    def train(key: tuple, table: pa.Table) -> pa.Table:
        _bounded(table, key, most_rows)
        own = trials[key[0].as_py()] if trials else settings
        order = np.lexsort((table["_w"].to_numpy(), table["_y"].to_numpy(), *_columns(table, inputs[::-1]).T))  # whatever order rows come in
        x, y, w = _columns(table, inputs)[order], table["_y"].to_numpy()[order], table["_w"].to_numpy()[order]
        found = boost(x, y, w, table["_check"].to_numpy()[order], kind, own, seed)
        keys = [pa.array([k.as_py()] * len(found), k.type) for k in key]
        return pa.table(keys + [pa.array([r[n] for r in found], t) for n, t in _TREE], [*by, *(n for n, _ in _TREE)])

    schema = StructType([rows.schema[c] for c in by] + list(_parse_datatype_string(MODEL)))
    return rows.groupBy(*by).applyInArrow(train, schema)


def predict_boosted(frame: DataFrame, model: DataFrame, names: Sequence[str], out: str, by: Sequence[str] = ("station",),
                    most_rows: int = MOST_DAYS) -> DataFrame:
    """``frame`` with the raw output of each row's model in ``out``: log odds of a logistic one; NULL without a model."""
    widened = frame.withColumns({f"_x{i}": F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for i, n in enumerate(names)})
    inputs = [f"_x{i}" for i in range(len(names))]
    kept = model.where("kept").select(*by, "round", "base", "feature", "threshold", "leaf")

    def score(key: tuple, rows: pa.Table, trees: pa.Table) -> pa.Table:
        _bounded(rows, key, most_rows)
        plain = rows.drop_columns(inputs)
        if not trees.num_rows or not rows.num_rows:
            return plain.append_column(out, pa.nulls(rows.num_rows, pa.float64()))
        x = _columns(rows, inputs)
        total = np.full(len(x), trees["base"][0].as_py())
        parts = sorted(zip(*(trees[c].to_pylist() for c in ("round", "feature", "threshold", "leaf"))))
        for _, feature, threshold, leaf in parts:
            total += outputs(x, np.array(feature, np.int32), np.array(threshold), np.array(leaf))
        return plain.append_column(out, pa.array(total))

    schema = StructType(list(frame.schema) + [StructField(out, DoubleType())])
    return widened.groupBy(*by).cogroup(kept.groupBy(*by)).applyInArrow(score, schema)


# ---------------------------------------------------------------- hurdle models


@dataclass
class StationHurdles:
    """A wet-or-dry and an amount model for every station, as two tables."""

    occurrence: DataFrame
    amount: DataFrame
    names: Sequence[str]
    gate: float = 0.5
    log_cap: float = 7.0
    cap: float = 600.0

    def transform(self, frame: DataFrame) -> DataFrame:
        """``frame`` with ``p_wet`` and ``pred``; NULL for stations without a model."""
        called = predict_boosted(frame, self.occurrence, self.names, "_odds").withColumn("p_wet", 1 / (1 + F.exp(-F.col("_odds"))))
        sized = predict_boosted(called, self.amount, self.names, "_amount")
        dry = F.coalesce(F.col("_amount"), F.when(F.col("p_wet").isNotNull(), F.lit(0.0)))  # a station without wet days
        gated = fx.gate(F.expm1(fx.clip(dry, 0.0, self.log_cap)), F.col("p_wet"), self.gate)
        return sized.withColumn("pred", F.when(F.col("p_wet").isNotNull(), fx.clip(gated, 0.0, self.cap))).drop("_odds", "_amount")

    def rounds(self) -> DataFrame:
        """(stage, station, round, loss, kept): every round that was tried."""
        return self.occurrence.select(F.lit("occurrence").alias("stage"), "station", "round", "loss", "kept").unionByName(
            self.amount.select(F.lit("amount").alias("stage"), "station", "round", "loss", "kept"))


def fit_station_hurdles(frame: DataFrame, names: Sequence[str], value: str = "value", validation: str | None = None,
                        gate: float = 0.5, threshold: float = 0.0, settings: BoostSettings = BoostSettings(), seed: int = 42) -> StationHurdles:
    """Two stages per station: wet or dry, then ``log1p`` amount of the wet rows (whose leaves need 3 rows instead of 5)."""
    from rainloom.session import cut_lineage

    rows = cut_lineage(frame.where(F.col(value).isNotNull()).withColumns({
        "_wet": (F.col(value) > threshold).cast("double"), "_log": F.log1p(fx.floor_at(F.col(value), 0.0))}))
    wet = replace(settings, least_weight=settings.least_weight * 0.6)
    return StationHurdles(
        cut_lineage(fit_boosted(rows, names, "_wet", "logistic", validation=validation, settings=settings, seed=seed)),
        cut_lineage(fit_boosted(rows.where("_wet = 1"), names, "_log", validation=validation, settings=wet, seed=seed)), list(names), gate)


# ---------------------------------------------------------------- search


def successive_halving(frame: DataFrame, names: Sequence[str], label: str, trials: Mapping[int, BoostSettings], validation: str,
                       by: Sequence[str] = ("station",), first_rounds: int = 25, seed: int = 42) -> DataFrame:
    """(rung, trial, rounds, loss, promoted, chosen): all trials on the first rung, the better half on each next with twice the rounds.

    The loss is the root mean square over the validation rows of all groups.
    Each rung is one fit of all its trials and groups.  The chosen trial is the
    one of least loss on the last rung; ties go to the smaller number.
    """
    from rainloom.session import cut_lineage

    kept = [*by, *names, label, validation]
    rows = cut_lineage(frame.where(F.col(label).isNotNull()).select(*kept))
    sizes = rows.where(F.col(validation)).groupBy(*by).agg(F.count("*").alias("_n"))
    left, rung, rounds, results = sorted(trials), 0, first_rounds, []
    while True:
        own = {t: replace(trials[t], rounds=rounds, patience=rounds) for t in left}
        many = rows.withColumn("_trial", F.explode(F.array(*map(F.lit, left))))
        model = fit_boosted(many, names, label, by=["_trial", *by], validation=validation, trials=own, seed=seed)
        best = model.groupBy("_trial", *by).agg(F.min("loss").alias("_loss"))
        scores = best.join(sizes, list(by)).groupBy("_trial").agg(
            F.sqrt(F.sum(F.col("_loss") * F.col("_loss") * F.col("_n")) / F.sum("_n")).alias("loss"))
        ranked = sorted((r["loss"], r["_trial"]) for r in scores.collect())  # a row for each trial
        promoted = {t for _, t in ranked[:len(ranked) // 2]} if len(ranked) > 1 else set()
        last = len(ranked) <= 1
        results += [(rung, t, rounds, loss, t in promoted, last and t == ranked[0][1]) for loss, t in ranked]
        if last:
            break
        left, rung, rounds = sorted(promoted), rung + 1, rounds * 2
    return frame.sparkSession.createDataFrame(results, "rung int, trial int, rounds int, loss double, promoted boolean, chosen boolean")
