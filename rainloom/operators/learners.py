"""Fitted models: learned imputer, multi-horizon forecasters, hurdle models, search and importance.

Training runs as Spark ML jobs over the pooled rows of all stations.  Stations
enter as train-set statistics, so the model does not grow with their number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainloom.functions import scalars as fx
from rainloom.operators import features as feat
from rainloom.operators import impute, scaling
from rainloom.operators.chunks import DAILY, Axis, over_halo
from rainloom.operators.gram import pair_correlations
from rainloom.operators.joins import join_stats
from rainloom.operators.windows import explode_horizon, horizon_targets, offset_columns
from rainloom.session import cut_lineage

# Ensemble seeds, lags and trailing windows of the tabular model.
SEEDS = (42, 123, 456, 789, 1024)
LAGS = (1, 2, 3, 5, 7, 14, 30)
WINDOWS = (7, 30)


@dataclass(frozen=True)
class TreeSettings:
    """Boosting settings; ``rounds`` are sequential Spark jobs, so raise them knowingly."""

    rounds: int = 20
    depth: int = 5
    step: float = 0.1
    subsample: float = 0.8
    bins: int = 32
    tolerance: float = 0.01


def observation_weight(confidence: float = 1.0, imputed: str = "imputed") -> Column:
    """Training weight: 1 for observed cells, ``confidence`` for imputed ones."""
    return F.when(F.col(imputed) == 1, F.lit(float(confidence))).otherwise(F.lit(1.0))


def extreme_weight(target: Column, alpha: float = 3.0) -> Column:
    """Training weight ``1 + alpha * y^2`` on a [0, 1] target."""
    return F.lit(1.0) + F.lit(float(alpha)) * target * target


def tabular_features(series: DataFrame, covariates: DataFrame | None = None, lags: Sequence[int] = LAGS,
                     windows: Sequence[int] = WINDOWS, period: float = 365.25,
                     axis: Axis = DAILY) -> tuple[DataFrame, list[str]]:
    """Causal feature frame: own lags and trailing means, basin lags, seasons, covariates; gaps are 0."""
    basin = series.groupBy("date").agg(F.avg("value").alias("_basin"))
    joined = join_stats(series, basin, ["date"])

    def columns(w):
        out = {f"lag{k}": F.coalesce(F.lag("value", k).over(w), F.lit(0.0)) for k in lags}
        for n in windows:
            rows = w.rowsBetween(-n, -1)
            out[f"roll{n}"] = F.coalesce(F.avg("value").over(rows), F.lit(0.0))
            out[f"wet{n}"] = F.count_if(F.col("value") > 0).over(rows).cast("double")
            out[f"basin{n}"] = F.coalesce(F.avg("_basin").over(rows), F.lit(0.0))
        out["basin_lag1"] = F.coalesce(F.lag("_basin", 1).over(w), F.lit(0.0))
        return out

    frame = over_halo(joined, axis, columns, before=max(*lags, *windows)).drop("_basin")
    frame = feat.add_seasonal(frame, period)
    names = [c for c in frame.columns if c not in series.columns]
    if covariates is not None:
        extra = [c for c in covariates.columns if c != "date"]
        frame = frame.join(covariates, "date", "left").na.fill(0.0, extra)
        names += extra
    return frame, names


def ranked_neighbours(series: DataFrame, known: Column, most: int = 4) -> DataFrame:
    """(station, other, rank): the ``most`` stations whose values on the ``known`` rows correlate best with a station's own.

    Correlations come from the blocked Gram matrix; ties and pairs without a
    correlation go by name.  Stations that share no date are no neighbours.
    """
    pairs = pair_correlations(series.where(known))
    both = pairs.select(F.col("a").alias("station"), F.col("b").alias("other"), "r").unionByName(
        pairs.select(F.col("b").alias("station"), F.col("a").alias("other"), "r"))
    nearest = Window.partitionBy("station").orderBy(F.desc_nulls_last("r"), "other")
    return both.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= most).drop("r")


def neighbour_features(frame: DataFrame, neighbours: DataFrame, columns: Sequence[str], most: int = 4) -> tuple[DataFrame, list[str]]:
    """``frame`` with the named columns of each neighbour on the same date as ``near{rank}_{column}``; 0 where there is none.

    ``columns`` must be causal themselves (lags, trailing means).
    """
    theirs = frame.select(F.col("station").alias("other"), "date", *columns).join(neighbours, "other")
    wide = theirs.groupBy("station", "date").agg(*(
        F.max(F.when(F.col("rank") == k, F.col(c))).alias(f"near{k}_{c}") for k in range(1, most + 1) for c in columns))
    names = [f"near{k}_{c}" for k in range(1, most + 1) for c in columns]
    return frame.join(wide, ["station", "date"], "left").na.fill(0.0, names), names


def station_encoding(frame: DataFrame, train: Column, value: str = "value") -> tuple[DataFrame, list[str]]:
    """Mean and wet share of each station over the training rows, as features."""
    x = F.when(train, F.col(value))
    encoded = frame.groupBy("station").agg(F.avg(x).alias("st_mean"),
                                           F.avg((x > 0).cast("double")).alias("st_wet"))
    return join_stats(frame, encoded.na.fill(0.0), ["station"]), ["st_mean", "st_wet"]


def regressor(names: Sequence[str], label: str, s: TreeSettings, seed: int, prediction: str = "prediction",
               weight: str | None = None, validation: str | None = None) -> Pipeline:
    model = GBTRegressor(featuresCol="_features", labelCol=label, predictionCol=prediction, maxIter=s.rounds,
                         maxDepth=s.depth, stepSize=s.step, subsamplingRate=s.subsample, maxBins=s.bins, seed=seed,
                         validationTol=s.tolerance)
    if weight:
        model.setWeightCol(weight)
    if validation:
        model.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="_features"), model])


# ---------------------------------------------------------------- hurdle


@dataclass
class HurdleModel:
    """Occurrence classifier and amount regressor; amount counts only on days called wet."""

    occurrence: PipelineModel
    amount: PipelineModel
    gate: float = 0.5
    log_cap: float = 7.0
    cap: float = 600.0

    def transform(self, frame: DataFrame) -> DataFrame:
        called = self.occurrence.transform(frame).withColumn("p_wet", vector_to_array("_probability")[1]) \
            .drop("_features", "_raw", "_probability", "_class")
        sized = self.amount.transform(called).drop("_features")
        amount = F.expm1(fx.clip(F.col("_amount"), 0.0, self.log_cap))
        return sized.withColumn("pred", fx.clip(fx.gate(amount, F.col("p_wet"), self.gate), 0.0, self.cap)) \
            .drop("_amount")

    def save(self, path: str) -> None:
        self.occurrence.write().overwrite().save(f"{path}/occurrence")
        self.amount.write().overwrite().save(f"{path}/amount")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.gate, self.log_cap, self.cap)], "gate double, log_cap double, cap double") \
            .write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, path: str, **settings) -> "HurdleModel":
        """What :meth:`save` stored, gate and caps included; ``settings`` replace stored ones."""
        stored = SparkSession.getActiveSession().read.parquet(f"{path}/settings").first().asDict()
        return cls(PipelineModel.load(f"{path}/occurrence"), PipelineModel.load(f"{path}/amount"), **{**stored, **settings})


def fit_hurdle(frame: DataFrame, names: Sequence[str], value: str = "value", validation: str | None = None,
               gate: float = 0.5, alpha: float | None = None, weight: Column | None = None, threshold: float = 0.0,
               settings: TreeSettings = TreeSettings(), seed: int = 42) -> HurdleModel:
    """Two stages on real rows: wet or dry, then ``log1p`` amount of the wet rows.

    ``validation`` names a boolean column of rows kept for early stopping.
    ``alpha`` weights heavy days (on the target scaled by its maximum).
    """
    amount = fx.floor_at(F.col(value), 0.0)
    base = F.lit(1.0) if weight is None else weight
    rows = frame.withColumns({"_wet": (F.col(value) > threshold).cast("double"), "_log": F.log1p(amount), "_w": base})
    if alpha is not None:
        top = rows.agg(F.max("_log").alias("m")).select("m").scalar()
        rows = rows.withColumn("_w", F.col("_w") * extreme_weight(F.col("_log") / top, alpha))
    rows = small_parts(cut_lineage(rows.select(*names, "_wet", "_log", "_w", *([validation] if validation else []))))
    classifier = GBTClassifier(
        featuresCol="_features", labelCol="_wet", predictionCol="_class", weightCol="_w", maxIter=settings.rounds,
        maxDepth=settings.depth, stepSize=settings.step, subsamplingRate=settings.subsample, maxBins=settings.bins,
        seed=seed, validationTol=settings.tolerance)
    classifier.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    if validation:
        classifier.setValidationIndicatorCol(validation)
    occurrence = Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="_features"), classifier])
    size = regressor(names, "_log", settings, seed, "_amount", "_w", validation)
    return HurdleModel(*fit_together((occurrence, rows), (size, rows.where("_wet = 1.0"))), gate)


def fit_together(*stages: tuple[Pipeline, DataFrame]) -> list[PipelineModel]:
    """Every pipeline fitted on its rows, all at once: the rounds of one model are small jobs in a row that leave most cores idle."""
    with ThreadPoolExecutor(len(stages)) as pool:
        begun = [pool.submit(inheritable_thread_target(rows.sparkSession)(lambda p=pipeline, r=rows: p.fit(r)))
                 for pipeline, rows in stages]
        return [fitted.result() for fitted in begun]


# ---------------------------------------------------------------- horizons


def fit_horizons(frame: DataFrame, names: Sequence[str], horizons: Sequence[int] = (1, 7, 30),
                 settings: TreeSettings = TreeSettings(), seed: int = 42, weight: Column | None = None,
                 validation: str | None = None, purge: bool = False) -> dict[int, PipelineModel]:
    """One regressor per horizon on ``log1p(target{h})``; rows with an incomplete target are left out.

    ``validation`` names a boolean column of rows kept for early stopping.  With
    ``purge`` the origins before them whose target reaches into their dates are
    left out as well.
    """
    rows = frame.withColumn("_w", F.lit(1.0) if weight is None else weight)
    kept = [*names, "date", "_w", *[f"target{h}" for h in horizons], *([validation] if validation else [])]
    rows = small_parts(cut_lineage(rows.select(*kept)))
    first = rows.where(F.col(validation)).agg(F.min("date").alias("d")).select("d").scalar() if validation and purge else None

    def fit(h: int) -> PipelineModel:
        usable = F.col(f"target{h}").isNotNull()
        if first is not None:
            usable &= F.col(validation) | (F.date_add("date", h - 1) < first)
        return regressor(names, "_y", settings, seed, weight="_w", validation=validation).fit(
            rows.where(usable).withColumn("_y", F.log1p(f"target{h}")))

    return {h: fit(h) for h in horizons}


#: Rows that one task of a boosting round handles at least: rounds run one after the other, so tiny tasks cost most.
ROWS_PER_TASK = 20_000


def small_parts(rows: DataFrame) -> DataFrame:
    """A written training table in as few parts as its size allows."""
    return rows.coalesce(max(1, min(rows.count() // ROWS_PER_TASK + 1, max(1, len(rows.inputFiles())))))


def predict_horizons(frame: DataFrame, models: Mapping[int, PipelineModel]) -> DataFrame:
    """Long table (station, date, horizon, actual, pred) for every model."""
    scored = frame
    for h, model in models.items():
        scored = model.transform(scored).withColumn(f"pred{h}", fx.from_log(F.col("prediction"))) \
            .drop("_features", "prediction")
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"target{h}").alias("actual"),
                              F.col(f"pred{h}").alias("pred")) for h in models])
    return scored.select("station", "date", F.inline(rows)).where("actual IS NOT NULL")


def lead_frame(frame: DataFrame, horizon: int = 14, observed: str | None = None) -> DataFrame:
    """One row per origin and lead day with the lead as a feature and its value as the target.

    ``observed`` names a 0/1 column (1: imputed); leads that fall on imputed
    days are left out.
    """
    if observed is not None:
        known = F.when(F.col(observed) == 0, F.col("value"))
        frame = frame.withColumn("value", known)
    return explode_horizon(horizon_targets(frame, horizon)).withColumn("lead", F.col("horizon_day").cast("double")) \
        .where("value IS NOT NULL")


def embargoed(rows: DataFrame, val_from: Column, test_from: Column, horizon: int = 14, time: str = "date") -> DataFrame:
    """Rows per origin with ``split`` set anew: origins whose ``horizon`` days reach past their part's end are left out."""
    last = F.date_add(time, horizon - 1)
    part = F.when(last < val_from, "train").when((F.col(time) >= val_from) & (last < test_from), "val").when(F.col(time) >= test_from, "test")
    return rows.withColumn("split", part).where("split is not null")


def fit_lead_model(rows: DataFrame, names: Sequence[str], settings: TreeSettings = TreeSettings(),
                   seed: int = 42, validation: str | None = None) -> PipelineModel:
    labelled = small_parts(cut_lineage(rows.select(
        *names, "lead", F.log1p("value").alias("_y"), *([validation] if validation else []))))
    return regressor([*names, "lead"], "_y", settings, seed, validation=validation).fit(labelled)


# ---------------------------------------------------------------- learned imputer


@dataclass
class LearnedImputer:
    """Ensemble that predicts a cell from its own past and future week and the other stations of the day."""

    half: int = 7
    seeds: Sequence[int] = SEEDS
    trees: int = 20
    depth: int = 7
    models: list[PipelineModel] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    params: DataFrame | None = None

    def cells(self, df: DataFrame, known: str) -> DataFrame:
        """Feature rows in log-min-max space, built only from the values in ``known``."""
        scaled = scaling.scale(df.withColumn("x", F.log1p(known)), self.params, ["x"], suffix="_own")
        near = offset_columns(scaled, self.half, "x_own", "x")
        day = scaled.groupBy("date").agg(F.sum("x_own").alias("_sum"), F.count("x_own").alias("_n"))
        own, n = F.coalesce("x_own", F.lit(0.0)), F.col("_n") - F.col("x_own").isNotNull().cast("long")
        others = join_stats(near, day, ["date"], "left").withColumns({
            "others_n": n.cast("double"),
            "others_mean": F.when(n > 0, (F.col("_sum") - own) / n).otherwise(0.0)})
        return feat.add_seasonal(others.drop("_sum", "_n"))

    def fit(self, df: DataFrame, known: str = "value") -> "LearnedImputer":
        """Train on cells where ``known`` is present; a cell's own value is never among its features."""
        logged = df.withColumn("x", F.log1p(known))
        self.params = scaling.fit_scaler(logged, ["x"])
        frame = self.cells(df, known)
        own = {*df.columns, "x", "x_own"}
        self.names = [c for c in frame.columns if c not in own]
        train = small_parts(cut_lineage(frame.where("x_own IS NOT NULL").select(*self.names, "x_own")))
        assembler = VectorAssembler(inputCols=self.names, outputCol="_features")
        self.models = [Pipeline(stages=[assembler, RandomForestRegressor(
            featuresCol="_features", labelCol="x_own", predictionCol=f"_p{seed}", numTrees=self.trees,
            maxDepth=self.depth, subsamplingRate=0.8, seed=seed)]).fit(train) for seed in self.seeds]
        return self

    def save(self, path: str) -> None:
        """Members, scaler and feature names under one folder."""
        for seed, model in zip(self.seeds, self.models):
            model.write().overwrite().save(f"{path}/member-{seed}")
        self.params.write.mode("overwrite").parquet(f"{path}/scaler")
        self.params.sparkSession.createDataFrame(
            [(self.half, list(self.seeds), self.trees, self.depth, self.names)],
            "half int, seeds array<int>, trees int, depth int, names array<string>").write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, path: str) -> "LearnedImputer":
        spark = SparkSession.getActiveSession()
        stored = spark.read.parquet(f"{path}/settings").first().asDict()
        return cls(**stored, models=[PipelineModel.load(f"{path}/member-{seed}") for seed in stored["seeds"]],
                   params=spark.read.parquet(f"{path}/scaler"))

    def predict(self, df: DataFrame, known: str = "value", where: Column | None = None) -> DataFrame:
        """Mean prediction of the ensemble as ``candidate`` in original units, and the first member as ``single``."""
        rows = self.cells(df, known)
        rows = rows if where is None else rows.where(where)
        for model in self.models:
            rows = model.transform(rows).drop("_features")
        low, high = self.params.select("x_a").scalar(), self.params.select("x_b").scalar()
        members = [F.col(f"_p{seed}") for seed in self.seeds]
        mean = sum(members[1:], members[0]) / len(members)
        return rows.select(*df.columns, impute.from_normalised(mean, low, high).alias("candidate"),
                           impute.from_normalised(members[0], low, high).alias("single"))


def learned_impute(df: DataFrame, imputer: LearnedImputer | None = None, digits: int = 1,
                   eligible: Column | None = None) -> DataFrame:
    """Fill missing cells with the fitted ensemble; observed cells are returned unchanged.

    Only missing cells are scored, then joined to the series.
    """
    fitted = imputer if imputer is not None and imputer.models else (imputer or LearnedImputer()).fit(df)
    missing = fitted.predict(df, where=F.col("value").isNull()).select("station", "date", "candidate")
    return impute.finalise(df.join(missing, ["station", "date"], "left"), digits=digits, eligible=eligible)


# ---------------------------------------------------------------- search and importance


def search(train: DataFrame, validation: DataFrame, names: Sequence[str], label: str,
           grid: Mapping[str, Sequence[float]], base: TreeSettings = TreeSettings(), seed: int = 42,
           parallel: int = 2) -> DataFrame:
    """Validation RMSE of every setting in the grid, trained on the earlier rows."""
    fit_rows = small_parts(cut_lineage(train.select(*names, label).withColumn("_val", F.lit(False)).unionByName(
        validation.select(*names, label).withColumn("_val", F.lit(True)))))
    check_rows = cut_lineage(validation.select(*names, label))
    settings = [dict(zip(grid, values)) for values in product(*grid.values())]

    def score(choice: dict) -> tuple:
        model = regressor(names, label, TreeSettings(**{**base.__dict__, **choice}), seed, validation="_val").fit(fit_rows)
        error = F.col("prediction") - F.col(label)
        loss = model.transform(check_rows).agg(F.sqrt(F.avg(error * error)).alias("rmse")).first()["rmse"]
        return (*[float(choice[k]) for k in grid], loss)

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(score, settings))
    schema = ", ".join([*[f"{k} double" for k in grid], "validation_rmse double"])
    return train.sparkSession.createDataFrame(rows, schema)


def tree_importance(model: PipelineModel, names: Sequence[str], frame: DataFrame) -> DataFrame:
    """Feature importances of a fitted tree pipeline as (feature, importance)."""
    values = model.stages[-1].featureImportances.toArray()
    return frame.sparkSession.createDataFrame(
        [(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")


def permutation_importance(model: PipelineModel, frame: DataFrame, names: Sequence[str], label: str,
                           keys: Sequence[str] = ("station", "date"), block_days: int = 30, seeds: Sequence[int] = (7, 8, 9)) -> DataFrame:
    """(feature, importance, spread, repeats): growth of RMSE when a feature takes the values of other rows of its block.

    A block is a station's ``block_days`` days, so season and level stay as they
    are.  In each repeat the rows of a block stand in an order drawn from a hash
    and each takes the value of the next one, the last that of the first; a row
    alone in its block keeps its own.  ``importance`` is the mean over the
    repeats, ``spread`` their standard deviation.  All features and repeats are
    scored in one scan.
    """
    station, time = keys
    rows = frame.select(*keys, *names, label)
    block = F.floor(F.datediff(time, F.lit("1970-01-01")) / F.lit(block_days))
    repeats = rows.withColumns({"_block": block, "_seed": F.explode(F.array(*map(F.lit, seeds)))})
    code = F.xxhash64(F.col("_seed"), F.col(time).cast("string"), F.col(station).cast("string"))
    order = Window.partitionBy(station, "_block", "_seed").orderBy(code, time)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct(*names)
    mixed = repeats.withColumn("_donor", F.coalesce(F.lead(own).over(order), F.first(own).over(whole)))
    variants = F.array(*[F.struct(F.lit(changed).alias("feature"), *[
        F.col(f"_donor.{c}" if c == changed else c).alias(c) for c in names]) for changed in ("", *names)])
    error = F.col("prediction") - F.col(label)
    scored = cut_lineage(model.transform(mixed.select("_seed", label, F.inline(variants))).groupBy("_seed", "feature").agg(
        F.sqrt(F.avg(error * error)).alias("rmse")))
    reference = scored.where("feature = ''").select("_seed", F.col("rmse").alias("plain"))
    grown = scored.where("feature <> ''").join(reference, "_seed").withColumn("grown", F.col("rmse") - F.col("plain"))
    return grown.groupBy("feature").agg(F.avg("grown").alias("importance"), F.coalesce(F.stddev_samp("grown"), F.lit(0.0)).alias("spread"),
                                        F.count("*").alias("repeats"))


def top_features(importance: DataFrame, k: int) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)
