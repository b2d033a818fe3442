"""Writers: series tables, wide and horizon predictions, result files, models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.operators.joins import only_named


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headered CSV, written in parallel; NULL becomes a blank field."""
    df.write.mode(mode).option("header", True).csv(path)


def write_series(df: DataFrame, path: str, by: Sequence[str] = ("station",), mode: str = "overwrite",
                 max_rows_per_file: int = 5_000_000) -> None:
    """Parquet partitioned by station.

    Rows are spread by station and month before writing, so a hot station is
    written by many tasks.
    """
    time = "date" if "date" in df.columns else "ts"
    spread = df.repartition(*by, F.year(time), F.month(time))
    spread.write.mode(mode).option("maxRecordsPerFile", max_rows_per_file).partitionBy(*by).parquet(path)


def wide_predictions(df: DataFrame, stations: Sequence[str], scales: Sequence[str], time: str = "date",
                     others: str = "fail") -> DataFrame:
    """``(station, scale, date, actual, pred)`` to ``{station}_{scale}_{actual,predicted}`` columns."""
    def cell(s: str, scale: str, c: str) -> Column:
        return F.max(F.when((F.col("station") == s) & (F.col("scale") == scale), F.col(c)))

    return only_named(df, stations, others).groupBy(time).agg(*[
        cell(s, scale, c).alias(f"{s}_{scale}_{n}")
        for s in stations for scale in scales for c, n in (("actual", "actual"), ("pred", "predicted"))])


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per station: ``{"station": ..., metric: value, ...}``; NULL metrics are kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def results_map(df: DataFrame, key: str = "station") -> DataFrame:
    """One JSON text row ``{"<station>": {metric: value}}`` per station."""
    fields = F.struct(*[c for c in df.columns if c != key])
    return df.select(F.to_json(F.create_map(F.col(key), fields), {"ignoreNullFields": "false"}).alias("value"))


def horizon_predictions(df: DataFrame, stations: Sequence[str], time: str = "date", others: str = "fail") -> DataFrame:
    """``(station, date, horizon_day, actual, pred)`` to rows per forecast date and lead day."""
    def cell(s: str, c: str) -> Column:
        return F.max(F.when(F.col("station") == s, F.col(c)))

    rows = only_named(df, stations, others).groupBy(time, "horizon_day").agg(*[
        cell(s, c).alias(f"{s}_{n}") for s in stations for c, n in (("actual", "actual"), ("pred", "predicted"))])
    return rows.withColumn("forecast_date", F.date_add(F.col(time), F.col("horizon_day") - 1))


def save_model(model: PipelineModel, path: str, params: DataFrame | None = None,
               features: Sequence[str] = ()) -> None:
    """Fitted pipeline, its scaler parameters and its ordered feature list under one folder."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    listed = spark.createDataFrame([(list(features), params is not None)], "names array<string>, scaled boolean")
    listed.write.mode("overwrite").parquet(f"{path}/features")
    if params is not None:
        params.write.mode("overwrite").parquet(f"{path}/scaler")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame | None, list[str]]:
    """What :func:`save_model` stored: model, scaler parameters (None without), ordered feature names."""
    stored = spark.read.parquet(f"{path}/features").first()
    scaler = spark.read.parquet(f"{path}/scaler") if stored["scaled"] else None
    return PipelineModel.load(f"{path}/model"), scaler, list(stored["names"])
