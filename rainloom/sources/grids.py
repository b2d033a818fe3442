"""Decoded grid tables and counter tables: declared schemas over Parquet or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GRID_SCHEMA = ("ts timestamp_ntz, lat double, lon double, t2m double, d2m double, sp double, u10 double, v10 double, "
               "tcwv double, tp double")
COUNTER_SCHEMA = "station string, ts timestamp_ntz, raw_daily double, raw_yearly double"
STATION_SCHEMA = "station string, lat double, lon double"


def _read(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def read_grid(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Six-hourly readings, one row per time and cell."""
    return _read(spark, path, GRID_SCHEMA, fmt)


def read_counters(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Cumulative telemetry: running totals since midnight and since 1 January."""
    return _read(spark, path, COUNTER_SCHEMA, fmt)


def read_stations(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, STATION_SCHEMA, fmt)
