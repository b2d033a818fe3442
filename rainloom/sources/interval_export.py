"""Interval exports: CSV with metadata lines, duplicate value column names and two timestamp columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rainloom.operators.quality import nan_to_null

# Fixed value: how a data line begins.
DATA_LINE = r"^\d{4}-\d{2}-\d{2}"


def _lines(spark: SparkSession, path: str, stations: Sequence[str]) -> DataFrame:
    """All lines as text fields, with the reason why a line is no clean data line (NULL: it is one)."""
    schema = StructType([StructField(c, StringType()) for c in ("_start", "_end", *stations, "_line")])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(path)
    start, end = F.col("_start").try_cast("timestamp_ntz"), F.col("_end").try_cast("timestamp_ntz")
    bad = [F.when(_stated(s) & F.col(s).try_cast("double").isNull(), F.lit(s)) for s in stations]
    wrong = F.array_compact(F.array(*bad)) if stations else F.array().cast("array<string>")
    reason = F.when(~F.coalesce(F.col("_start").rlike(DATA_LINE), F.lit(False)), "no data line") \
        .when(start.isNull() | end.isNull(), "no timestamps") \
        .when(F.size(wrong) > 0, F.concat(F.lit("no number: "), F.array_join(wrong, ", ")))
    return raw.withColumns({"ts_start": start, "ts_end": end, "_reason": reason})


def _stated(column: str):
    return F.col(column).isNotNull() & (F.trim(column) != "") & ~F.lower(F.trim(column)).isin("nan", "na", "null")


def read_interval_export(spark: SparkSession, path: str, stations: Sequence[str], strict: bool = False) -> DataFrame:
    """Wide table ``ts_start, ts_end, <stations>``; names go by position.

    Metadata and name lines are recognised by their first field, so files stay
    splittable and several files with own headers can be read at once.
    Timestamps are local times without zone.  A line that begins like data but
    lacks a timestamp is left out, a cell that is no number is NULL;
    :func:`rejected_lines` lists both, and ``strict`` raises on them.
    """
    lines = _lines(spark, path, stations)
    data = lines.where(F.col("ts_start").isNotNull() & F.col("ts_end").isNotNull() & F.col("_start").rlike(DATA_LINE))
    if strict:
        broken = F.raise_error(F.concat(F.lit("bad line: "), F.col("_reason"), F.lit(" at "), F.col("_start")))
        data = lines.where(F.coalesce(F.col("_reason") != "no data line", F.lit(True))) \
            .withColumn("ts_start", F.when(F.col("_reason").isNull(), F.col("ts_start")).otherwise(broken.cast("timestamp_ntz")))
    named = data.select("ts_start", "ts_end", *[F.col(s).try_cast("double").alias(s) for s in stations])
    return nan_to_null(named, stations)


def rejected_lines(spark: SparkSession, path: str, stations: Sequence[str]) -> DataFrame:
    """Lines that were not read in full: ``first_field``, ``second_field``, ``reason``; header and metadata lines included."""
    return _lines(spark, path, stations).where("_reason IS NOT NULL").select(
        F.col("_start").alias("first_field"), F.col("_end").alias("second_field"), F.col("_reason").alias("reason"))


def read_interval_series(spark: SparkSession, path: str, stations: Sequence[str], daily: bool = False) -> DataFrame:
    """Long series: ``station, ts, ts_end, value`` or, for daily exports, ``station, date, value``."""
    wide = read_interval_export(spark, path, stations)
    long = wide.unpivot(["ts_start", "ts_end"], list(stations), "station", "value")
    if daily:
        return long.select("station", F.to_date("ts_start").alias("date"), "value")
    return long.select("station", F.col("ts_start").alias("ts"), "ts_end", "value")


def rename_by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Give all columns new names by position, which also resolves duplicate names."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns but {len(names)} names")
    return df.toDF(*names)
