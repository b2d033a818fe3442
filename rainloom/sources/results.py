"""Result files: JSON objects keyed by station, with optional fields."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of the result files and their types.
RESULT_FIELDS = {
    "r2_daily": "double", "r2_weekly": "double", "r2_monthly": "double", "r_monthly": "double", "wet_dry_acc": "double",
    "n_real_test": "long", "n_test": "long", "note": "string", "status": "string", "rmse_mm": "double", "bias_mm": "double",
    "corr": "double", "n_test_months": "long", "best_model": "string",
    "r2_daily_model": "string", "r2_weekly_model": "string", "r2_monthly_model": "string",
    "r2_daily_xgb": "double", "r2_daily_lgb": "double", "r2_ridge": "double", "r2_xgb_log": "double", "r2_xgb_lin": "double",
    "r2_era5_only": "double", "r2_blend": "double",
}


def read_results(spark: SparkSession, path: str, fields: Mapping[str, str] = RESULT_FIELDS,
                 defaults: Mapping[str, object] | None = None, strict: bool = True) -> DataFrame:
    """One row per file and station; absent fields are NULL or the given default.

    A file that holds no such object raises when it is read; without ``strict``
    it is one row whose station is NULL.

    A result file is one small object, so each file is one record; many files
    are read in parallel.
    """
    schema = "map<string,struct<" + ",".join(f"{n}:{t}" for n, t in fields.items()) + ">>"
    text = spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"),
        F.from_json("value", schema).alias("entries"))
    if strict:
        broken = F.raise_error(F.concat(F.lit("no result object in "), F.col("file"))).cast(schema)
        text = text.withColumn("entries", F.when(F.col("entries").isNotNull(), F.col("entries")).otherwise(broken))
    rows = text.select("file", F.explode_outer("entries").alias("station", "r")).select("file", "station", "r.*")
    return rows.na.fill(dict(defaults)) if defaults else rows
