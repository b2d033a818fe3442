"""Plain table scans and column selection helpers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Headered CSV with a declared schema; blank fields are NULL.  No global sort."""
    return (spark.read.schema(schema).option("header", True).option("dateFormat", date_format)
            .option("enforceSchema", False).csv(path))


def canonical_date(df: DataFrame, name: str = "date") -> DataFrame:
    """Rename the date column to ``name`` whatever its case."""
    found = next((c for c in df.columns if c.lower() == name.lower()), None)
    if found is None:
        raise ValueError(f"no column named like {name!r} in {df.columns}")
    return df.withColumnRenamed(found, name)


def matching(columns: Iterable[str], prefix: str = "", suffix: str = "", contains: str = "") -> list[str]:
    """Column names by pattern, in table order."""
    return [c for c in columns if c.startswith(prefix) and c.endswith(suffix) and contains in c]


def map_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Select source columns under canonical names."""
    return df.select(*[F.col(source).alias(target) for source, target in names.items()])
