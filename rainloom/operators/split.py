"""Seeded holdout cells and chronological splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.operators.chunks import ordered_prefix
from rainloom.session import cut_lineage


def holdout_cells(df: DataFrame, fraction: float = 0.2, seed: int = 42, value: str = "value",
                  keys: Sequence[str] = ("station",), time: str = "date") -> DataFrame:
    """Mark exactly ``int(n * fraction)`` observed cells per station as held out.

    Cells are ordered by a hash of key, time and seed.  The hash prefix is the
    rank bucket, so no task sorts a whole station.
    """
    code = F.md5(F.concat_ws("|", *keys, F.col(time).cast("string"), F.lit(str(seed))))
    observed = F.col(value).isNotNull().cast("long")
    ranked = ordered_prefix(df.withColumn("_code", code), keys, ["_code"], F.substring("_code", 1, 3), observed,
                            before="_rank", total="_n")
    picked = F.col(value).isNotNull() & (F.col("_rank") < F.floor(F.col("_n") * F.lit(float(fraction))))
    return ranked.withColumn("holdout", picked.cast("int")).drop("_code", "_rank", "_n")


def ranked_dates(df: DataFrame, time: str = "date") -> DataFrame:
    """Distinct times with ordinal and count; counted per thousand days or hours, so no task sorts them all."""
    times = df.select(time).distinct()
    days = F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date"))
    bucket = F.floor(days / 1000) if dict(df.dtypes)[time] == "date" else days * 24 + F.hour(time)
    return ordered_prefix(times, [], [time], bucket.cast("long"), before="ordinal", total="n_dates").select(
        time, F.col("ordinal").cast("int").alias("ordinal"), "n_dates")


def _edges(fractions: tuple[float, float], second: str) -> tuple[Column, Column]:
    n = F.col("n_dates")
    train = F.floor(n * F.lit(float(fractions[0])))
    if second == "cumulative":
        return train, F.floor(n * F.lit(float(fractions[0] + fractions[1])))
    return train, train + F.floor(n * F.lit(float(fractions[1])))


def cut_dates(df: DataFrame, fractions: tuple[float, float] = (0.70, 0.15), time: str = "date",
              second: str = "separate") -> DataFrame:
    """One row: first validation date and first test date.

    ``second='separate'`` takes ``int(n*f2)`` dates for validation,
    ``'cumulative'`` cuts at ``int(n*(f1+f2))``.
    """
    train, val = _edges(fractions, second)
    never = F.lit("9999-12-31").cast("date")
    return cut_lineage(ranked_dates(df, time).agg(
        F.coalesce(F.max(F.when(F.col("ordinal") == train, F.col(time))), never).alias("val_from"),
        F.coalesce(F.max(F.when(F.col("ordinal") == val, F.col(time))), never).alias("test_from")))


def chronological_split(df: DataFrame, fractions: tuple[float, float] = (0.70, 0.15), time: str = "date",
                        second: str = "separate") -> DataFrame:
    """Label rows train / val / test by the ordinal of their date.

    The two cut dates come from a one-row table, so the rows themselves are
    neither joined nor shuffled.
    """
    cuts = cut_dates(df, fractions, time, second)
    return date_split(df, cuts.select("val_from").scalar(), cuts.select("test_from").scalar(), time)


def date_split(df: DataFrame, val_from: Column, test_from: Column, time: str = "date") -> DataFrame:
    """Label rows by two cut dates (literals or scalar sub-queries)."""
    t = F.col(time)
    return df.withColumn("split", F.when(t < val_from, "train").when(t < test_from, "val").otherwise("test"))


def evenly_spaced(df: DataFrame, k: int, time: str = "date") -> DataFrame:
    """The ``k`` dates at evenly spaced ordinals, first and last included."""
    if k < 2:
        raise ValueError("k must be at least 2")
    dates = ranked_dates(df, time)
    step = (F.col("n_dates") - 1) / F.lit(float(k - 1))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * step).cast("int"))
    return dates.where(F.array_contains(wanted, F.col("ordinal"))).select(time, "ordinal")


def holdout_coverage(df: DataFrame, value: str = "value") -> DataFrame:
    """Observed, held-out and training cells per station."""
    seen = F.col(value).isNotNull()
    return df.groupBy("station").agg(
        F.count_if(seen).alias("n_observed"), F.count_if(seen & (F.col("holdout") == 1)).alias("n_holdout"),
        F.count_if(seen & (F.col("holdout") == 0)).alias("n_train"))
