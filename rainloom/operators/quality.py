"""Missing-value flags, limits, eligibility and profile reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.operators.gram import pair_moments
from rainloom.operators.joins import join_stats, only_named
from rainloom.session import cut_lineage

OVERALL = "OVERALL"


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def with_missing_flag(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn("missing", F.col(value).isNull().cast("int"))


def missing_by_date(df: DataFrame) -> DataFrame:
    """Whether any / all stations miss their value on a date."""
    flag = F.col("value").isNull().cast("int")
    return df.groupBy("date").agg(F.max(flag).alias("any_missing"), F.min(flag).alias("all_missing"),
                                  F.sum(flag).alias("n_missing"))


def with_overall(df: DataFrame, aggs: Sequence[Column], by: Sequence[str] = (),
                 station: str = "station") -> DataFrame:
    """Aggregate per station and once more pooled over all stations, in one pass."""
    sets = [[*by, station], [*by]]
    label = F.when(F.grouping(station) == 1, F.lit(OVERALL)).otherwise(F.col(station))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *by, station).agg(
        label.alias("_label"), *aggs)
    return grouped.drop(station).withColumnRenamed("_label", station)


def missing_summary(df: DataFrame, value: str = "value") -> DataFrame:
    """Missing count and percentage per station plus an overall row."""
    gone = F.col(value).isNull()
    return with_overall(df, [
        F.count("*").alias("n_rows"), F.count_if(gone).alias("n_missing"),
        (F.lit(100.0) * F.count_if(gone) / F.count("*")).alias("pct_missing")])


def apply_limits(df: DataFrame, lower: float = 0.0, upper: float = 600.0, soft: float = 500.0,
                 policy: str = "null") -> DataFrame:
    """Negative readings become ``lower``; readings above ``upper`` are nulled, flagged or kept."""
    x = F.col("value")
    over = x > F.lit(float(upper))
    floored = F.when(x < lower, F.lit(float(lower))).otherwise(x)
    limited = F.when(over, F.lit(None)).otherwise(floored) if policy == "null" else floored
    flags = {"above_soft": F.coalesce(x > F.lit(float(soft)), F.lit(False)).cast("int"),
             "below_lower": F.coalesce(x < F.lit(float(lower)), F.lit(False)).cast("int")}
    if policy in ("null", "flag"):
        flags["above_upper"] = F.coalesce(over, F.lit(False)).cast("int")
    return df.withColumns({**flags, "value": limited if policy != "keep" else x})


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def real_observations(df: DataFrame) -> DataFrame:
    return df.where(F.col("value").isNotNull() & (F.col("imputed") == 0))


def with_eligibility(df: DataFrame, max_missing: int = 4) -> DataFrame:
    """Mark cells that may be imputed: missing, on a date with fewer than ``max_missing`` gaps."""
    gaps = df.groupBy("date").agg(F.count_if(F.col("value").isNull()).alias("n_missing"))
    return join_stats(df, gaps, ["date"]).withColumn(
        "eligible", (F.col("value").isNull() & (F.col("n_missing") < max_missing)).cast("int"))


def wet_values(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    return df.where(F.col("value") > threshold)


def support_status(df: DataFrame, min_rows: int = 20) -> DataFrame:
    """Real rows per station and whether the station can be scored."""
    n = F.count_if(F.col("value").isNotNull() & (F.col("imputed") == 0))
    counted = df.groupBy("station").agg(n.alias("n_real"))
    return counted.withColumn(
        "status", F.when(F.col("n_real") < min_rows, F.lit("sensor_offline")).otherwise(F.lit("scored")))


def station_pairs(df: DataFrame, stations: Sequence[str]) -> DataFrame:
    """(station_a, station_b) of every two named stations, in the order they are named."""
    named = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(stations)], "i int, station_a string")
    everyone = named.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "station_a"))), lambda x: x.station_a).alias("all"))
    later = F.slice(everyone.select("all").scalar(), F.col("i") + 2, F.lit(len(stations)))
    return named.select("station_a", F.explode(later).alias("station_b"))


def cooccurrence(df: DataFrame, stations: Sequence[str], others: str = "fail", **sizes) -> DataFrame:
    """For each pair of named stations: dates both, only the first, only the second miss; and all miss.

    A station without a row for a date misses it.  Missing follows from being
    present: dates that two stations share come from the blocked Gram matrix of
    :mod:`gram`, the rest from each station's number of dates.
    """
    rows = only_named(df, stations, others)
    known = cut_lineage(rows.where(F.col("value").isNotNull()).select("station", "date").distinct())
    shared = pair_moments(known.withColumn("x", F.lit(1.0)), value="x", n_series=len(stations), **sizes).select("a", "b", "n")
    own = cut_lineage(known.groupBy("station").agg(F.count("*").alias("n")))
    days = rows.agg(F.count_distinct("date").alias("d")).select("d").scalar()
    seen = known.agg(F.count_distinct("date").alias("d")).select("d").scalar()
    pairs = station_pairs(df, stations).withColumns({"a": F.least("station_a", "station_b"), "b": F.greatest("station_a", "station_b")})
    joined = pairs.join(shared, ["a", "b"], "left")
    for side in ("a", "b"):
        joined = joined.join(own.select(F.col("station").alias(f"station_{side}"), F.col("n").alias(f"n_{side}")), f"station_{side}", "left")
    both, a, b = (F.coalesce(c, F.lit(0)).cast("long") for c in ("n", "n_a", "n_b"))
    return joined.select("station_a", "station_b", (days - a - b + both).alias("both_missing"), (b - both).alias("only_a_missing"),
                         (a - both).alias("only_b_missing"), (days - seen).alias("all_missing"))


def missing_patterns(df: DataFrame, stations: Sequence[str], others: str = "fail") -> DataFrame:
    """How many dates share the same set of missing stations, among the named ones."""
    gone = {s: F.max(F.when(F.col("station") == s, F.col("value").isNull())) for s in sorted(stations)}
    pattern = F.concat_ws("+", *[F.when(F.coalesce(g, F.lit(True)), F.lit(s)) for s, g in gone.items()])
    per_date = only_named(df, stations, others).groupBy("date").agg(pattern.alias("pattern"))
    return per_date.groupBy("pattern").agg(F.count("*").alias("n_dates"))


def integrity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and NULL count of each column in one pass, as (column, n_null, n_rows)."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null"), F.col("_n").alias("n_rows"))
        for c in columns])))


def dtype_counts(df: DataFrame) -> Mapping[str, int]:
    """How many columns have each type (schema only, no job)."""
    out: dict[str, int] = {}
    for _, kind in df.dtypes:
        out[kind] = out.get(kind, 0) + 1
    return out


def station_profile(df: DataFrame, extreme: float = 100.0) -> DataFrame:
    """Mean, maximum, zero share, wet mean, missing days and share of extreme days."""
    x = F.col("value")
    return df.groupBy("station").agg(
        F.avg(x).alias("mean_value"), F.max(x).alias("max_value"),
        F.try_divide(F.lit(100.0) * F.count_if(x == 0), F.count(x)).alias("zero_pct"),
        F.avg(F.when(x > 0, x)).alias("wet_mean"),
        F.count_if(x.isNull()).alias("n_missing"),
        F.try_divide(F.lit(100.0) * F.count_if(x > extreme), F.count(x)).alias("extreme_pct"))
