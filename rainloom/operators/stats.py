"""Descriptive statistics, exact quantiles, correlations and histograms."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.operators.chunks import DAILY, Axis, ordered_prefix, over_halo
from rainloom.operators.gram import column_correlations
from rainloom.operators.joins import join_stats, spread_join
from rainloom.operators.ranks import with_value_bucket
from rainloom.session import cut_lineage


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str]) -> DataFrame:
    """Linearly interpolated quantiles per key.

    Distinct values are counted first and positions are found in cumulative
    counts, so neither a hot key nor its distinct values sit in one buffer.
    """
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n")))
    coded = with_value_bucket(counts, keys, value)
    placed = ordered_prefix(coded, keys, [value], F.col("_vb"), F.col("_n"), "_before", "_total")

    def at(position: Column) -> Column:
        here = (F.col("_before") <= position) & (position < F.col("_before") + F.col("_n"))
        return F.max(F.when(here, F.col(value)))

    spots = {n: F.lit(float(p)) * (F.col("_total") - 1) for n, p in zip(names, probs)}
    found = placed.groupBy(*keys).agg(*[e for n, pos in spots.items() for e in (
        at(F.floor(pos)).alias(f"_lo_{n}"), at(F.ceil(pos)).alias(f"_hi_{n}"),
        F.max(pos - F.floor(pos)).alias(f"_f_{n}"))])
    return found.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in names])


def approximate_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                          names: Sequence[str], accuracy: int = 10000) -> DataFrame:
    found = df.groupBy(*keys).agg(F.percentile_approx(value, list(probs), accuracy).alias("_q"))
    return found.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def describe(df: DataFrame, keys: Sequence[str] = ("station",), value: str = "value", digits: int = 2) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum, rounded."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    quartiles = exact_quantiles(df, keys, value, (0.25, 0.5, 0.75), ("q25", "q50", "q75"))
    joined = base.join(quartiles, list(keys), "left")
    return joined.withColumns({c: F.bround(c, digits) for c in joined.columns if c not in (*keys, "n")})


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of named columns, long form with ``x < y``; pairs without common rows have NULL."""
    return column_correlations(df, columns).select(F.col("a").alias("x"), F.col("b").alias("y"), "r")


def lag_rank_correlation(df: DataFrame, lags: Sequence[int], value: str = "value", axis: Axis = DAILY) -> DataFrame:
    """Spearman correlation of each station's value with its own value ``k`` rows earlier.

    Equal (value, lagged value) pairs are merged before ranking; ranks are
    centred, which keeps the sums exact for long series.  A run of equal values
    has one rank row; the runs that many pairs belong to, such as dry days, are
    looked up by broadcast, so no key of a shuffled join is hot.
    """
    def columns(w):
        return {"_pairs": F.array(*[F.struct(F.lit(k).alias("lag"), F.lag(value, k).over(w).alias("y")) for k in lags])}

    pairs = over_halo(df, axis, columns, before=max(lags)).select(
        *axis.keys, F.col(value).alias("x"), F.inline("_pairs")).where("x IS NOT NULL AND y IS NOT NULL")
    merged = cut_lineage(pairs.groupBy(*axis.keys, "lag", "x", "y").agg(F.count("*").alias("_w")))
    by = [*axis.keys, "lag"]

    def ranks(side: str) -> DataFrame:
        counts = merged.groupBy(*by, side).agg(F.sum("_w").alias("_n"), F.count("*").alias("_rows"))
        coded = with_value_bucket(counts, by, side)
        placed = ordered_prefix(coded, by, [side], F.col("_vb"), F.col("_n"), "_before", "_total")
        middle = F.col("_before") + (F.col("_n") + 1) / 2 - (F.col("_total") + 1) / 2
        return placed.select(*by, side, "_rows", middle.alias(f"_r{side}"))

    ranked = spread_join(spread_join(merged, ranks("x"), [*by, "x"], "_rows"), ranks("y"), [*by, "y"], "_rows")
    w, rx, ry = F.col("_w"), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*by).agg(F.sum("_w").alias("n"), F.sum(w * rx * ry).alias("_xy"),
                                   F.sum(w * rx * rx).alias("_xx"), F.sum(w * ry * ry).alias("_yy"))
    return sums.select(*by, "n", F.when((F.col("_xx") > 0) & (F.col("_yy") > 0),
                                        F.col("_xy") / F.sqrt("_xx") / F.sqrt("_yy")).alias("rho"))


def histogram(df: DataFrame, by: Sequence[str], value: str = "value", bins: int = 50) -> DataFrame:
    """Density over equal-width bins between the group's own minimum and maximum."""
    x = F.col(value)
    known = df.where(x.isNotNull())
    ranges = known.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count("*").alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    # Distinct values are merged first: repeated amounts travel as one row.
    merged = known.groupBy(*by, x.alias("_x")).agg(F.count("*").alias("_c"))
    spot = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    placed = join_stats(merged, ranges, by).withColumn("bin", spot.cast("int"))
    return placed.groupBy(*by, "bin").agg(
        F.sum("_c").alias("n"), F.min(F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        F.min(F.when(width > 0, F.lit(1.0) / (F.col("_n") * width))).alias("_unit")
    ).select(*by, "bin", "bin_start", "n", (F.col("n") * F.col("_unit")).alias("density"))


def imputation_report(df: DataFrame, before: str = "observed", after: str = "value") -> DataFrame:
    """Mean, deviation, median and maximum before and after filling, and the mean shift in percent."""
    base = df.groupBy("station").agg(*[e for c, n in ((before, "before"), (after, "after")) for e in (
        F.avg(c).alias(f"mean_{n}"), F.stddev_samp(c).alias(f"std_{n}"), F.max(c).alias(f"max_{n}"))])
    medians = [exact_quantiles(df, ["station"], c, (0.5,), (f"median_{n}",))
               for c, n in ((before, "before"), (after, "after"))]
    joined = base.join(medians[0], "station", "left").join(medians[1], "station", "left")
    shift = (F.col("mean_after") - F.col("mean_before")) / F.col("mean_before") * 100
    return joined.withColumn("shift_pct", F.when(F.col("mean_before") != 0, shift))
