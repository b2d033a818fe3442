"""Monotone value buckets, so that ranks and quantiles never sort a whole station in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.operators.joins import join_stats


def with_value_bucket(df: DataFrame, keys: Sequence[str], value: str, name: str = "_vb", pieces: int = 32,
                      resolution: int = 256) -> DataFrame:
    """Add a bucket number that never decreases with ``value`` inside a key.

    It is the sum of three codes that never decrease either: how many of
    ``pieces`` approximate quantiles lie below, so that no bucket holds much more
    than one part in ``pieces`` of a key's rows besides equal values; the place
    inside that piece; and a logarithm, which splits heavy tails.
    """
    x = F.col(value)
    cuts = df.groupBy(*keys).agg(
        F.percentile_approx(x, [k / pieces for k in range(1, pieces)], 1000).alias("_cuts"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    ranged = join_stats(df, cuts, keys) if keys else df.withColumns({
        c: cuts.select(c).scalar() for c in ("_cuts", "_lo", "_hi")})
    piece = F.size(F.filter("_cuts", lambda c: c < x)).cast("long")
    low = F.coalesce(F.get("_cuts", (piece - 1).cast("int")), F.col("_lo"))
    high = F.coalesce(F.get("_cuts", piece.cast("int")), F.col("_hi"))
    inside = F.when(high > low, F.least(F.floor((x - low) / (high - low) * F.lit(resolution)), F.lit(resolution - 1))).otherwise(F.lit(0))
    logarithmic = F.floor(F.signum(x) * F.log1p(F.abs(x)) * F.lit(resolution))
    return ranged.withColumn(name, (piece * resolution + inside + logarithmic).cast("long")).drop("_cuts", "_lo", "_hi")
