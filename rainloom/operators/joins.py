"""Joins with key validation, covariate joins, frame alignment and pivots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from rainloom.session import cut_lineage


def join_stats(df: DataFrame, stats: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group statistics (one row per station, date, ...) to the rows they were computed from.

    The statistics are written once, so Catalyst knows their real size: below
    ``spark.sql.autoBroadcastJoinThreshold`` they are broadcast and the rows are
    not shuffled, which keeps a hot group spread; above it the join is a
    shuffled one under runtime skew handling.  NULL keys are a group like others.
    """
    known = cut_lineage(stats).withColumnsRenamed({k: f"_on_{k}" for k in on})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on])
    return df.join(known, same, how).drop(*[f"_on_{k}" for k in on])


#: A key that more than one in HOT_KEYS of the rows have is looked up by broadcast; there are fewer than HOT_KEYS of them.
HOT_KEYS = 256


def spread_join(rows: DataFrame, table: DataFrame, on: Sequence[str], size: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner equi-join of ``rows`` with a table of one row per key that knows, in ``size``, how many rows have the key.

    Keys of more than one in ``hot_keys`` of all rows are broadcast, a list of
    proven size; the rows of the others are shuffled, where no key has a larger
    share than that.  ``size`` is left out of the result.  NULL keys match
    nothing.
    """
    known = cut_lineage(table)
    total = known.agg(F.sum(size).alias("_all")).select("_all").scalar()
    heavy = F.col(size) * hot_keys > total
    hot, rest = F.broadcast(known.where(heavy).drop(size)), known.where(~heavy).drop(size)
    others = rows.join(hot.select(*on), list(on), "left_anti")
    return rows.join(hot, list(on)).unionByName(others.join(rest, list(on)))


class KeyViolation(ValueError):
    """A join was asked for a cardinality that does not exist."""


def _once(side: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """``side`` that fails when read if a key stands in it twice, naming the key.

    Rows are numbered within their key, which takes the partitioning and order
    that the join itself needs.
    """
    number = F.row_number().over(Window.partitionBy(*on).orderBy(*on))
    told = F.raise_error(F.concat(F.lit(f"{name} side repeats key "), F.to_json(F.struct(*on), {"ignoreNullFields": "false"})))
    return side.withColumn("_number", number).where(F.when(F.col("_number") > 1, told.cast("boolean")).otherwise(F.lit(True))).drop("_number")


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "1:1",
                   observed: Observation | None = None) -> DataFrame:
    """Equi-join that fails, naming the key, when a side that must be unique is not.

    ``validate`` is ``1:1``, ``m:1``, ``1:m`` or ``m:m``.  The check runs inside
    the join's own shuffle: each side is read once and no job runs before the
    result is asked for.  NULL keys join nothing and break no rule on a side
    whose unmatched rows are left out.  ``observed`` gets ``rows`` of the result and how many
    have a partner on the right (``matched``) when an action has run.
    """
    sides = validate.split(":")
    if len(sides) != 2 or not set(sides) <= {"1", "m"}:
        raise KeyViolation(f"validate can't be {validate}")
    left, right = (_once(side, on, name) if need == "1" else side
                   for side, need, name in ((left, sides[0], "left"), (right, sides[1], "right")))
    if observed is None:
        return left.join(right, list(on), how)
    joined = left.join(right.withColumn("_matched", F.lit(1)), list(on), how)
    return joined.observe(observed, F.count(F.lit(1)).alias("rows"), F.count("_matched").alias("matched")).drop("_matched")


def only_named(df: DataFrame, stations: Sequence[str], others: str = "fail") -> DataFrame:
    """Rows of the named stations; other stations raise when read, or are left out with ``others="drop"``."""
    inside = F.coalesce(F.col("station").isin(list(stations)), F.lit(False))
    if others == "drop":
        return df.where(inside)
    if others != "fail":
        raise ValueError(f"others can't be {others}")
    broken = F.raise_error(F.concat(F.lit("station without a column: "), F.coalesce("station", F.lit("NULL")))).cast("string")
    return df.withColumn("station", F.when(inside, F.col("station")).otherwise(broken))


def align_by_date(df: DataFrame, stations: Sequence[str], columns: Sequence[str], time: str = "date",
                  others: str = "fail") -> DataFrame:
    """Per-station frames side by side: ``{station}_{column}``, NULL where a station has no row."""
    def cell(s: str, c: str) -> Column:
        return F.max(F.when(F.col("station") == s, F.col(c))).alias(f"{s}_{c}")

    return only_named(df, stations, others).groupBy(time).agg(*[cell(s, c) for s in stations for c in columns])


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(columns), "station", "value")


def long_to_wide(df: DataFrame, stations: Sequence[str], time: str = "date", value: str = "value") -> DataFrame:
    return df.groupBy(time).pivot("station", list(stations)).agg(F.first(value))
