"""Window work that does not put a whole station into one task.

A station may hold a third of all rows, so ``PARTITION BY station`` is too
coarse.  Three exact forms replace it:

* :func:`over_halo` for bounded frames: time chunks, each with a copy of the
  few neighbouring rows its frames reach into;
* :func:`carry` for unbounded "last / next known" frames: one summary row per
  chunk is scanned, then joined back to the chunk;
* :func:`ordered_prefix` for ranks and exact quantiles: counts per value
  bucket are accumulated first, rows are only sorted inside a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAY_SECONDS = 86400


@dataclass(frozen=True)
class Axis:
    """Keys and time step of a series, and how many steps go into one chunk."""

    keys: tuple[str, ...] = ("station",)
    time: str = "date"
    unit: str = "day"  # day | month | seconds
    step_seconds: int = DAY_SECONDS
    chunk_steps: int = 1024
    gapless: bool = False  # every step has one row, as after ``calendar.densify``

    def ordinal(self) -> Column:
        """Step number since 1970; independent of the session time zone."""
        t = F.col(self.time)
        days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date"))
        if self.unit == "day":
            return days.cast("long")
        if self.unit == "month":
            return (F.year(t) * 12 + F.month(t) - 1).cast("long")
        seconds = days.cast("long") * DAY_SECONDS + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
        return F.floor(seconds / F.lit(self.step_seconds))

    def with_chunk(self, steps: int) -> "Axis":
        return replace(self, chunk_steps=steps)


DAILY = Axis()
DENSE = Axis(gapless=True)
MONTHLY = Axis(time="month", unit="month")
BY_DATE = Axis(keys=())


def slots(minutes: int = 15, time: str = "ts") -> Axis:
    return Axis(time=time, unit="seconds", step_seconds=minutes * 60, chunk_steps=32 * 24 * 60 // minutes)


def over_halo(df: DataFrame, axis: Axis, columns: Callable[[WindowSpec], Mapping[str, Column]],
              before: int = 0, after: int = 0, by_time: bool = False) -> DataFrame:
    """Add window columns whose frames reach at most ``before``/``after`` rows.

    ``columns`` gets the window and returns name -> column.  Chunks hold equally
    many rows of a key; on a ``gapless`` axis, or with ``by_time`` (frames that
    reach so many steps, not rows), they are cut by time, which saves counting
    the rows.  Rows without a time come first, like in any window.
    """
    size = max(axis.chunk_steps, 8 * (before + after))
    if axis.gapless or by_time:
        placed, step = df, axis.ordinal()
    else:
        step = axis.ordinal()
        placed = ordered_prefix(df, axis.keys, [axis.time], F.coalesce(F.floor(step / F.lit(size)), F.lit(-(1 << 40))),
                                before="_row", total="_rows").drop("_rows")
        step = F.col("_row")
    width = F.lit(size)
    spread = (
        placed.withColumn("_home", F.floor(step / width))
        .withColumn("_chunk", F.explode_outer(F.sequence(F.floor((step - after) / width),
                                                         F.floor((step + before) / width))))
    )
    window = Window.partitionBy(*axis.keys, "_chunk").orderBy("_row" if "_row" in placed.columns else axis.time)
    return spread.withColumns(dict(columns(window))).where("_chunk <=> _home").drop("_chunk", "_home", "_row")


def carry(df: DataFrame, axis: Axis, last: Mapping[str, Column] | None = None,
          next: Mapping[str, Column] | None = None, strict: bool = False,
          first_step: str | None = None) -> DataFrame:
    """Add the last (next) non-NULL value of each expression up to (from) the row.

    ``strict`` leaves the row itself out.  Rows need not be gapless.
    ``first_step`` names an extra column with the ordinal of the key's first row.
    """
    last, next = dict(last or {}), dict(next or {})
    edge = 1 if strict else 0
    step = axis.ordinal()
    chunked = df.withColumn("_step", step).withColumn("_chunk", F.floor(F.col("_step") / F.lit(axis.chunk_steps)))
    by = [*axis.keys, "_chunk"]
    rows = Window.partitionBy(*by).orderBy(axis.time)
    upto = rows.rowsBetween(Window.unboundedPreceding, -edge)
    # Looking ahead is looking back in reverse order: frames that end at the last row cost a rescan per row.
    onward = Window.partitionBy(*by).orderBy(F.desc(axis.time)).rowsBetween(Window.unboundedPreceding, -edge)

    tails = chunked.groupBy(*by).agg(
        F.min("_step").alias("_first"),
        *[F.max_by(e, F.when(e.isNotNull(), F.col("_step"))).alias(f"_tail_{n}") for n, e in last.items()],
        *[F.min_by(e, F.when(e.isNotNull(), F.col("_step"))).alias(f"_head_{n}") for n, e in next.items()],
    )
    chunks = Window.partitionBy(*axis.keys)
    earlier = chunks.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = chunks.orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *by,
        *([F.min("_first").over(Window.partitionBy(*axis.keys)).alias(first_step)] if first_step else []),
        *[F.last(f"_tail_{n}", True).over(earlier).alias(f"_in_{n}") for n in last],
        *[F.last(f"_head_{n}", True).over(later).alias(f"_out_{n}") for n in next],
    )
    local = chunked.withColumns({
        **{f"_up_{n}": F.last(e, True).over(upto) for n, e in last.items()},
        **{f"_on_{n}": F.last(e, True).over(onward) for n, e in next.items()},
    })
    kept = list(df.columns) + ([first_step] if first_step else [])
    return local.join(carried, by, "left").select(
        *kept,
        *[F.coalesce(f"_up_{n}", f"_in_{n}").alias(n) for n in last],
        *[F.coalesce(f"_on_{n}", f"_out_{n}").alias(n) for n in next],
    )


def previous_row(df: DataFrame, axis: Axis, fields: Sequence[str], name: str = "prev") -> DataFrame:
    """Add struct ``name`` with ``fields`` of the row before, however far back it lies."""
    return carry(df, axis, last={name: F.struct(*fields)}, strict=True)


def ordered_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column,
                   weight: Column | None = None, before: str = "before", total: str = "total") -> DataFrame:
    """Add how much weight precedes the row inside its key, and the key's total weight.

    ``bucket`` must not decrease along ``order``; only rows of one bucket are
    sorted together.
    """
    weight = F.lit(1).cast("long") if weight is None else weight
    coded = df.withColumn("_bucket", bucket).withColumn("_weight", weight)
    by = [*keys, "_bucket"]
    sums = coded.groupBy(*by).agg(F.sum("_weight").alias("_sum"))
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias(f"_by_{k}") for k in by],
        F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_start"),
        F.sum("_sum").over(Window.partitionBy(*keys)).alias(total),
    )
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        coded.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .join(starts, _all_equal(by))
        .withColumn(before, (F.col("_start") + F.col("_inside")).cast("long"))
        .withColumn(total, F.col(total).cast("long"))
        .drop("_bucket", "_weight", "_inside", "_start", *[f"_by_{k}" for k in by])
    )


def _all_equal(keys: Sequence[str]) -> Column:
    """Keys equal their copies of the other side; NULL equals NULL."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys])
