"""Aggregate expressions that stay defined on degenerate groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both are present; NULL when either side is constant.

    (The built-in ``corr`` divides by zero on a constant side in ANSI mode.)
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / sx / sy)
