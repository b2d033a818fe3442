"""Spans of text as other programs write them: kind:start:end, comma-joined, and their digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordinal(kind: Column, kinds: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, kinds)), kind)


def joined(spans: Column, kinds: tuple[str, ...], by_kind: bool) -> Column:
    """``kind:start:end`` of an array of (kind, s, e): by start and kind as listed, or by kind as listed and start."""
    keyed = F.transform(spans, lambda x: F.struct(
        *((ordinal(x.kind, kinds).alias("a"), x.s.alias("b")) if by_kind else (x.s.alias("a"), ordinal(x.kind, kinds).alias("b"))),
        x.e.alias("e"), F.concat_ws(":", x.kind, x.s, x.e).alias("text")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x.text), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x.kind == kind)).cast("long")
