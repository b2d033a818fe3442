"""Increments of cumulative counters over a stream: the batch decoding and gap filling, slot by slot.

Each station keeps its last closed reading and the readings that the watermark
has not passed yet.  A timer on the earliest of them wakes the station when the
watermark gets there, so increments appear without new readings.  Readings may
come in any order within the delay; later ones are dropped by the engine, which
counts them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rainloom.operators.counters import LONG_ABOVE, SHORT_BELOW

RESULT = "station string, ts timestamp, increment double, gap_class string, filled boolean"
#: Last closed reading (microseconds since 1970, day and year counter) and the readings that wait.
STATE = ("seen boolean, at bigint, day double, year double, "
         "times array<bigint>, days array<double>, years array<double>")


def _known(x) -> float | None:
    return None if x is None or math.isnan(x) else float(x)


def increment(before: tuple, now: tuple) -> tuple[float | None, bool | None]:
    """Increment between two readings (time, day counter, year counter) and whether the year counter went on."""
    year = None if before[2] is None or now[2] is None else now[2] - before[2]
    day = None if before[1] is None or now[1] is None else now[1] - before[1]
    resumed = None if year is None else year >= 0
    if resumed:
        return year, resumed
    if day is not None and day >= 0:
        return day, resumed
    return (0.0 if year is not None else None), resumed


def decoded(before: tuple | None, now: tuple, slot: int) -> Iterator[tuple[int, float | None, str | None, bool]]:
    """(time, increment, gap class, filled) of the slots after ``before`` up to ``now``; times in microseconds."""
    if before is None:
        yield now[0], None, None, False
        return
    amount, resumed = increment(before, now)
    missing = now[0] // slot - before[0] // slot - 1
    minutes = missing * (slot // 60_000_000)
    kind = "none" if minutes <= 0 else "short" if minutes < SHORT_BELOW else "medium" if minutes <= LONG_ABOVE else "long"
    dry = kind == "short" or (kind == "medium" and resumed)
    for k in range(1, missing + 1):
        yield before[0] + k * slot, 0.0 if dry else None, None, True
    yield now[0], None if kind == "long" else amount, kind, False


def stream_increments(readings: DataFrame, delay: str = "2 hours", slot_minutes: int = 15) -> DataFrame:
    """``station, ts, raw_daily, raw_yearly`` to increments on the slot grid, for slots that the watermark has passed.

    The result equals ``fill_gaps(classify_gaps(decode_counter(...)))`` of the
    readings that came in time.  Of several readings of one slot start the one
    with the largest year counter counts.  Rows without station or time are left
    out.  A station's state holds the readings of about one delay.
    """
    slot = slot_minutes * 60_000_000

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (False, 0, None, None, [], [], [])
        last = (held[1], _known(held[2]), _known(held[3])) if held[0] else None
        waiting = {t: (t, _known(d), _known(y)) for t, d, y in zip(*held[4:])}
        for frame in frames:
            times = frame["ts"].astype("datetime64[us]").astype("int64")
            for t, d, y in zip(times.tolist(), frame["raw_daily"].tolist(), frame["raw_yearly"].tolist()):
                new, old = (t, _known(d), _known(y)), waiting.get(t)
                if old is None or (new[2] is not None and (old[2] is None or new[2] > old[2])):
                    waiting[t] = new
        passed = state.getCurrentWatermarkMs() * 1000
        rows = []
        for t in sorted(t for t in waiting if t <= passed):
            now = waiting.pop(t)
            if last is None or now[0] > last[0]:
                rows.extend(decoded(last, now, slot))
                last = now
        left = [waiting[t] for t in sorted(waiting)]
        state.update((last is not None, last[0] if last else 0, last[1] if last else None, last[2] if last else None,
                      [r[0] for r in left], [r[1] for r in left], [r[2] for r in left]))
        if left:
            state.setTimeoutTimestamp(max(left[0][0] // 1000, state.getCurrentWatermarkMs() + 1))
        if rows:
            at, amount, kind, filled = zip(*rows)
            yield pd.DataFrame({"station": key[0], "ts": pd.to_datetime(pd.Series(at, dtype="int64"), unit="us"),
                                "increment": pd.Series(amount, dtype="float64"), "gap_class": list(kind), "filled": list(filled)})

    known = readings.where("station is not null and ts is not null").select("station", "ts", "raw_daily", "raw_yearly")
    return known.withWatermark("ts", delay).groupBy("station").applyInPandasWithState(
        work, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def dropped_late(query: StreamingQuery) -> int:
    """Readings that came after the watermark had passed them, over all batches whose progress the query still holds."""
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])
