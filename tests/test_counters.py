"""Counter decoding, gap classes and gap filling."""

from __future__ import annotations

import datetime as dt

import pytest

from rainloom.operators import counters
from rainloom.operators.chunks import slots

T0 = dt.datetime(2020, 12, 31, 22, 0)


def readings(spark, rows):
    return spark.createDataFrame(rows, "station string, ts timestamp_ntz, raw_daily double, raw_yearly double")


def at(quarter: int) -> dt.datetime:
    return T0 + dt.timedelta(minutes=15 * quarter)


def increments(df):
    return [r.increment for r in df.orderBy("ts").collect()]


@pytest.mark.parametrize("chunk", [1, 4, 3000])
def test_encode_decode_round_trip(spark, chunk):
    values = [float((i * 7) % 5) for i in range(8)]
    raw = spark.createDataFrame([("a", at(i - 200), v) for i, v in enumerate(values)],
                                "station string, ts timestamp_ntz, value double")
    axis = slots(15).with_chunk(chunk)
    decoded = counters.decode_counter(counters.encode_counter(raw), axis)
    assert increments(decoded) == [None, *values[1:]]


def test_midnight_reset_is_bridged_by_the_year_counter(spark):
    base = dt.datetime(2020, 5, 1, 23, 45)
    rows = [("a", base, 9.0, 100.0), ("a", base + dt.timedelta(minutes=15), 1.0, 101.0)]
    assert increments(counters.decode_counter(readings(spark, rows), slots())) == [None, 1.0]


def test_year_reset_and_its_option(spark):
    rows = [("a", at(7), 5.0, 800.0), ("a", at(8), 2.0, 2.0), ("a", at(9), 3.0, 3.0)]
    df = readings(spark, rows)
    assert increments(counters.decode_counter(df, slots())) == [None, 0.0, 1.0]
    assert increments(counters.decode_counter(df, slots(), "value")) == [None, 2.0, 1.0]


def test_glitch_on_both_counters_is_zero(spark):
    rows = [("a", at(0), 5.0, 50.0), ("a", at(1), 4.0, 40.0), ("a", at(2), 6.0, 42.0)]
    assert increments(counters.decode_counter(readings(spark, rows), slots())) == [None, 0.0, 2.0]
    rows = [("a", at(0), 5.0, 50.0), ("a", at(1), 7.0, 40.0)]
    assert increments(counters.decode_counter(readings(spark, rows), slots())) == [None, 2.0]


@pytest.mark.parametrize("missing,kind", [(0, "none"), (7, "short"), (8, "medium"), (95, "medium"), (96, "medium"), (100, "long")])
def test_gap_classes_at_their_edges(spark, missing, kind):
    rows = [("a", at(-300), 1.0, 1.0), ("a", at(-300 + missing + 1), 2.0, 2.0)]
    got = counters.classify_gaps(counters.decode_counter(readings(spark, rows), slots())).orderBy("ts").collect()
    assert (got[0].gap_class, got[1].gap_class, got[1].gap_minutes) == (None, kind, missing * 15)


def test_fill_gaps_policy(spark):
    def filled(missing, after=(5.0, 5.0)):
        rows = [("a", at(-300), 1.0, 1.0), ("a", at(-300 + missing + 1), *after), ("b", at(-301), 0.0, 0.0)]
        decoded = counters.classify_gaps(counters.decode_counter(readings(spark, rows), slots()))
        out = counters.fill_gaps(decoded).where("station = 'a'").orderBy("ts").collect()
        return [r.increment for r in out]

    assert filled(3) == [None, None, 0.0, 0.0, 0.0, 4.0]
    assert filled(10) == [None, None, *[0.0] * 10, 4.0]
    assert filled(10, (0.5, 0.5)) == [None, None, *[None] * 10, 0.0]
    assert filled(97) == [None, None, *[None] * 97, None]
