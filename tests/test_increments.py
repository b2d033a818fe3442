"""Increments over a stream equal the batch decoding and gap filling of the readings that came in time."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rainloom.operators import counters
from rainloom.operators.chunks import slots
from rainloom.streaming import increments

SCHEMA = "station string, ts timestamp, raw_daily double, raw_yearly double"
START = 1_717_200_000  # 2024-06-01 00:00 UTC
SLOT = 900


def readings():
    """Two stations of 15-minute counters over three days with gaps of all classes, a reset and a missing reading."""
    rng = random.Random(6)
    rows = []
    for station in ("a", "b"):
        day = year = 0.0
        gaps = {40: 3, 90: 20, 130: 120} if station == "a" else {25: 7, 70: 97}
        k = 0
        while k < 300:
            if (START + k * SLOT) % 86400 == 0:
                day = 0.0
            amount = round(rng.choice((0.0, 0.0, 0.2, 1.4)), 1)
            day, year = day + amount, year + amount
            if station == "b" and k == 60:
                year = 0.1  # the counter was set back
            rows.append((station, START + k * SLOT, day, None if station == "a" and k == 10 else year))
            k += 1 + gaps.get(k, 0)
    return rows


def batch(spark, rows):
    df = spark.createDataFrame(rows, "station string, s long, raw_daily double, raw_yearly double").select(
        "station", F.timestamp_seconds("s").alias("ts"), "raw_daily", "raw_yearly")
    decoded = counters.classify_gaps(counters.decode_counter(df, slots(15)))
    kinds = {(r.station, r.ts): r.gap_class for r in decoded.collect()}
    return {(r.station, r.ts): (r.increment, kinds.get((r.station, r.ts)), (r.station, r.ts) not in kinds)
            for r in counters.fill_gaps(decoded).collect()}


def run(spark, files, folder, delay="2 hours"):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "station string, s long, raw_daily double, raw_yearly double").select(
            "station", F.timestamp_seconds("s").alias("ts"), "raw_daily", "raw_yearly").coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    query = increments.stream_increments(stream, delay).writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination(180)
    assert query.exception() is None
    got = spark.read.schema(increments.RESULT).parquet(f"{folder}/out").collect()
    assert len({(r.station, r.ts) for r in got}) == len(got)
    return {(r.station, r.ts): (r.increment, r.gap_class, r.filled) for r in got}, increments.dropped_late(query)


def same(got, want):
    assert set(got) <= set(want)
    for key, (amount, kind, filled) in got.items():
        a, k, f = want[key]
        assert (k, f) == (kind, filled) and (a is None) == (amount is None) and (a is None or amount == pytest.approx(a, abs=1e-9)), key


def test_closed_slots_equal_the_batch_whatever_the_order(spark, tmp_path):
    rows = readings()
    rng = random.Random(1)
    mixed = sorted(rows, key=lambda r: r[1] + rng.random() * 3600)  # up to an hour late
    files = [mixed[i:i + 90] for i in range(0, len(mixed), 90)]
    got, late = run(spark, files, str(tmp_path))
    want = batch(spark, rows)
    same(got, want)
    last = max(r[1] for r in rows) - 7200
    assert late == 0
    assert set(got) == {k for k in want if k[1].timestamp() <= last and any(k[0] == r[0] and k[1].timestamp() <= r[1] <= last for r in rows)}
    assert {v[1] for v in got.values()} == {None, "none", "short", "medium", "long"}


def test_late_readings_are_dropped_and_counted(spark, tmp_path):
    rows = [r for r in readings() if r[0] == "b"]
    late = [rows[5], rows[6]]
    early = [r for r in rows if r not in late]
    files = [early[:100], early[100:], late, [("b", rows[-1][1] + 86400, 0.0, 99.0)]]
    got, dropped = run(spark, files, str(tmp_path))
    assert dropped == 2
    same({k: v for k, v in got.items() if k[1].timestamp() <= rows[-1][1]}, batch(spark, early))


def test_repeated_and_null_readings(spark, tmp_path):
    rows = [("a", START, 0.0, 1.0), ("a", START + SLOT, 0.5, 1.5), ("a", START + SLOT, 0.5, 1.5), (None, START, 1.0, 1.0),
            ("a", START + 2 * SLOT, None, None), ("a", START + 3 * SLOT, 1.0, 2.0), ("a", START + 86400, 0.0, 2.0)]
    got, _ = run(spark, [rows], str(tmp_path))
    amounts = [v[0] for _, v in sorted(got.items(), key=lambda x: x[0][1])][:4]
    assert amounts == [None, 0.5, None, None] and {k[0] for k in got} == {"a"}
