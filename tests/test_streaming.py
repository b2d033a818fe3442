"""Streaming roll-up equals the batch roll-up on closed days; sessions split at gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.operators import rollup
from rainloom.streaming import telemetry


def drain(df, name, folder):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True) \
        .option("checkpointLocation", folder).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_closed_days_equal_the_batch_rollup(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("event_type").alias("station"), F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = drain(telemetry.stream_daily(stream), "days", str(tmp_path / "c1")).toPandas()
    want = rollup.daily(events).toPandas()
    joined = got.merge(want, on=["station", "date"], suffixes=("", "_b"))
    assert len(joined) == len(got) >= 140
    for c in ("total", "peak", "std"):
        assert (joined[c] - joined[f"{c}_b"]).abs().max() < 1e-9


def test_sessions_split_at_gaps(spark, tmp_path):
    rows = [("a", f"2024-01-01 0{h}:00:00", 1.0) for h in (0, 1, 5, 6)] + [("a", "2024-01-03 00:00:00", 1.0)]
    spark.createDataFrame(rows, "station string, ts string, value double").withColumn(
        "ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("station string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    got = drain(telemetry.stream_sessions(stream), "sessions", str(tmp_path / "c2")).orderBy("first_reading").collect()
    assert [r.n_readings for r in got][:2] == [2, 2]
