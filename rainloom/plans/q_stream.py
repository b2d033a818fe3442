"""Streaming queries: the same tables as a stream of files, run until everything that is there has been read."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.plans import views
from rainloom.plans.q_prepare import GAPS
from rainloom.plans.registry import r6, register
from rainloom.plans.views import sql
from rainloom.session import scratch_path
from rainloom.streaming import increments

#: How much later than the latest reading one may come.
DELAY_DAYS = 1


@register("x02_stream_increments", sql(["counter", "telemetry_dense"], GAPS + f""",
e AS (SELECT station, min(ts) AS first, max(ts) FILTER (ts <= (SELECT max(ts) FROM telemetry) - INTERVAL {DELAY_DAYS} DAY) AS last
      FROM telemetry GROUP BY station),
s AS (SELECT t.station, t.ts, g.ts AS seen, g.increment, g.gap_class, g.resumed FROM telemetry_dense t
      LEFT JOIN g ON g.station = t.station AND g.ts = t.ts),
n AS (SELECT *, first_value(gap_class IGNORE NULLS) OVER w AS next_class, first_value(resumed IGNORE NULLS) OVER w AS next_ok
      FROM s WINDOW w AS (PARTITION BY station ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT n.station, ts, seen IS NULL AS filled, round(CASE WHEN seen IS NOT NULL THEN CASE WHEN gap_class = 'long' THEN NULL ELSE increment END
       WHEN next_class = 'short' THEN 0.0 WHEN next_class = 'medium' AND next_ok THEN 0.0 END, 4) AS increment
FROM n JOIN e ON e.station = n.station AND n.ts BETWEEN e.first AND e.last"""))
def x02(spark, sf):
    """Counter readings as one micro-batch of a stream: slots that the watermark has passed when all files are read."""
    folder = scratch_path(spark)
    readings = r6(views.counter(spark, sf), "raw_daily", "raw_yearly", digits=4)
    kind = dict(readings.dtypes)["ts"]
    readings.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("station string, ts timestamp, raw_daily double, raw_yearly double").parquet(f"{folder}/in")
    query = increments.stream_increments(stream, f"{DELAY_DAYS} days").writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    found = spark.read.schema(increments.RESULT).parquet(f"{folder}/out")
    return found.select("station", F.col("ts").cast(kind).alias("ts"), "filled", F.round("increment", 4).alias("increment"))
