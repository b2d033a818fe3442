"""Station tables derived from the driver tables, once as DataFrames and once as SQL.

Every view reads whole tables.  Views on a full calendar are used several times
by one query (spine, values, chunk summaries), so the roll-up below them is
written once to the checkpoint folder and the raw table is scanned only once.
``sql(name, ...)`` puts the needed view definitions in front of an oracle
statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.operators import calendar, counters, features, joins, rollup, split, windows
from rainloom.operators.chunks import DENSE as GAPLESS
from rainloom.session import cut_lineage

SHIP_STATIONS = ["A", "N", "R"]
REGION_STATIONS = ["0", "1", "2", "3", "4"]
EVENT_STATIONS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ship(spark: SparkSession, sf: str) -> DataFrame:
    """3 stations: shipped quantity per return flag and day."""
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("station"), F.to_date("l_shipdate").alias("date")
    ).agg(F.sum("l_quantity").alias("value"))


def ship_dense(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.densify(cut_lineage(ship(spark, sf)))


def masked(df: DataFrame) -> DataFrame:
    """Blank about a fifth of the cells, chosen by the hash of station and date."""
    pick = F.md5(F.concat_ws("|", "station", F.col("date").cast("string")))
    return df.withColumn("value", F.when(pick >= "33333333", F.col("value")))


def ship_masked(spark: SparkSession, sf: str) -> DataFrame:
    return masked(ship_dense(spark, sf))


def region(spark: SparkSession, sf: str) -> DataFrame:
    """5 stations: order value per region and day, in units of 100,000 with 4 decimals."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_regionkey").cast("string").alias("station"), F.to_date("o_orderdate").alias("date"))
        .agg((F.floor(F.round(F.sum("o_totalprice"), 2) / 10) / 1e4).alias("value"))
    )


def region_dense(spark: SparkSession, sf: str) -> DataFrame:
    """NULL on days without orders."""
    return calendar.densify(cut_lineage(region(spark, sf)))


def region_rain(spark: SparkSession, sf: str) -> DataFrame:
    """Rain-like series: 0 on days without orders, a hashed fifth of the cells NULL."""
    return masked(region_dense(spark, sf).withColumn("value", F.coalesce("value", F.lit(0.0))))


def region_filled(spark: SparkSession, sf: str) -> DataFrame:
    """``region_rain`` completed with the mean of the other stations of the day, with flags."""
    rain = region_rain(spark, sf)
    day = rollup.cross_station_mean(rain).select("date", "station_mean")
    return joins.join_stats(rain, day, ["date"]).select(
        "station", "date", F.coalesce("value", F.bround(F.coalesce("station_mean", F.lit(0.0)), 6)).alias("value"),
        F.col("value").isNull().cast("int").alias("imputed"))


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """5 stations: event value per type and 15-minute slot."""
    return (
        table(spark, sf, "events").groupBy(F.col("event_type").alias("station"), F.window("ts", "15 minutes").alias("w"))
        .agg(F.round(F.sum("value"), 2).alias("value")).select("station", F.col("w.start").alias("ts"), "value")
    )


def telemetry_dense(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.densify(cut_lineage(telemetry(spark, sf)), time="ts", minutes=15)


def covar(spark: SparkSession, sf: str) -> DataFrame:
    """Daily covariates of the whole basin."""
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.round(F.avg("l_discount"), 12).alias("cv_disc"), F.round(F.avg("l_tax"), 12).alias("cv_tax"),
        F.round(F.sum("l_extendedprice") / 1e6, 9).alias("cv_tp"))


def covar_table(spark: SparkSession, sf: str) -> DataFrame:
    """The covariates as a written table: one row per day, so Catalyst can see that it is small."""
    return cut_lineage(covar(spark, sf))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Gridded readings on 0.25 degree cells: one reading per line item, placed by part key."""
    part = F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("ts"),
        (F.lit(3.0) + (part % 11) * 0.25).alias("lat"),
        (F.lit(101.0) + (F.floor(part / 11) % 11) * 0.25).alias("lon"),
        (F.lit(295.0) + F.col("l_tax") * 50).alias("t2m"),
        (F.lit(290.0) + F.col("l_discount") * 50).alias("d2m"),
        (F.lit(100000.0) + F.col("l_quantity") * 10).alias("sp"),
        (F.col("l_discount") * 100 - 5).alias("u10"),
        (F.col("l_tax") * 100 - 4).alias("v10"),
        (F.col("l_extendedprice") / 1e7).alias("tp"))


def station_xy(spark: SparkSession, sf: str) -> DataFrame:
    """A position for every customer, spread over the basin."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("station"),
        F.round(F.lit(3.0) + (key * 7919 % 2501) / 1000.0, 6).alias("lat"),
        F.round(F.lit(101.0) + (key * 104729 % 2503) / 1000.0, 6).alias("lon"))


def counter(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative counters over the 15-minute telemetry; absent slots are absent rows."""
    return counters.encode_counter(telemetry(spark, sf))


def ship_counter(spark: SparkSession, sf: str) -> DataFrame:
    """Counters over seven years of daily rows: the daily one restarts at every row, the yearly one each year."""
    return counters.encode_counter(ship(spark, sf), time="date")


MODELS = {"persistence": 1, "trailing7": 7, "trailing30": 30}


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three simple models on real days of the completed series: (model, station, date, actual, pred).

    Each predicts the mean of the last n days before the date.
    """
    series = features.add_rolling(region_filled(spark, sf), list(MODELS.values()), include_current=False, default=0.0, axis=GAPLESS)
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.round(f"roll{n}", 8).alias("pred"))
                       for m, n in MODELS.items()])
    return series.where("imputed = 0").select("station", "date", F.col("value").alias("actual"), F.inline(models))


def scaled_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Day, week and month sums against multiples of the trailing means: (model, scale, station, date, actual, pred)."""
    series = features.add_rolling(region_filled(spark, sf), list(MODELS.values()), include_current=False, default=0.0, axis=GAPLESS)
    series = features.add_targets(series, [1, 7, 30], start=0, axis=GAPLESS)
    rows = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(scale).alias("scale"), F.round(f"target{h}", 6).alias("actual"),
                 F.round(F.col(f"roll{n}") * h, 10).alias("pred"))
        for m, n in MODELS.items() for scale, h in (("daily", 1), ("weekly", 7), ("monthly", 30))])
    return series.select("station", "date", F.inline(rows)).where("actual IS NOT NULL")


def lead_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Fourteen days ahead from each origin, predicted by the trailing week: adds ``horizon_day``."""
    series = features.add_rolling(region_filled(spark, sf), [7], include_current=False, default=0.0, axis=GAPLESS)
    long = windows.explode_horizon(windows.horizon_targets(series, 14))
    return long.select("station", "date", "horizon_day", F.col("value").alias("actual"),
                       F.round("roll7", 8).alias("pred"))


# SQL counterparts: name -> (views it reads, statement).
DENSE = """
SELECT s.station, c.date, v.value
FROM (SELECT DISTINCT station FROM {0}) s
CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(date) FROM {0}), (SELECT max(date) FROM {0}),
                   INTERVAL 1 DAY)) AS DATE) AS date) c
LEFT JOIN {0} v ON v.station = s.station AND v.date = c.date"""
MASK = """
SELECT station, date,
       CASE WHEN md5(station || '|' || CAST(date AS VARCHAR)) >= '33333333' THEN value END AS value
FROM ({0})"""

VIEWS: dict[str, tuple[list[str], str]] = {
    "ship": ([], """
SELECT l_returnflag AS station, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS value
FROM lineitem GROUP BY 1, 2"""),
    "ship_dense": (["ship"], DENSE.format("ship")),
    "ship_masked": (["ship_dense"], MASK.format("SELECT * FROM ship_dense")),
    "region_raw": ([], """
SELECT CAST(n_regionkey AS VARCHAR) AS station, CAST(o_orderdate AS DATE) AS date,
       floor(round(sum(o_totalprice), 2) / 10) / 1e4 AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""),
    "region_dense": (["region_raw"], DENSE.format("region_raw")),
    "region_rain": (["region_dense"], MASK.format(
        "SELECT station, date, coalesce(value, 0.0) AS value FROM region_dense")),
    "region_filled": (["region_rain"], """
SELECT station, date,
       coalesce(value, round_even(coalesce(avg(value) OVER (PARTITION BY date), 0.0), 6)) AS value,
       CAST(value IS NULL AS INT) AS imputed
FROM region_rain"""),
    "telemetry": ([], """
SELECT event_type AS station, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, round(sum(value), 2) AS value
FROM events GROUP BY 1, 2"""),
    "telemetry_dense": (["telemetry"], """
SELECT s.station, c.ts, v.value
FROM (SELECT DISTINCT station FROM telemetry) s
CROSS JOIN (SELECT unnest(generate_series((SELECT min(ts) FROM telemetry), (SELECT max(ts) FROM telemetry),
                   INTERVAL 15 MINUTE)) AS ts) c
LEFT JOIN telemetry v ON v.station = s.station AND v.ts = c.ts"""),
    "covar": ([], """
SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_discount), 12) AS cv_disc, round(avg(l_tax), 12) AS cv_tax,
       round(sum(l_extendedprice) / 1e6, 9) AS cv_tp
FROM lineitem GROUP BY 1"""),
    "grid": ([], """
SELECT l_shipdate AS ts, CAST(3.0 + (l_partkey % 11) * 0.25 AS DOUBLE) AS lat,
       CAST(101.0 + ((l_partkey // 11) % 11) * 0.25 AS DOUBLE) AS lon,
       295.0::DOUBLE + l_tax * 50 AS t2m, 290.0::DOUBLE + l_discount * 50 AS d2m,
       100000.0::DOUBLE + l_quantity * 10 AS sp, l_discount * 100 - 5 AS u10, l_tax * 100 - 4 AS v10,
       l_extendedprice / 1e7 AS tp
FROM lineitem"""),
    "counter": (["telemetry"], """
SELECT station, ts,
       sum(value) OVER (PARTITION BY station, CAST(ts AS DATE) ORDER BY ts) AS raw_daily,
       sum(value) OVER (PARTITION BY station, year(ts) ORDER BY ts) AS raw_yearly
FROM telemetry"""),
    "ship_counter": (["ship"], """
SELECT station, date, value AS raw_daily, sum(value) OVER (PARTITION BY station, year(date) ORDER BY date) AS raw_yearly
FROM ship"""),
    "rolled": (["region_filled"], "SELECT *, " + ", ".join(
        f"coalesce(avg(value) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0.0) AS roll{n}"
        for n in (1, 7, 30)) + ", " + ", ".join(
        f"CASE WHEN count(*) OVER (w ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING) = {h} THEN "
        f"sum(value) OVER (w ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING) END AS target{h}" for h in (1, 7, 30))
        + ", row_number() OVER w AS rn, count(*) OVER (PARTITION BY station) AS n_rows"
        + " FROM region_filled WINDOW w AS (PARTITION BY station ORDER BY date)"),
    "predictions": (["rolled"], " UNION ALL ".join(
        f"SELECT '{m}' AS model, station, date, value AS actual, round(roll{n}, 8) AS pred FROM rolled WHERE imputed = 0"
        for m, n in (("persistence", 1), ("trailing7", 7), ("trailing30", 30)))),
    "scaled_predictions": (["rolled"], " UNION ALL ".join(
        f"SELECT '{m}' AS model, '{scale}' AS scale, station, date, round(target{h}, 6) AS actual, "
        f"round(roll{n} * {h}, 10) AS pred FROM rolled WHERE target{h} IS NOT NULL"
        for m, n in (("persistence", 1), ("trailing7", 7), ("trailing30", 30))
        for scale, h in (("daily", 1), ("weekly", 7), ("monthly", 30)))),
    "lead_predictions": (["rolled"], """
SELECT a.station, a.date, CAST(k AS INT) AS horizon_day, b.value AS actual, round(a.roll7, 8) AS pred
FROM rolled a CROSS JOIN (SELECT unnest(generate_series(1, 14)) AS k)
JOIN rolled b ON b.station = a.station AND b.rn = a.rn + k - 1 WHERE a.rn <= a.n_rows - 13"""),
    "station_xy": ([], """
SELECT c_custkey AS station, round(3.0::DOUBLE + (c_custkey * 7919 % 2501) / 1000.0::DOUBLE, 6) AS lat,
       round(101.0::DOUBLE + (c_custkey * 104729 % 2503) / 1000.0::DOUBLE, 6) AS lon
FROM customer"""),
}


def sql(uses: list[str] | str, statement: str) -> str:
    """Statement with the definitions of the views it uses, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in [uses] if isinstance(uses, str) else uses:
        add(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    body = statement.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def cut_sql(view: str, second: bool = False, time: str = "date") -> str:
    """Scalar sub-query: first validation (or, ``second``, first test) time of the 70 / 15 / 15 split of a view."""
    edge = "floor(n * 0.7::DOUBLE)" + (" + floor(n * 0.15::DOUBLE)" if second else "")
    return (f"(SELECT max({time}) FROM (SELECT {time}, row_number() OVER (ORDER BY {time}) - 1 AS o, count(*) OVER () AS n "
            f"FROM (SELECT DISTINCT {time} FROM {view})) WHERE o = {edge})")


def cuts(df: DataFrame, time: str = "date"):
    """The same two times as columns, from a one-row table."""
    table = split.cut_dates(df, time=time)
    return table.select("val_from").scalar(), table.select("test_from").scalar()
