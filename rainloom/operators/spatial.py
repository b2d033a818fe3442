"""Nearest grid cell, bounding boxes and removal of columns that repeat the same cell."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.functions import scalars as fx
from rainloom.session import cut_lineage


def bounding_box(grid: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Cells inside the box; plain range predicates, so they reach the file scan."""
    return grid.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))


def _box_distance_km(lat, lon, south, west, size: float):
    """Lower bound of the distance from a point to a box of ``size`` degrees, also across the date line."""
    north, east = south + F.lit(size), west + F.lit(size)
    d_lat = F.greatest(F.lit(0.0), south - lat, lat - north)
    direct = F.greatest(F.lit(0.0), west - lon, lon - east)
    around = F.lit(360.0) - F.greatest(F.abs(west - lon), F.abs(east - lon))
    d_lon = F.greatest(F.lit(0.0), F.least(direct, around))
    meridian = F.when(d_lon < 90, F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(d_lon)))) \
        .otherwise(F.radians(F.lit(90.0) - F.abs(lat)))
    return F.lit(fx.EARTH_RADIUS_KM * (1 - 1e-9)) * F.greatest(F.radians(d_lat), meridian)


def nearest_cell(stations: DataFrame, grid: DataFrame, resolution: float = 0.25,
                 keys: Sequence[str] = ("station",)) -> DataFrame:
    """Closest cell of a grid for each station, with the distance in km; cells may lie anywhere in their squares.

    First the nine squares around the station are looked up by index; a cell is
    accepted if nothing beyond them can be closer.  The other stations (holes,
    far away, near a pole or the date line) descend a pyramid of squares that
    double in size: only squares that may hold something closer than the best
    cell known so far are opened, so a station has a handful of rows a level.
    Ties go to the lower latitude, then longitude.  A station without position,
    or with an empty grid, has a NULL cell; cells without position are ignored.
    """
    named = [*keys, "lat", "lon"]
    cells = grid.select("lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    size = float(resolution)
    cells = cut_lineage(cells.select(
        F.floor(F.col("lat") / size).cast("long").alias("_i"), F.floor(F.col("lon") / size).cast("long").alias("_j"),
        F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon")))
    placed = stations.select(*named).where("lat IS NOT NULL AND lon IS NOT NULL")
    lost = stations.select(*named).where("lat IS NULL OR lon IS NULL").withColumns({
        "cell_lat": F.lit(None).cast("double"), "cell_lon": F.lit(None).cast("double"), "distance_km": F.lit(None).cast("double")})
    around = F.sequence(F.lit(-1), F.lit(1))
    distance = fx.haversine_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"))
    best = F.min(F.struct(distance.alias("d"), "cell_lat", "cell_lon")).alias("_best")
    numbered = cut_lineage(placed.distinct().withColumn("_id", F.monotonically_increasing_id()))
    near = numbered.withColumn("_di", F.explode(around)).withColumn("_dj", F.explode(around)).withColumns({
        "_i": F.floor(F.col("lat") / size).cast("long") + F.col("_di"), "_j": F.floor(F.col("lon") / size).cast("long") + F.col("_dj")})
    first = cut_lineage(near.join(cells, ["_i", "_j"]).groupBy("_id").agg(best))
    reach = math.radians(size)
    outside = F.least(F.lit(fx.EARTH_RADIUS_KM * reach),
                      F.lit(fx.EARTH_RADIUS_KM) * F.asin(F.cos(F.radians("lat")) * F.lit(math.sin(min(reach, math.pi / 2)))))
    tried = cut_lineage(numbered.join(first, "_id", "left").withColumn(
        "_sure", F.coalesce((F.col("_best.d") < outside) & (F.abs("lon") + size < 180), F.lit(False))))
    rest = tried.where(~F.col("_sure")).drop("_sure", "_best")
    found = tried.where("_sure").select("_id", "_best")
    if not rest.isEmpty():
        found = found.unionByName(_descend(rest, cells, size))
    hits = numbered.join(found, "_id", "left").select(
        *named, F.col("_best.cell_lat").alias("cell_lat"), F.col("_best.cell_lon").alias("cell_lon"), F.col("_best.d").alias("distance_km"))
    return hits.unionByName(lost.distinct())


def _descend(stations: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Best cell of each station (``_id``, ``_best``), from the coarsest squares down."""
    levels = max(1, math.ceil(math.log2(360.0 / size)))
    pyramid = [cells.groupBy("_i", "_j").agg(F.min(F.struct("cell_lat", "cell_lon")).alias("_some"))]
    for _ in range(levels):
        up = cut_lineage(pyramid[-1])
        pyramid[-1] = up
        pyramid.append(up.groupBy(F.floor(F.col("_i") / 2).cast("long").alias("_i"), F.floor(F.col("_j") / 2).cast("long").alias("_j"))
                       .agg(F.min("_some").alias("_some")))
    top = pyramid[-1].select("_i", "_j").collect()  # squares of 360 degrees or more: at most nine
    squares = F.array(*[F.struct(F.lit(r["_i"]).cast("long").alias("_i"), F.lit(r["_j"]).cast("long").alias("_j")) for r in top])
    if not top:
        return stations.select("_id", F.lit(None).cast("struct<d:double,cell_lat:double,cell_lon:double>").alias("_best"))
    wanted = stations.select("_id", "lat", "lon", F.inline(squares))
    for level in range(levels, -1, -1):
        side = size * 2 ** level
        met = wanted.join(pyramid[level], ["_i", "_j"]).withColumns({
            "_low": _box_distance_km(F.col("lat"), F.col("lon"), F.col("_i") * side, F.col("_j") * side, side),
            "_up": fx.haversine_km(F.col("lat"), F.col("lon"), F.col("_some.cell_lat"), F.col("_some.cell_lon"))})
        met = cut_lineage(met.select("_id", "lat", "lon", "_i", "_j", "_low", "_up"))
        bound = met.groupBy("_id").agg(F.min("_up").alias("_bound"))
        open_ = met.join(bound, "_id").where(F.col("_low") <= F.col("_bound")).select("_id", "lat", "lon", "_i", "_j")
        if level:
            half = F.sequence(F.lit(0), F.lit(1))
            wanted = open_.withColumn("_a", F.explode(half)).withColumn("_b", F.explode(half)).select(
                "_id", "lat", "lon", (F.col("_i") * 2 + F.col("_a")).alias("_i"), (F.col("_j") * 2 + F.col("_b")).alias("_j"))
        else:
            wanted = open_
    distance = fx.haversine_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"))
    return wanted.join(cells, ["_i", "_j"]).groupBy("_id").agg(
        F.min(F.struct(distance.alias("d"), "cell_lat", "cell_lon")).alias("_best"))


def repeated_columns(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Map each column to the first column with identical content.

    One pass of checksums proposes the groups, a second pass confirms them.
    """
    sums = df.agg(*[F.sum(F.xxhash64(F.col(c)).cast("decimal(38,0)")).alias(c) for c in columns]).first()
    first: dict[object, str] = {}
    proposed = {c: first.setdefault(sums[c], c) for c in columns}
    pairs = [(c, k) for c, k in proposed.items() if c != k]
    if not pairs:
        return proposed
    unequal = df.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(k))).alias(c) for c, k in pairs]).first()
    return {c: (k if c == k or unequal[c] == 0 else c) for c, k in proposed.items()}


def drop_repeated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    kept = repeated_columns(df, columns)
    return df.drop(*[c for c in columns if kept[c] != c])
