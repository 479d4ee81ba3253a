"""Rasters as pixel tables: sampling values at points, and the tiles that cover a box."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NAN, finite


@dataclass(frozen=True)
class Grid:
    """North-up placement: the outer corner of pixel (0, 0) and the size of a pixel."""

    x0: float
    y0: float
    dx: float
    dy: float
    nodata: float | None = None


def _valid(pixels: DataFrame, grid: Grid) -> DataFrame:
    ok = finite("value") if grid.nodata is None else finite("value") & (F.col("value") != grid.nodata)
    return pixels.filter(ok).groupBy("row", "col").agg(F.min(F.col("value").cast("double")).alias("value"))


def sample(points: DataFrame, pixels: DataFrame, grid: Grid, *, method: str = "bilinear", name: str = "value") -> DataFrame:
    """Points (unique ``id``, ``x``, ``y``) with the raster's value: of the pixel they lie in (``nearest``), or interpolated between
    the four pixel centres around them (``bilinear``); NaN outside, without a place, or if a pixel needed has no data."""
    if method not in ("nearest", "bilinear"):
        raise ValueError("method must be nearest or bilinear")
    ok = points.filter(finite("x") & finite("y"))
    fx, fy = (F.col("x") - grid.x0) / grid.dx, (grid.y0 - F.col("y")) / grid.dy
    px = _valid(pixels, grid)
    if method == "nearest":
        hit = ok.select("id", F.floor(fy).cast("long").alias("row"), F.floor(fx).cast("long").alias("col")).join(px, ["row", "col"])
        got = hit.select("id", F.col("value").alias("__v"))
    else:
        c, r = fx - 0.5, fy - 0.5
        four = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
        part = ok.select("id", F.floor(r).alias("r0"), F.floor(c).alias("c0"), (r - F.floor(r)).alias("tr"), (c - F.floor(c)).alias("tc"), F.explode(four).alias("p"))
        w = F.when(F.col("p.i") == 1, F.col("tr")).otherwise(1 - F.col("tr")) * F.when(F.col("p.j") == 1, F.col("tc")).otherwise(1 - F.col("tc"))
        need = part.select("id", (F.col("r0") + F.col("p.i")).cast("long").alias("row"), (F.col("c0") + F.col("p.j")).cast("long").alias("col"), w.alias("w")).filter("w > 0")
        hit = need.join(px, ["row", "col"], "left")
        got = hit.groupBy("id").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.count_if(F.col("value").isNull()).alias("gaps")).select("id", F.when(F.col("gaps") == 0, F.col("s")).alias("__v"))
    return points.join(got, "id", "left").withColumn(name, F.coalesce("__v", F.lit(NAN))).drop("__v")


def tiles(spark: SparkSession, west: float, south: float, east: float, north: float, size: float = 1.0) -> DataFrame:
    """``(lon, lat, name)`` of the tiles, by their south-west corner, that a box in degrees touches, in any hemisphere."""
    lon = spark.range(math.floor(west / size), max(math.ceil(east / size), math.floor(west / size) + 1)).select((F.col("id") * size).alias("lon"))
    lat = spark.range(math.floor(south / size), max(math.ceil(north / size), math.floor(south / size) + 1)).select((F.col("id") * size).alias("lat"))
    name = lambda c, plus, minus, digits: F.concat(F.when(F.col(c) < 0, minus).otherwise(plus), F.lpad(F.abs(F.col(c)).cast("int").cast("string"), digits, "0"))
    return lon.crossJoin(F.broadcast(lat)).withColumn("name", F.concat(name("lat", "N", "S", 2), F.lit("_"), name("lon", "E", "W", 3)))
