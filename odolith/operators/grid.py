"""Grids of units: square or hexagonal cells whose centre lies in a region, with nesting coarser cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .proximity import inside

ROOT3 = 3.0**0.5


def square(polys: DataFrame, size: float, *, nest: int = 4) -> DataFrame:
    """``(cell_id, x, y, zone_id)``: squares of a grid anchored at the origin whose centre lies inside a region of ``polys``;
    ``zone_id`` names the square ``nest`` times as wide around it. Cells in several regions come once."""
    if not size > 0 or nest < 1:
        raise ValueError("size must be positive and nest at least 1")
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size).cast("long"), F.floor(F.col(hi) / size).cast("long"))
    raw = polys.select(F.explode(span("box.x0", "box.x1")).alias("i"), "box").select("i", F.explode(span("box.y0", "box.y1")).alias("j")).distinct()
    centres = raw.select(F.concat_ws("_", "i", "j").alias("id"), ((F.col("i") + 0.5) * size).alias("x"), ((F.col("j") + 0.5) * size).alias("y"), "i", "j")
    hit = inside(centres, polys, smallest=size).select("left_id", "x", "y", "i", "j").distinct()
    zone = F.concat_ws("_", F.lit("z"), F.floor(F.col("i") / nest).cast("string"), F.floor(F.col("j") / nest).cast("string"))
    return hit.select(F.col("left_id").alias("cell_id"), "x", "y", zone.alias("zone_id"))


def hexagonal(polys: DataFrame, size: float) -> DataFrame:
    """``(cell_id, x, y, rings)``: pointy-top hexagons of edge ``size``, in axial coordinates, whose centre lies inside a region."""
    if not size > 0:
        raise ValueError("size must be positive")
    wide, high = ROOT3 * size, 1.5 * size
    rows = F.sequence(F.floor(F.col("box.y0") / high).cast("long"), F.ceil(F.col("box.y1") / high).cast("long"))
    cols = F.sequence(F.floor(F.col("box.x0") / wide - F.col("r") / 2).cast("long") - 1, F.ceil(F.col("box.x1") / wide - F.col("r") / 2).cast("long") + 1)
    raw = polys.select(F.explode(rows).alias("r"), "box").select("r", F.explode(cols).alias("q")).distinct()
    centres = raw.select(F.concat_ws("_", "q", "r").alias("id"), (wide * (F.col("q") + F.col("r") / 2)).alias("x"), (high * F.col("r")).alias("y"))
    hit = inside(centres, polys, smallest=wide).select("left_id", "x", "y").distinct()
    corner = lambda a, b: F.struct((F.col("x") + a * size).alias("x"), (F.col("y") + b * size).alias("y"))
    h = ROOT3 / 2
    ring = F.array(corner(0, 1), corner(h, 0.5), corner(h, -0.5), corner(0, -1), corner(-h, -0.5), corner(-h, 0.5), corner(0, 1))
    return hit.select(F.col("left_id").alias("cell_id"), "x", "y", F.array(ring).alias("rings"))
