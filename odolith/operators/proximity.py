"""Points near other points or inside regions, found through a hash grid.

Every join here is an equi-join on a grid cell followed by the exact test. A grid cell that holds a large share of all
points is split on both sides, and the parts meet each other in tasks of their own, so no task gets the whole crowd.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..schema import finite
from ..session import settled
from .skew import hot_slots, slot

#: Points of one grid cell that one task compares before the cell is split.
POINTS_PER_SPLIT = 20_000


def points(df: DataFrame, ident: str, x: str = "x", y: str = "y", **extra: str | Column) -> DataFrame:
    """Distinct ``(id, x, y, extras)`` of the rows that have an id and two finite coordinates."""
    have = df.filter(F.col(ident).isNotNull() & finite(x) & finite(y))
    cols = [F.col(ident).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")]
    return have.select(*cols, *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in extra.items()]).distinct()


#: Width of a grid cell in radii. Wider cells mean fewer copies of a point on the one side (2.25 on average) and more
#: pairs to test on the other.
CELL = 4.0


def gridded(df: DataFrame, size: float) -> DataFrame:
    """One row a point, with its grid cell."""
    return df.withColumn("gx", F.floor(F.col("x") / size)).withColumn("gy", F.floor(F.col("y") / size))


def spread(df: DataFrame, size: float, radius: float) -> DataFrame:
    """A row for every grid cell that holds a place at most ``radius`` from the point: one to four of them."""
    reach = radius * 1.000001  # so that no pair at exactly the radius is lost to rounding
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size))
    return df.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y")))


def crowds(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``(slot, sl, sr)`` of the grid cells with more than POINTS_PER_SPLIT rows, with the parts to cut them into as ``name``."""
    hot = hot_slots(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "n", POINTS_PER_SPLIT)
    return hot.select("slot", *[(F.col("splits") if c == name else F.lit(1)).alias(c) for c in ("sl", "sr")])


def crowds_around(df: DataFrame) -> DataFrame:
    """``crowds`` of the right side of a distance join, from points in their own cells only: a crowd is met in its cell and the
    eight around it, and a cell that is met by more than POINTS_PER_SPLIT points has a ninth of them in one of these nine."""
    own = df.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > POINTS_PER_SPLIT / 9)
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    around = own.withColumn("i", step).withColumn("j", step).select((F.col("gx") + F.col("i")).alias("gx"), (F.col("gy") + F.col("j")).alias("gy"), "n")
    met = around.groupBy("gx", "gy").agg(F.sum("n").alias("n"))
    return hot_slots(met, ["gx", "gy"], "n", POINTS_PER_SPLIT).select("slot", F.lit(1).alias("sl"), F.col("splits").alias("sr"))


def crowded(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt``: the rows of a crowded grid cell are cut into parts on either side, and every part of the one
    side meets every part of the other in a task of its own, so no task compares more than about POINTS_PER_SPLIT with as many.

    ``hot`` has the crowded cells of both sides, by slots of the cell's hash, so it is bounded and covers all of them.
    """
    hot = F.broadcast(hot.groupBy("slot").agg(F.max("sl").alias("sl"), F.max("sr").alias("sr")))
    part = lambda ident, k: F.when(F.col("sl").isNull(), 0).otherwise(F.pmod(F.xxhash64(ident), F.col(k)).cast("int"))
    every = lambda k: F.sequence(F.lit(0), F.coalesce(F.col(k), F.lit(1)) - 1)
    a = left.withColumn("slot", slot(left, keys)).join(hot, "slot", "left").withColumn("__l", part(left_id, "sl")).withColumn("salt", F.explode(F.transform(every("sr"), lambda r: r * F.coalesce("sl", F.lit(1)) + F.col("__l"))))
    b = right.withColumn("slot", slot(right, keys)).join(hot, "slot", "left").withColumn("__r", part(right_id, "sr")).withColumn("salt", F.explode(F.transform(every("sl"), lambda c: F.col("__r") * F.coalesce("sl", F.lit(1)) + c)))
    return a.drop("slot", "sl", "sr", "__l"), b.drop("slot", "sl", "sr", "__r")


def within_distance(left: DataFrame, right: DataFrame, radius: float, *, strict: bool = False, exact: Callable[..., Column] = geo.distance) -> DataFrame:
    """Pairs ``(left_id, right_id, distance)`` of two point sets at most ``radius`` apart.

    Both sides have ``id``, ``x``, ``y``; the left columns other than these are kept, prefixed by ``left_``, the right
    ones by ``right_``. A left point goes to its grid cell, a right one to every cell its neighbourhood touches, so every
    pair meets in exactly one cell and is then verified. ``strict`` takes only pairs nearer than the radius. ``exact``
    verifies (with ``geo.great_circle`` the grid must be in the same unit as the radius, so project first).
    """
    if not radius > 0:
        raise ValueError("radius must be positive")
    size = CELL * radius
    a = gridded(left.select(*[F.col(c).alias(f"left_{c}") for c in left.columns], "x", "y"), size).drop("x", "y")
    b = spread(right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns], "x", "y"), size, radius).drop("x", "y")
    hot = crowds(gridded(left.select("x", "y"), size), ["gx", "gy"], "sl").unionByName(crowds_around(gridded(right.select("x", "y"), size)))
    a, b = crowded(a, b, ["gx", "gy"], "left_id", "right_id", hot)
    d = exact(F.col("left_x"), F.col("left_y"), F.col("right_x"), F.col("right_y"))
    near = d < radius if strict else d <= radius
    return a.join(b, ["gx", "gy", "salt"]).withColumn("distance", d).filter(near).drop("gx", "gy", "salt")


def near_pairs(pts: DataFrame, radius: float) -> DataFrame:
    """Unordered pairs ``(left_id, right_id, distance)`` of one point set at most ``radius`` apart, smaller id left."""
    met = within_distance(pts.select("id", "x", "y"), pts.select("id", "x", "y"), radius)
    return met.filter("left_id < right_id").select("left_id", "right_id", "distance")


def regions(df: DataFrame, ident: str, wkt: str) -> DataFrame:
    """``(id, wkt, box)`` of the rows with a geometry that has coordinates; repeated rows stay until the join."""
    g = df.filter(F.col(ident).isNotNull() & F.col(wkt).rlike(r"\(\s*[-+.\d]")).select(F.col(ident).alias("id"), F.col(wkt).alias("wkt"))
    return g.withColumn("box", geo.bounds(geo.rings_of_wkt("wkt")))


def edges_of(polys: DataFrame) -> DataFrame:
    """``(id, edges)`` of distinct regions."""
    return polys.select("id", "wkt").distinct().select("id", geo.ring_edges(geo.rings_of_wkt("wkt")).alias("edges"))


def inside(pts: DataFrame, polys: DataFrame, smallest: float = 64.0) -> DataFrame:
    """Pairs ``(left_id, right_id)`` of a point and each region that contains it; other point columns are kept.

    Regions come in very different sizes, so the grid has levels of doubling cell width: a region is hashed at the level
    whose cells are at least as wide as its bounding box, hence to at most four cells, and a point at every level that
    some region uses (a few dozen at most, whatever the data). Only bounding boxes take part in this join; the geometry is
    shuffled once, to the points inside its box, and tested exactly there.
    """
    b = polys.filter(F.col("box.x0").isNotNull() & F.col("box.y0").isNotNull()).select(F.col("id").alias("right_id"), "box").distinct()
    wide = F.greatest(F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0"), F.lit(smallest))
    b = settled(b.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(wide / smallest))).cast("int")))  # geometries are parsed once for their boxes
    size = F.pow(F.lit(2.0), F.col("level")) * smallest
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    levels = F.broadcast(b.select("level").distinct())  # integers from 0 to about 60
    b = b.withColumn("gx", F.explode(span("box.x0", "box.x1"))).withColumn("gy", F.explode(span("box.y0", "box.y1")))
    a = pts.withColumnRenamed("id", "left_id").crossJoin(levels)
    a = a.withColumn("gx", F.floor(F.col("x") / size)).withColumn("gy", F.floor(F.col("y") / size))
    keys = ["level", "gx", "gy"]
    a, b = crowded(a, b, keys, "left_id", "right_id", crowds(a, keys, "sl").unionByName(crowds(b, keys, "sr")))
    maybe = a.join(b, ["level", "gx", "gy", "salt"]).filter(F.col("x").between(F.col("box.x0"), F.col("box.x1")) & F.col("y").between(F.col("box.y0"), F.col("box.y1")))
    maybe = maybe.drop("level", "gx", "gy", "salt", "box")
    # one shuffle by id serves both the removal of repeated rows and the join; a region full of points is split by AQE
    shape = polys.select(F.col("id").alias("right_id"), "wkt").repartition("right_id").distinct()
    shape = shape.select("right_id", geo.ring_edges(geo.rings_of_wkt("wkt")).alias("edges"))
    return maybe.join(shape, "right_id").filter(geo.contains("edges", "x", "y")).drop("edges")
