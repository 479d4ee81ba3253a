"""Mapping points, regions and lines onto each other: containment with nearest fallback, nearest neighbours, snapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..schema import INF, DataError, finite, union_all
from ..session import release, settled
from .proximity import crowded, crowds, edges_of, gridded, inside, points, regions, within_distance


#: Halvings of the whole extent that are tried for the spacing of points.
LEVELS = 32


def spacing(df: DataFrame) -> tuple[float, float]:
    """A typical distance between neighbouring points and the width of them all: the width of the coarsest grid, of those
    that halve the extent, on which at least half of the distinct points have a cell of their own.

    Empty space does not count, so neither a far outlier nor crowded places change it much. One pass, one row.
    """
    box = df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.approx_count_distinct(F.struct("x", "y"))).first()
    if box[0] is None:
        return 1.0, 0.0
    wide = max(box[1] - box[0], box[3] - box[2], 1.0)
    cell = lambda level: F.struct(F.floor((F.col("x") - box[0]) / (wide / 2**level)), F.floor((F.col("y") - box[2]) / (wide / 2**level)))
    used = df.agg(*[F.approx_count_distinct(cell(i)).alias(f"l{i}") for i in range(0, LEVELS, 2)]).first()
    fit = next((i for i in range(0, LEVELS, 2) if 2 * used[f"l{i}"] >= box[4]), LEVELS)
    return wide / 2**fit, wide


def nearest(left: DataFrame, right: DataFrame, *, max_distance: float = INF, first_radius: float | None = None) -> DataFrame:
    """``(left_id, right_id, distance)``: of every left point the nearest right point, the smaller id of equals; null beyond
    ``max_distance`` or if there is no right point. Both sides have unique ``id`` and ``x``, ``y``.

    Rings of growing radius: points that find a neighbour within the radius are done (none nearer can be missed), the rest
    go on with four times the radius. The first radius is the typical spacing of the right side.
    """
    todo = settled(left.select("id", "x", "y"))
    base = settled(right.select("id", "x", "y"))
    reach = todo.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    box = base.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    done: list[DataFrame] = []
    kind = right.schema["id"].dataType
    if box[0] is not None and reach[0] is not None:
        wide = max(max(box[1], reach[1]) - min(box[0], reach[0]), max(box[3], reach[3]) - min(box[2], reach[2]), 1.0)
        radius, last = first_radius or spacing(base)[0], min(max_distance, 2.0 * wide)
        while last > 0:
            radius = min(radius, last)
            hits = within_distance(todo, base, radius)
            best = hits.groupBy("left_id").agg(F.min(F.struct("distance", "right_id")).alias("m"))
            best = settled(best.select("left_id", "m.right_id", "m.distance"))
            done.append(best)
            if radius >= last:
                break
            rest = settled(todo.join(best.select(F.col("left_id").alias("id")), "id", "left_anti"))
            release(todo)
            todo = rest
            if todo.isEmpty():
                break
            radius *= 4
    release(todo, base)
    ids = left.select(F.col("id").alias("left_id"))
    if not done:
        return ids.select("left_id", F.lit(None).cast(kind).alias("right_id"), F.lit(None).cast("double").alias("distance"))
    return ids.join(union_all(*done), "left_id", "left")


def points_to_regions(pts: DataFrame, polys: DataFrame, *, allow_nearest: bool = True, max_distance: float = INF) -> DataFrame:
    """``(left_id, right_id, distance)``: the region around each point, the smallest id of several, with a null distance; for
    points in none the nearest region up to ``max_distance``, by the distance to its boundary. ``polys`` are ``regions``."""
    hit = inside(pts.select("id", "x", "y"), polys).groupBy("left_id").agg(F.min("right_id").alias("right_id"))
    hit = settled(hit)
    ids = pts.select(F.col("id").alias("left_id"))
    if not allow_nearest:
        return ids.join(hit, "left_id", "left").withColumn("distance", F.lit(None).cast("double"))
    rest = pts.select("id", "x", "y").join(hit.select(F.col("left_id").alias("id")), "id", "left_anti")
    near = nearest_boundary(rest, polys, max_distance=max_distance)
    both = hit.withColumn("distance", F.lit(None).cast("double")).unionByName(near)
    return ids.join(both, "left_id", "left")


def nearest_boundary(pts: DataFrame, polys: DataFrame, *, max_distance: float = INF) -> DataFrame:
    """``(left_id, right_id, distance)`` of points and the region whose boundary is nearest, within ``max_distance``."""
    edges = edges_of(polys).select(F.col("id").alias("right_id"), F.explode("edges").alias("s")).filter(F.col("s.x1").isNotNull())
    return _nearest_segment(pts, edges, max_distance)


def _pieces(segs: DataFrame, size: float, radius: float) -> DataFrame:
    """Segments with the grid cells that hold a place at most ``radius`` from them, long ones cut so that no piece spans many
    cells. Neighbouring pieces may name a cell twice."""
    length = geo.distance(F.col("s.x1"), F.col("s.y1"), F.col("s.x2"), F.col("s.y2"))
    n = F.greatest(F.lit(1), F.ceil(length / size).cast("int"))
    cut = segs.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c, t: F.col(f"s.{c}1") + (F.col(f"s.{c}2") - F.col(f"s.{c}1")) * t
    t0, t1, reach = F.col("i") / F.col("n"), (F.col("i") + 1) / F.col("n"), radius * 1.000001
    span = lambda c: F.sequence(F.floor((F.least(at(c, t0), at(c, t1)) - reach) / size), F.floor((F.greatest(at(c, t0), at(c, t1)) + reach) / size))
    return cut.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y"))).drop("n", "i")


def near_segments(pts: DataFrame, segs: DataFrame, radius: float) -> DataFrame:
    """Points joined to the segments at most ``radius`` away, at least once each: point columns prefixed ``left_``, the segment's
    columns, ``distance``. ``segs`` has ``right_id`` and ``s`` (``x1, y1, x2, y2``) and further columns of its own."""
    size = 2.0 * radius
    a = gridded(pts.select(*[F.col(c).alias(f"left_{c}") for c in pts.columns], "x", "y"), size).drop("x", "y")
    b = _pieces(segs, size, radius)
    a, b = crowded(a, b, ["gx", "gy"], "left_id", "right_id", crowds(a, ["gx", "gy"], "sl").unionByName(crowds(b, ["gx", "gy"], "sr")))
    d = geo.segment_distance(F.col("left_x"), F.col("left_y"), F.col("s"))
    return a.join(b, ["gx", "gy", "salt"]).withColumn("distance", d).filter(d <= radius).drop("gx", "gy", "salt")


def _rings_out(segs: DataFrame, pts: DataFrame, of: str, other: str, max_distance: float) -> DataFrame | None:
    """``(one, other, distance)``: of every ``of`` (``left_id``: points, ``right_id``: the segments' regions) the nearest on the other
    side, in rings of growing radius; those that found one within the radius are done. None if a side is empty."""
    segs, todo = settled(segs), settled(pts)
    ends = segs.select(F.col("s.x1").alias("x"), F.col("s.y1").alias("y")).unionByName(segs.select(F.col("s.x2").alias("x"), F.col("s.y2").alias("y")))
    box = ends.unionByName(todo.select("x", "y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    best: list[DataFrame] = []
    if not segs.isEmpty() and not todo.isEmpty():
        wide = max(box[1] - box[0], box[3] - box[2], 1.0)
        # not so narrow that segments fall into many pieces: on average two
        long = segs.agg(F.avg(geo.distance(F.col("s.x1"), F.col("s.y1"), F.col("s.x2"), F.col("s.y2")))).first()[0]
        radius, last = max(spacing(todo if of == "right_id" else ends)[0], long / 4), min(max_distance, 2.0 * wide)
        while last > 0:
            radius = min(radius, last)
            hit = near_segments(todo, segs, radius).groupBy(F.col(of).alias("one")).agg(F.min(F.struct("distance", F.col(other).alias("other"))).alias("m"))
            hit = settled(hit.select("one", "m.other", "m.distance"))
            best.append(hit)
            if radius >= last:
                break
            if of == "left_id":
                rest = settled(todo.join(hit.select(F.col("one").alias("id")), "id", "left_anti"))
                release(todo)
                todo = rest
            else:
                rest = settled(segs.join(hit.select(F.col("one").alias("right_id")), "right_id", "left_anti"))
                release(segs)
                segs = rest
            if rest.isEmpty():
                break
            radius *= 4
    release(segs, todo)
    return union_all(*best) if best else None


def _nearest_segment(pts: DataFrame, segs: DataFrame, max_distance: float) -> DataFrame:
    best = _rings_out(segs, pts.select("id", "x", "y"), "left_id", "right_id", max_distance)
    if best is None:
        best = pts.filter("false").select(F.col("id").alias("one"), F.lit(None).cast(segs.schema["right_id"].dataType).alias("other"), F.lit(None).cast("double").alias("distance"))
    return best.select(F.col("one").alias("left_id"), F.col("other").alias("right_id"), "distance")


def regions_to_points(polys: DataFrame, pts: DataFrame, *, allow_nearest: bool = True, max_distance: float = INF) -> DataFrame:
    """``(left_id, right_id, distance)``: for each region the point inside it, the smallest id of several, with a null
    distance; for regions without one the point nearest to their boundary up to ``max_distance``, the smaller id of equals."""
    hit = inside(pts.select("id", "x", "y"), polys).groupBy(F.col("right_id").alias("region")).agg(F.min("left_id").alias("point"))
    hit = settled(hit.select(F.col("region").alias("left_id"), F.col("point").alias("right_id"), F.lit(None).cast("double").alias("distance")))
    ids = polys.select(F.col("id").alias("left_id")).distinct()
    if allow_nearest:
        rest = edges_of(polys.join(hit.select(F.col("left_id").alias("id")), "id", "left_anti"))
        segs = rest.select(F.col("id").alias("right_id"), F.explode("edges").alias("s")).filter(F.col("s.x1").isNotNull())
        near = _rings_out(segs, pts.select("id", "x", "y"), "right_id", "left_id", max_distance)
        if near is not None:
            hit = hit.unionByName(near.select(F.col("one").alias("left_id"), F.col("other").alias("right_id"), "distance"))
    return ids.join(hit, "left_id", "left")


def snap(pts: DataFrame, nodes: DataFrame, *, max_distance: float = INF, eligible: Column | None = None) -> DataFrame:
    """``nearest`` node of each point, of those that are eligible; DataError if none is."""
    have = nodes if eligible is None else nodes.filter(eligible)
    if have.isEmpty():
        raise DataError("no eligible node")
    return nearest(pts, have.select("id", "x", "y"), max_distance=max_distance)


def lines(df: DataFrame, ident: str, wkt: str) -> DataFrame:
    """``(id, path)`` of rows with a line of at least two positions."""
    return df.select(F.col(ident).alias("id"), geo.path_of_wkt(wkt).alias("path")).filter(F.size("path") > 1)


def points_to_lines(pts: DataFrame, line: DataFrame, radius: float, *, eligible: Column | None = None, accept: Column | None = None) -> DataFrame:
    """``(left_id, right_id, distance, dist_along)``: the nearest line within ``radius`` that is eligible and acceptable, the
    smaller id of equals; null without one.

    Repeated lines count once. ``eligible`` is a predicate on the line's columns (prefixed ``line_``) and the point's (prefixed ``left_``), ``accept`` may
    also use ``distance``, ``dist_along`` and ``line_path``. A candidate that is not accepted gives way to the next nearest.
    """
    own = [c for c in line.columns if c not in ("id", "path")]
    segs = line.select(F.col("id").alias("right_id"), F.xxhash64("path", *own).alias("__line"), *[F.col(c).alias(f"line_{c}") for c in own], F.posexplode(geo.segments(F.col("path"))).alias("seq", "s"))
    # the length before each segment, so that no candidate carries the whole line
    segs = segs.dropDuplicates(["right_id", "__line", "seq"])  # repeated rows of a line
    order = Window.partitionBy("right_id", "__line").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    long = geo.distance(F.col("s.x1"), F.col("s.y1"), F.col("s.x2"), F.col("s.y2"))
    segs = segs.withColumn("before", F.coalesce(F.sum(long).over(order), F.lit(0.0)))
    met = near_segments(pts, segs, radius)
    if eligible is not None:
        met = met.filter(eligible)
    one = met.withColumn("dist_along", F.col("before") + geo.along_segment(F.col("left_x"), F.col("left_y"), F.col("s")) * long)
    first = [F.first(c).alias(c) for c in one.columns if c.startswith(("left_", "line_")) and c != "left_id"] if accept is not None else []
    per_line = one.groupBy("left_id", "right_id", "__line").agg(F.min(F.struct("distance", "dist_along")).alias("m"), *first)
    per_line = per_line.withColumn("distance", F.col("m.distance")).withColumn("dist_along", F.col("m.dist_along"))
    if accept is not None:
        per_line = per_line.join(line.select(F.col("id").alias("right_id"), F.xxhash64("path", *own).alias("__line"), F.col("path").alias("line_path")).distinct(), ["right_id", "__line"]).filter(accept)
    best = per_line.groupBy("left_id").agg(F.min(F.struct("distance", "right_id", "dist_along")).alias("m"))
    return pts.select(F.col("id").alias("left_id")).join(best.select("left_id", "m.right_id", "m.distance", "m.dist_along"), "left_id", "left")


def snap_counters(counters: DataFrame, line: DataFrame, *, radius: float = 50.0, tolerance: float = 20.0, bearing: str = "bearing_deg", bidirectional: str | None = None, eligible: Column | None = None) -> DataFrame:
    """Counters (``id, x, y``, a bearing) on the nearest line within ``radius`` that runs in their direction there, up to
    ``tolerance`` degrees; where the column ``bidirectional`` is true either direction will do."""
    here = geo.bearing_at("line_path", "dist_along")
    straight = geo.angular_difference(here, f"left_{bearing}")
    either = geo.angular_difference(here, f"left_{bearing}", undirected=True)
    turn = straight if bidirectional is None else F.when(F.coalesce(F.col(f"left_{bidirectional}"), F.lit(False)), either).otherwise(straight)
    return points_to_lines(counters, line, radius, eligible=eligible, accept=turn <= tolerance)


def transport_centroids(polys: DataFrame, pts: DataFrame, *, how: str = "median", geometric: bool = True, rings: DataFrame | None = None) -> DataFrame:
    """``(id, x, y)``: the median or mean place of the points inside each region; where there is none, if ``geometric``, the
    region's own centroid (``rings``: ``id, rings``)."""
    if how not in ("median", "mean"):
        raise ValueError("how must be median or mean")
    agg = F.median if how == "median" else F.avg
    met = inside(pts.select("id", "x", "y"), polys).groupBy(F.col("right_id").alias("id")).agg(agg("x").alias("x"), agg("y").alias("y"))
    if not geometric or rings is None:
        return met
    met = settled(met)
    own = rings.join(met.select("id"), "id", "left_anti").select("id", F.explode(F.array(geo.centroid("rings"))).alias("c"))
    return met.unionByName(own.filter("c is not null").select("id", "c.x", "c.y"))


def assign_to_centroid(polys: DataFrame, nodes: DataFrame, *, rings: DataFrame | None = None, how: str = "median", geometric: bool = True, max_distance: float = INF) -> DataFrame:
    """``(left_id, right_id, distance)``: each region's transport centroid snapped to the nearest of the eligible ``nodes``."""
    at = transport_centroids(polys, nodes, how=how, geometric=geometric, rings=rings)
    got = snap(at, nodes, max_distance=max_distance)
    return polys.select(F.col("id").alias("left_id")).distinct().join(got, "left_id", "left")


def cross_sum(targets: DataFrame, sources: DataFrame, radius: float, *, weight: str | None = None, density: bool = False, name: str = "total") -> DataFrame:
    """Per target (``id``) the count of sources, or the sum of their ``weight``, at most ``radius`` away, 0 without any; per unit
    of the circle's area if ``density``."""
    value = F.lit(1.0) if weight is None else F.coalesce(F.when(finite(weight), F.col(weight).cast("double")), F.lit(0.0))
    met = within_distance(targets.select("id", "x", "y"), sources.select("id", "x", "y", value.alias("w")), radius)
    per = met.groupBy(F.col("left_id").alias("id")).agg(F.sum("right_w").alias("s"))
    area = 3.141592653589793 * radius * radius if density else 1.0
    return targets.select("id").join(per, "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) / area).alias(name))


def sum_within(cells: DataFrame, columns: list[str], radius: float, *, densities: bool = False, filled: bool = False, areas: Column | None = None) -> DataFrame:
    """Per cell (``id, x, y``) the sums of columns over all cells at most ``radius`` away, itself included: ``<column>_r<radius>``.

    ``densities`` divides by the circle's area in square kilometres; ``filled`` adds ``..._filled``, per area of the cells with a
    positive row sum, for which cells must be of one size (DataError otherwise; ``areas`` in square metres).
    """
    if filled and not densities:
        raise ValueError("filled densities need densities")
    num = [F.coalesce(F.when(finite(c), F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns]
    base = cells.select("id", "x", "y", *num, (areas if areas is not None else F.lit(None)).cast("double").alias("area"))
    taken = base.withColumn("is_filled", (sum((F.col(c) for c in columns), F.lit(0.0)) > 0).cast("double"))
    met = within_distance(base.select("id", "x", "y"), taken.drop("area"), radius)
    per = met.groupBy(F.col("left_id").alias("id")).agg(*[F.sum(f"right_{c}").alias(c) for c in columns], F.sum("right_is_filled").alias("n_filled"))
    tag = f"r{radius:g}"
    circle = 3.141592653589793 * radius * radius / 1e6 if densities else 1.0
    out = [(F.coalesce(c, F.lit(0.0)) / circle).alias(f"{c}_{tag}") for c in columns]
    if filled:
        sizes = base.select(F.round(F.col("area") / 1e6, 4).alias("a")).distinct().limit(2).collect()
        if len(sizes) > 1:
            raise DataError("cells of different size")
        one = (sizes[0].a if sizes else 0.0) or 0.0
        room = F.col("n_filled") * one
        out += [F.when(room > 0, F.coalesce(c, F.lit(0.0)) / room).otherwise(0.0).alias(f"{c}_{tag}_filled") for c in columns]
    return cells.select("id").join(per, "id", "left").select("id", *out)


__all__ = ["assign_to_centroid", "cross_sum", "lines", "nearest", "points", "points_to_lines", "points_to_regions", "regions", "regions_to_points", "snap", "snap_counters", "sum_within", "transport_centroids"]
