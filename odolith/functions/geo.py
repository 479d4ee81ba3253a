"""Planar geometry as Column expressions: WKT, rings, point in polygon, distances, bearings.

A geometry is ``array<array<struct<x double, y double>>>``: all rings of all its parts. Parts of a valid multipolygon
do not overlap and holes lie inside their shell, so a point is inside exactly if a ray from it crosses an odd number of
ring edges, whichever ring they belong to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import col

RINGS = "array<array<struct<x:double,y:double>>>"


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often ``of`` uses it."""
    return F.transform(F.array(value), of)[0]


def rings_of_wkt(wkt: Column | str) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON (any case and spacing). Null for null, empty array for EMPTY or no coordinates.

    A position that is not two numbers is left out.
    """
    texts = F.regexp_extract_all(col(wkt), F.lit(r"\(([^()]+)\)"), F.lit(1))

    def position(text: Column) -> Column:
        parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
        return F.struct(F.try_element_at(parts, F.lit(1)).try_cast("double").alias("x"), F.try_element_at(parts, F.lit(2)).try_cast("double").alias("y"))

    rings = F.transform(texts, lambda t: F.filter(F.transform(F.split(t, ","), position), lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    return F.filter(rings, lambda r: F.size(r) > 0)


def path_of_wkt(wkt: Column | str) -> Column:
    """Positions of a LINESTRING, in order."""
    return F.try_element_at(rings_of_wkt(wkt), F.lit(1))


def bounds(rings: Column | str) -> Column:
    """``struct<x0,y0,x1,y1>`` around all rings; its fields are null for an empty geometry."""
    def of(points: Column) -> Column:
        xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))

    return once(F.flatten(col(rings)), of)


def segments(path: Column) -> Column:
    """Consecutive positions of a path as ``array<struct<x1,y1,x2,y2>>``."""
    return F.transform(
        F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))),
        lambda p, i: F.struct(F.get(path, i)["x"].alias("x1"), F.get(path, i)["y"].alias("y1"), p["x"].alias("x2"), p["y"].alias("y2")),
    )


def ring_edges(rings: Column | str) -> Column:
    """All ring edges; a ring that is not closed is closed."""
    closed = F.transform(col(rings), lambda r: F.concat(r, F.slice(r, 1, 1)))
    return F.flatten(F.transform(closed, segments))


def crosses(x: Column, y: Column, e: Column) -> Column:
    """Whether the ray from (x, y) towards greater x crosses the edge; half-open in y, so a vertex counts once."""
    spans = (e["y1"] > y) != (e["y2"] > y)
    return spans & (x < e["x1"] + (y - e["y1"]) / F.when(spans, e["y2"] - e["y1"]) * (e["x2"] - e["x1"]))


def contains(edges: Column | str, x: Column | str, y: Column | str) -> Column:
    """Whether the point lies inside the geometry with these ring edges (holes are outside)."""
    x, y = col(x), col(y)
    return F.aggregate(col(edges), F.lit(False), lambda inside, e: inside != F.coalesce(crosses(x, y, e), F.lit(False)))


def _turned(rings: Column) -> Column:
    """Rings as ``(edges, sign)``: +1 or -1 so that, whichever way rings were written, shells count positive and holes negative.

    A ring is a hole if its first position lies inside an odd number of the other rings.
    """
    each = F.transform(rings, lambda r, i: F.struct(r.alias("r"), i.alias("i")))

    def one(ring: Column) -> Column:
        others = F.transform(F.filter(each, lambda o: o["i"] != ring["i"]), lambda o: o["r"])
        p = ring["r"][0]
        edges = ring_edges(F.array(ring["r"]))
        doubled = F.aggregate(edges, F.lit(0.0), lambda a, s: a + (s["x1"] - p["x"]) * (s["y2"] - p["y"]) - (s["x2"] - p["x"]) * (s["y1"] - p["y"]))
        return F.struct(edges.alias("edges"), (F.signum(doubled) * F.when(contains(ring_edges(others), p["x"], p["y"]), -1.0).otherwise(1.0)).alias("sign"))

    return F.transform(each, one)


def area(rings: Column | str) -> Column:
    """Area inside the rings by the shoelace rule; 0 for none. Rings may be written in either direction."""
    return once(col(rings), _area)


def _area(rings: Column) -> Column:
    o = F.try_element_at(F.flatten(rings), F.lit(1))
    cross = lambda s: (s["x1"] - o["x"]) * (s["y2"] - o["y"]) - (s["x2"] - o["x"]) * (s["y1"] - o["y"])
    return F.aggregate(_turned(rings), F.lit(0.0), lambda a, t: a + t["sign"] * F.aggregate(t["edges"], F.lit(0.0), lambda b, s: b + cross(s))) / 2


def _clipped(points: Column, e: Column) -> Column:
    """A closed ring (first position not repeated) cut by the half-plane left of the edge ``e``; may run along the cut twice."""
    side = lambda p: (e["x2"] - e["x1"]) * (p["y"] - e["y1"]) - (e["y2"] - e["y1"]) * (p["x"] - e["x1"])

    def step(p: Column, i: Column) -> Column:
        q = F.coalesce(F.get(points, i + 1), F.get(points, F.lit(0)))
        a, b = side(p), side(q)
        t = a / F.when(a != b, a - b)
        cut = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
        none = F.slice(points, 1, 0)
        own = F.when(a >= 0, F.array(p)).otherwise(none)
        return F.concat(own, F.when(((a > 0) & (b < 0)) | ((a < 0) & (b > 0)), F.array(cut)).otherwise(none))

    return F.flatten(F.transform(points, step))


def _shoelace(points: Column) -> Column:
    """Signed area of a ring."""
    o = F.try_element_at(points, F.lit(1))
    cross = lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])
    each = F.transform(points, lambda p, i: cross(p, F.coalesce(F.get(points, i + 1), o)))
    return F.aggregate(each, F.lit(0.0), lambda a, v: a + v) / 2


def area_within(rings: Column | str, convex: Column | str) -> Column:
    """Area that lies both inside the rings and inside a convex ring (either direction, closed or not): every ring is cut by
    one half-plane after the other; holes count negative. 0 for an empty geometry, null for a null one."""
    def of(pair: Column) -> Column:
        ring = pair["c"]
        turned = F.when(_shoelace(ring) < 0, F.reverse(ring)).otherwise(ring)
        cuts = ring_edges(F.array(turned))
        one = lambda t: t["sign"] * _shoelace(F.aggregate(cuts, F.transform(t["edges"], lambda s: F.struct(s["x1"].alias("x"), s["y1"].alias("y"))), lambda acc, e: F.when((e["x1"] == e["x2"]) & (e["y1"] == e["y2"]), acc).otherwise(_clipped(acc, e))))
        return F.aggregate(F.transform(_turned(pair["r"]), one), F.lit(0.0), lambda a, v: a + v)

    return F.when(col(rings).isNotNull(), once(F.struct(col(rings).alias("r"), col(convex).alias("c")), of))


def centroid(rings: Column | str) -> Column:
    """Area centroid ``struct<x,y>`` of the rings; the mean of the positions where the area is zero; null for none."""
    return once(col(rings), _centroid)


def _centroid(rings: Column) -> Column:
    points = F.flatten(rings)
    o = F.try_element_at(points, F.lit(1))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    signed = F.flatten(F.transform(_turned(rings), lambda t: F.transform(t["edges"], lambda s: F.struct((s["x1"] - o["x"]).alias("x1"), (s["y1"] - o["y"]).alias("y1"), (s["x2"] - o["x"]).alias("x2"), (s["y2"] - o["y"]).alias("y2"), t["sign"].alias("sign")))))

    def add(acc: Column, s: Column) -> Column:
        c = s["sign"] * (s["x1"] * s["y2"] - s["x2"] * s["y1"])
        return F.struct((acc["a"] + c).alias("a"), (acc["x"] + (s["x1"] + s["x2"]) * c).alias("x"), (acc["y"] + (s["y1"] + s["y2"]) * c).alias("y"))

    mean = lambda k: F.aggregate(F.transform(points, lambda p: p[k]), F.lit(0.0), lambda a, v: a + v) / F.size(points)
    middle = lambda m: F.when(m["a"] != 0, F.struct((o["x"] + m["x"] / (3 * m["a"])).alias("x"), (o["y"] + m["y"] / (3 * m["a"])).alias("y"))).when(F.size(points) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))
    return once(F.aggregate(signed, zero, add), middle)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6_371_008.8) -> Column:
    """Metres between two positions in degrees (haversine)."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def along_segment(x: Column, y: Column, s: Column) -> Column:
    """Share of the segment, 0 to 1, at which it comes closest to (x, y)."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    n = dx * dx + dy * dy
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["x1"]) * dx + (y - s["y1"]) * dy) / n))).otherwise(0.0)


def segment_distance(x: Column, y: Column, s: Column) -> Column:
    t = along_segment(x, y, s)
    return distance(x, y, s["x1"] + t * (s["x2"] - s["x1"]), s["y1"] + t * (s["y2"] - s["y1"]))


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)), F.lit(360.0))


def path_length(path: Column) -> Column:
    return F.aggregate(segments(path), F.lit(0.0), lambda a, s: a + distance(s["x1"], s["y1"], s["x2"], s["y2"]))


def bearing_at(path: Column | str, at: Column | str | None = None) -> Column:
    """Bearing of the segment that holds the position ``at`` along the path (default: its middle), clamped to the ends."""
    path = col(path)
    at = path_length(path) / 2 if at is None else col(at)
    zero = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("deg"), F.lit(False).alias("found"))

    def step(acc: Column, s: Column) -> Column:
        run = acc["run"] + distance(s["x1"], s["y1"], s["x2"], s["y2"])
        deg = F.when(acc["found"], acc["deg"]).otherwise(bearing(s["x1"], s["y1"], s["x2"], s["y2"]))
        return F.struct(run.alias("run"), deg.alias("deg"), (acc["found"] | (run > at)).alias("found"))

    return F.aggregate(segments(path), zero, step)["deg"]


def angular_difference(a: Column | str, b: Column | str, undirected: bool = False) -> Column:
    """Degrees between two bearings, in [0, 180]; [0, 90] when a line's two directions are the same to the caller."""
    d = F.pmod(F.abs(col(a) - col(b)), F.lit(360.0))
    d = F.least(d, 360 - d)
    return F.least(d, 180 - d) if undirected else d
