import math
import random

import pytest
from pyspark.sql import functions as F

from odolith.functions import geo
from odolith.operators import mapping, proximity


def frame(spark, pts):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")


def cloud(n, seed, span=100.0):
    r = random.Random(seed)
    return [(r.uniform(-span, span), r.uniform(-span, span)) for _ in range(n)]


def test_near_pairs_against_brute_force(spark, rows):
    pts = cloud(300, 1) + [(0.0, 0.0)] * 3 + [(12.0, 0.0), (24.0, 0.0), (36.0, 0.0)]  # a crowd, and pairs at exactly the radius
    want = sorted(((i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if math.sqrt((pts[i][0] - pts[j][0]) ** 2 + (pts[i][1] - pts[j][1]) ** 2) <= 12), key=repr)
    assert rows(proximity.near_pairs(frame(spark, pts), 12.0).select("left_id", "right_id")) == want


def test_hot_grid_cells_are_split_without_loss(spark, monkeypatch):
    pts = [(0.1 * i, 0.0) for i in range(60)]
    want = {(i, j) for i in range(60) for j in range(60) if abs(0.1 * i - 0.1 * j) < 2}
    monkeypatch.setattr(proximity, "POINTS_PER_SPLIT", 7)
    f = frame(spark, pts)
    got = proximity.within_distance(f, f, 2.0, strict=True)
    assert {(r.left_id, r.right_id) for r in got.collect()} == want and got.count() == len(want)


def test_more_than_a_thousand_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(proximity, "POINTS_PER_SPLIT", 2)
    pts = [(100.0 * i + dx, 0.0) for i in range(1_100) for dx in (0.0, 0.5, 1.0, 1.5)]
    got = proximity.near_pairs(frame(spark, pts), 5.0)
    assert got.count() == 1_100 * 6 and got.select("left_id", "right_id").distinct().count() == 1_100 * 6


def test_points_without_place_or_id_and_repeats(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, "a"), (1, 0.0, 0.0, "a"), (2, None, 0.0, "b"), (3, math.nan, 1.0, "c"), (None, 1.0, 1.0, "d"), (4, math.inf, 0.0, "e")], "k long, x double, y double, gx string")
    got = proximity.points(df, "k", note="gx")
    assert [tuple(r) for r in got.collect()] == [(1, 0.0, 0.0, "a")]
    empty = proximity.points(df.filter("false"), "k")
    assert proximity.near_pairs(empty, 5.0).count() == 0 and proximity.within_distance(empty, empty, 5.0).count() == 0
    with pytest.raises(ValueError):
        proximity.near_pairs(empty, 0.0)


WKT = {
    "square": "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))",
    "holed": "polygon((20 0,40 0,40 20,20 20,20 0),  (25 5, 35 5, 35 15, 25 15, 25 5))",
    "parts": "MULTIPOLYGON (((50 0, 60 0, 60 10, 50 10, 50 0)), ((70 0, 80 0, 80 10, 70 10, 70 0)))",
    "empty": "POLYGON EMPTY",
    "none": None,
    "huge": "POLYGON ((-1000 -1000, 5000 -1000, 5000 5000, -1000 5000, -1000 -1000))",
    "broken": "POLYGON ((a b, c",
}


def shapes(spark):
    return spark.createDataFrame(list(WKT.items()), "k string, g string")


def test_inside(spark):
    pts = frame(spark, [(5, 5), (30, 10), (22, 2), (75, 5), (65, 5), (-2000, 0)])
    df = shapes(spark)
    got = {(r.left_id, r.right_id) for r in proximity.inside(pts, proximity.regions(df.unionByName(df), "k", "g")).collect()}
    assert got == {(0, "square"), (0, "huge"), (1, "huge"), (2, "holed"), (2, "huge"), (3, "parts"), (3, "huge"), (4, "huge")}
    assert proximity.inside(pts.filter("false"), proximity.regions(df, "k", "g")).count() == 0
    assert proximity.inside(pts, proximity.regions(df.filter("false"), "k", "g")).count() == 0


def test_measures(spark):
    df = shapes(spark).select("k", geo.rings_of_wkt("g").alias("r")).filter(F.size("r") > 0)
    got = {r.k: r for r in df.select("k", geo.area("r").alias("a"), geo.centroid("r").alias("c")).collect()}
    assert (got["square"].a, got["holed"].a, got["parts"].a) == (100, 300, 200)
    assert tuple(got["square"].c) == (5, 5) and tuple(got["holed"].c) == (30, 10) and tuple(got["parts"].c) == (65, 5)


def test_nearest_against_brute_force(spark):
    a, b = cloud(60, 2), cloud(40, 3, 1000.0)
    got = {r.left_id: r for r in mapping.nearest(frame(spark, a), frame(spark, b)).collect()}
    for i, (x, y) in enumerate(a):
        d, j = min((math.hypot(x - u, y - v), j) for j, (u, v) in enumerate(b))
        assert got[i].right_id == j and got[i].distance == pytest.approx(d)
    capped = {r.left_id: r.right_id for r in mapping.nearest(frame(spark, a), frame(spark, b), max_distance=50.0).collect()}
    assert len(capped) == 60 and any(v is None for v in capped.values())
    assert {r.right_id for r in mapping.nearest(frame(spark, a), frame(spark, [])).collect()} == {None}


def test_regions_and_points_with_fallback(spark):
    polys = proximity.regions(shapes(spark).filter("k in ('square', 'parts')"), "k", "g")
    pts = frame(spark, [(5, 5), (5, 13), (500, 0)])
    got = {r.left_id: (r.right_id, r.distance) for r in mapping.points_to_regions(pts, polys, max_distance=100.0).collect()}
    assert got == {0: ("square", None), 1: ("square", 3.0), 2: (None, None)}
    back = {r.left_id: (r.right_id, r.distance) for r in mapping.regions_to_points(polys, pts).collect()}
    assert back["square"] == (0, None) and back["parts"] == (0, 45.0)


def test_snapping_needs_an_eligible_node(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, True), (2, 10.0, 0.0, False)], "id long, x double, y double, ok boolean")
    pts = frame(spark, [(9, 0)])
    assert mapping.snap(pts, nodes).first().right_id == 2 and mapping.snap(pts, nodes, eligible=F.col("ok")).first().right_id == 1
    with pytest.raises(ValueError):
        mapping.snap(pts, nodes, eligible=F.lit(False))


def test_counters_take_the_edge_in_their_direction(spark):
    path = "array<struct<x:double,y:double>>"
    lines = spark.createDataFrame([("1-2", [(0.0, 0.0), (100.0, 0.0)], False), ("2-1", [(100.0, 0.0), (0.0, 0.0)], False)], f"id string, path {path}, oneway boolean")
    c = spark.createDataFrame([(1, 50.0, 1.0, 90.0, False), (2, 50.0, -1.0, 270.0, False), (3, 50.0, 1.0, 0.0, False), (4, 50.0, 90.0, 90.0, False), (5, 20.0, 1.0, 265.0, True)], "id long, x double, y double, bearing_deg double, both boolean")
    got = {r.left_id: (r.right_id, r.dist_along) for r in mapping.snap_counters(c, lines, bidirectional="both").collect()}
    assert got[1] == ("1-2", 50) and got[2] == ("2-1", 50) and got[3][0] is None and got[4][0] is None and got[5] == ("1-2", 20)


def test_bearings(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (0.0, 10.0), (30.0, 10.0)],)], "path array<struct<x:double,y:double>>")
    r = df.select(geo.bearing_at("path").alias("mid"), geo.bearing_at("path", F.lit(5.0)).alias("five"), geo.bearing_at("path", F.lit(99.0)).alias("end"), geo.angular_difference(F.lit(350.0), F.lit(10.0)).alias("d"), geo.angular_difference(F.lit(10.0), F.lit(170.0), undirected=True).alias("u")).first()
    assert tuple(r) == (90, 0, 90, 20, 20)


def test_radius_sums(spark):
    t, s = frame(spark, [(0, 0), (10, 0), (500, 0)]), frame(spark, [(1, 0), (2, 0), (3, 0), (9, 0), (11, 0)])
    assert {r.id: r.total for r in mapping.cross_sum(t, s, 5.0).collect()} == {0: 3, 1: 2, 2: 0}
    cells = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 3.0, 0.0, 0.0), (3, 100.0, 0.0, 7.0)], "id long, x double, y double, v double")
    assert {r.id: r.v_r3 for r in mapping.sum_within(cells, ["v"], 3.0).collect()} == {1: 5, 2: 5, 3: 7}
    filled = {r.id: r.v_r3_filled for r in mapping.sum_within(cells, ["v"], 3.0, densities=True, filled=True, areas=F.lit(1e6)).collect()}
    assert filled == {1: 5, 2: 5, 3: 7}
    with pytest.raises(ValueError):
        mapping.sum_within(cells, ["v"], 3.0, filled=True)


def test_great_circle(spark):
    d = spark.range(1).select(geo.great_circle(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)).alias("d")).first().d
    assert d == pytest.approx(math.pi / 2 * 6_371_008.8)
