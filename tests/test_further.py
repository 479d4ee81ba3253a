"""Callables along paths, consolidation in one call, endpoint terms, shaping, extracts, ring searches, written tables."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from odolith import session
from odolith.functions import geo, tags
from odolith.operators import calibrate, graph, mapping, reshape, routing
from odolith.operators.routing import NodeAggregation, PathAggregation
from odolith.sources import extracts, networks


def test_own_reductions_and_attributes_by_either_engine(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2, 1.0, 5.0), (2, 3, 2.0, None), (3, 4, 3.0, 7.0), (4, 5, 1.0, 2.0), (8, 9, 1.0, 1.0)], "u long, v long, w double, lanes double")
    g = routing.collapse(edges, "w", ["lanes"])
    nodes = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "node_id long, z double")
    pairs = spark.createDataFrame([("cells_to_cells", a, b) for a, b in ((1, 5), (1, 1), (2, 4), (5, 1), (1, 9), (77, 77))], "tier string, origin long, dest long")
    edge = [PathAggregation("first", "lanes", lambda v: v[0] if len(v) else -1.0), PathAggregation("heavy", F.col("weight") * 2, "max"), PathAggregation("turns", F.col("v") - F.col("u"))]
    node = [NodeAggregation("last_inner", "z", lambda v: v[-1] if len(v) else -1.0, include_endpoints=False), NodeAggregation("squares", F.col("z") * F.col("z"))]
    plain = lambda df: sorted([tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in df.collect()], key=repr)
    run = lambda: plain(routing.tiered_aggregate(pairs, g, nodes=nodes, edge_aggregations=edge, node_aggregations=node))
    got = run()
    by = {r[1:3]: r[3:] for r in got}
    assert by[1, 5] == (7.0, 5.0, 6.0, 4.0, 4.0, 55.0) and by[2, 4] == (5.0, 7.0, 6.0, 2.0, 3.0, 29.0)
    assert by[1, 1] == (0.0, -1.0, "nan", 0.0, -1.0, 1.0) and by[77, 77][:2] == (0.0, -1.0) and by[5, 1][0] == by[1, 9][0] == math.inf
    monkeypatch.setattr(routing, "BROADCAST_EDGES", 1)
    assert run() == got
    weighted = routing.with_weight(edges, "x", lambda t: t["w"] * t["u"], ["w", "u"])
    assert {r.x for r in weighted.collect()} == {1.0, 4.0, 9.0, 4.0, 8.0}
    timed = edges.select(routing.edge_time(speed=F.lit(36.0), length="w", slowed={"lanes": -1.0}, added={"u": 2.0}, least_kph=3.6, most_kph=3.6).alias("t")).collect()
    assert [r.t for r in timed] == [3.0, 4.2, 9.0, 9.0, 17.0]


def test_consolidation_in_one_call(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, "x", 3), (2, 4.0, 0.0, "traffic_signals", 5), (3, 100.0, 0.0, "x", 1), (4, 0.0, 100.0, None, 1), (5, 200.0, 0.0, "x", 1), (6, None, None, "traffic_signals", 0)], "node_id long, x double, y double, highway string, level int")
    edges = spark.createDataFrame(
        [(1, 2, 0, 4.0, ["primary"], ["2"], False, "inner", None), (2, 3, 0, None, ["service", "primary"], ["2", "4"], False, "a", None), (1, 4, 0, 100.0, ["residential"], [], True, "b", None), (3, 5, 0, 100.0, ["road"], ["1"], True, "c", "roundabout")],
        "u long, v long, k int, length double, highway array<string>, lanes array<string>, oneway boolean, name string, junction string",
    )
    merged, links = graph.consolidated_network(nodes, edges, 5.0, roundabout=F.col("junction") == "roundabout", buffer=60.0, node_aggregates={"level": "max"})
    n = {r.node_id: r for r in merged.collect()}
    assert set(n) == {1, 3, 4, 5, 6} and (n[1].x, n[1].parts, n[1].level, n[1].highway) == (2.0, 2, 5, ["traffic_signals", "x"])
    assert (n[1].degree, n[1].max_highway_rank, n[1].min_highway_rank, n[1].is_traffic_signal) == (2, 5, 2, 1)
    assert n[3].is_roundabout + n[5].is_roundabout == 1 and n[3].is_traffic_signal == 0 and n[6].degree == 0 and n[6].max_highway_rank == -1
    e = {(r.u, r.v): r for r in links.collect()}
    assert "name" not in links.columns and set(e) == {(1, 3), (1, 4), (3, 5)}
    assert (e[1, 3].highway, e[1, 3].lanes, e[1, 3].lanes_per_direction, e[1, 3].length) == ("primary", "3.0", 1.5, 98.0) and e[1, 4].lanes_per_direction == 1.0


def test_loops_count_as_neighbours(spark):
    e = spark.createDataFrame([(1, 1, "primary"), (1, 2, None), (1, 3, "track")], "u long, v long, highway string")
    got = {r.node: (r.degree, r.is_degree_3, r.max_highway_rank, r.min_highway_rank) for r in graph.junctions(e).collect()}
    assert got == {1: (3, 1, 5, -1), 2: (1, 0, -1, -1), 3: (1, 0, -1, -1)}


def test_calibration_with_endpoint_terms(spark):
    r = random.Random(3)
    nodes = [(i, 100.0 * i, 0.0, float(i % 3)) for i in range(31)]
    edges = [(u, v, 100.0, 36.0) for i in range(30) for u, v in ((i, i + 1), (i + 1, i))]
    legs = []
    for t in range(200):
        a, b = sorted(r.sample(range(31), 2))
        legs.append((t, 100.0 * a, r.uniform(0, 9), 100.0 * b, 0.0, 20 + 12.0 * (b - a) + 4.0 * (a % 3) + 7.0 * (b % 3) + r.gauss(0, 0.5)))
    got = calibrate.calibrate(
        spark.createDataFrame(edges, "u long, v long, length double, speed_kph double"), spark.createDataFrame(nodes, "node_id long, x double, y double, crowd double"),
        spark.createDataFrame(legs, "trip_id long, orig_x double, orig_y double, dest_x double, dest_y double, time_measured double"), endpoints=["crowd"], iterations=1, max_snap=20.0,
    )
    coef = dict(zip(got.fit.names, got.fit.coefficients, strict=True))
    assert got.fit.names == ["const", "baseline_time", "crowd_orig", "crowd_dest"]
    assert coef["crowd_orig"] == pytest.approx(4, abs=0.3) and coef["crowd_dest"] == pytest.approx(7, abs=0.3) and got.alpha == pytest.approx(1.2, abs=0.02) and got.endpoints["crowd"] == pytest.approx(5.5, abs=0.3)
    with pytest.raises(ValueError):
        calibrate.calibrate(spark.createDataFrame(edges, "u long, v long, length double, speed_kph double"), spark.createDataFrame(nodes, "node_id long, x double, y double, crowd double"), spark.createDataFrame(legs[:1], "trip_id long, orig_x double, orig_y double, dest_x double, dest_y double, time_measured double"), min_line=1e9)


def test_shaping(spark):
    df = spark.createDataFrame([("m", "a", 1.0), ("m", "a", 2.0), ("m", "b", math.nan), ("n", "c", 5.0), (None, "b", 4.0)], "k string, sector string, v double")
    assert {tuple(r) for r in reshape.wide_sums(df, ["k"], "sector", ["a", "b"], "v").collect()} == {("m", 3.0, 0.0), ("n", 0.0, 0.0), (None, 0.0, 4.0)}
    units = spark.createDataFrame([(1, "A", 1.0), (2, "A", 3.0), (3, "B", 0.0), (4, "C", 5.0), (5, "A", None)], "id int, g string, jobs double")
    totals = spark.createDataFrame([("A", 100.0, 0.5), ("B", 10.0, 1.0)], "g string, jobs double, share double")
    assert {(r.id, r.jobs) for r in reshape.rescaled(units, totals, "g", ["jobs"], share="share").collect()} == {(1, 12.5), (2, 37.5), (3, 0.0), (4, 0.0), (5, 0.0)}
    assert {r.id for r in reshape.all_ids(units.select("id"), units.filter("id > 3").select("id"), name="id").collect()} == {1, 2, 3, 4, 5}


def test_area_inside_a_convex_region(spark):
    shapes = ["POLYGON ((0 0, 10 0, 10 10, 5 2, 0 10, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))", "POLYGON ((20 20, 30 20, 30 30, 20 20))", "POLYGON EMPTY", "MULTIPOLYGON (((2 2, 2 4, 4 4, 4 2, 2 2)), ((6 6, 8 6, 8 8, 6 8, 6 6)))"]
    region = [(1.0, -1.0), (7.0, 1.0), (8.0, 7.0), (3.0, 9.0)]
    df = spark.createDataFrame(list(enumerate(shapes)), "id int, wkt string").withColumn("rings", geo.rings_of_wkt("wkt"))
    got = {r.id: (r.area_inside, r.inside_ratio) for r in reshape.inside_ratio(df, "rings", region).collect()}
    assert set(got) == {0, 3}

    def within(x, y, rings):
        hit = np.zeros(len(x), bool)
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                with np.errstate(divide="ignore", invalid="ignore"):
                    hit ^= ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) / (y2 - y1) * (x2 - x1))
        return hit

    at = (np.arange(2000) + 0.5) / 200
    x, y = (a.ravel() for a in np.meshgrid(at, at))
    inside = within(x, y, [region])
    for i, rings in ((0, [[(0, 0), (10, 0), (10, 10), (5, 2), (0, 10)], [(1, 1), (1, 2), (2, 2), (2, 1)]]), (3, [[(2, 2), (2, 4), (4, 4), (4, 2)], [(6, 6), (8, 6), (8, 8), (6, 8)]])):
        shape = within(x, y, rings)
        assert got[i][0] == pytest.approx((shape & inside).sum() / 200**2, abs=0.05) and got[i][1] == pytest.approx((shape & inside).sum() / shape.sum(), abs=0.005)


def test_extracts(spark):
    pois = spark.createDataFrame([(1, "bakery", 5.0, 5.0, None), (2, "bakery", 1.5, 1.5, None), (3, "bakery", None, None, "POLYGON ((6 6, 8 6, 8 8, 6 8, 6 6))"), (4, "bakery", 50.0, 5.0, None), (5, None, 5.0, 5.0, None), (5, None, 5.0, 5.0, None)], "id int, shop string, x double, y double, wkt string")
    region = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]
    got = extracts.pois_within(pois, region, {"food": (("shop:bakery", 2.0),)}, geometry="wkt")
    assert {(r.id, r.x, r.food_weight) for r in got.collect()} == {(1, 5.0, 2.0), (3, 7.0, 2.0)}
    nodes, edges = spark.createDataFrame([(1, 5.0, 5.0), (2, 6.0, 6.0), (3, 60.0, 6.0)], "node_id int, x double, y double"), spark.createDataFrame([(1, 2), (2, 3)], "u int, v int")
    assert [tuple(r) for r in extracts.network_within(nodes, edges, region)[1].collect()] == [(1, 2)] and extracts.within(nodes, []).count() == 0
    at = spark.range(1).select(extracts.web_mercator(F.lit(180.0), F.lit(45.0)).alias("p")).first().p
    assert at.x == pytest.approx(20037508.34, abs=0.01) and at.y == pytest.approx(5621521.49, abs=0.01)


def test_scores_of_streets(spark):
    df = spark.createDataFrame([("cycleway", None, None), ("primary", None, None), ("primary", None, "track"), ("residential", None, "lane"), ("motorway", "designated", None), (None, None, None), ("living_street", None, None), ("tertiary", None, "")], "h string, b string, c string")
    assert [r[0] for r in df.select(tags.bike_score("h", bicycle=F.col("b"), cycleway=F.col("c"))).collect()] == [5, 1, 3, 5, 5, 4, 5, 3]
    assert [r[0] for r in df.select(tags.highway_tier("h")).collect()] == ["local", "main", "main", "local", "highway", "local", "local", "main"]
    assert df.select(tags.road_class(tags.first_of(F.array("h")), {"primary": 1.0})).first()[0] == 3.0


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("1", 1.5, 2.0, 5, 0, "a & <b>"), ("2", None, 0.0, -1, 1, None)], "node_id string, x double, y double, max_highway_rank int, is_roundabout int, note string")
    edges = spark.createDataFrame([("1", "2", 1, 7.5, 0.5, True), ("2", "1", 0, None, 1.0, False)], "u string, v string, k long, length double, density_norm double, oneway boolean")
    networks.write_graphml(nodes, edges, str(tmp_path / "g"))
    n, e = networks.read_graphml(spark, str(tmp_path / "g"))
    assert {tuple(r) for r in n.select(nodes.columns).collect()} == {tuple(r) for r in nodes.collect()}
    assert {tuple(r) for r in e.select(edges.columns).collect()} == {tuple(r) for r in edges.collect()}


def test_ring_searches_with_an_outlier_and_a_long_line(spark):
    r = random.Random(6)
    base = [(i, r.uniform(0, 1000), r.uniform(0, 1000)) for i in range(3000)] + [(3000, 5e7, 5e7)] + [(4000 + i, 500.0 + i * 1e-4, 500.0) for i in range(3000)]
    asked = [(i, r.uniform(0, 1000), r.uniform(0, 1000)) for i in range(500)] + [(500, 4e7, 4e7)]
    began = time.time()
    got = {x.left_id: (x.right_id, x.distance) for x in mapping.nearest(spark.createDataFrame(asked, "id long, x double, y double"), spark.createDataFrame(base, "id long, x double, y double")).collect()}
    b = np.array([(x, y) for _, x, y in base])
    for i, x, y in asked:
        d = np.hypot(b[:, 0] - x, b[:, 1] - y)
        assert got[i][1] == pytest.approx(d.min()) and d[[k for k, (n, *_) in enumerate(base) if n == got[i][0]][0]] == pytest.approx(d.min())
    line = spark.createDataFrame([("long", [(float(i), math.sin(i / 50)) for i in range(10_000)])], "id string, path array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(i, i * 20.0 + 0.5, 3.0) for i in range(490)], "id long, x double, y double")
    near = mapping.points_to_lines(pts, line.unionByName(line), 10.0, accept=geo.bearing_at("line_path", "dist_along") < 180).collect()
    assert len(near) == 490 and all(x.right_id == "long" and abs(x.dist_along - (x.left_id * 20.0 + 0.5)) < 10 + x.left_id * 0.01 for x in near)
    assert time.time() - began < 150


def test_regions_find_their_nearest_point_one_far_away(spark):
    polys = spark.createDataFrame([("near", "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"), ("far", "POLYGON ((900000 0, 900001 0, 900001 1, 900000 1, 900000 0))"), ("holds", "POLYGON ((10 10, 20 10, 20 20, 10 20, 10 10))")], "k string, wkt string")
    from odolith.operators import proximity

    pts = spark.createDataFrame([(i, 3.0 + i * 0.01, 0.5) for i in range(2000)] + [(9999, 15.0, 15.0)], "id long, x double, y double")
    got = {r.left_id: (r.right_id, r.distance) for r in mapping.regions_to_points(proximity.regions(polys, "k", "wkt"), pts).collect()}
    assert got["holds"] == (9999, None) and got["near"] == (0, pytest.approx(2.0)) and got["far"] == (1999, pytest.approx(900000 - 22.99))
    some = {r.left_id: r.right_id for r in mapping.regions_to_points(proximity.regions(polys, "k", "wkt"), pts, max_distance=100.0).collect()}
    assert some == {"holds": 9999, "near": 0, "far": None}


def test_written_tables_can_be_given_back(spark, tmp_path):
    a = session.settled(spark.range(5))
    path = a._odolith_path.removeprefix("file://")
    from pathlib import Path

    assert Path(path).exists()
    session.release(a, None, a)
    assert not Path(path).exists()
    b = session.settled(spark.range(5))
    path = b._odolith_path.removeprefix("file://")
    session.clear(spark)
    assert not Path(path).exists()
