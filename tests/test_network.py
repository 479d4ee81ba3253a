import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from odolith.operators import calibrate, flows, graph, grid, plotdata, poi, proximity, raster
from odolith.sources import networks
from odolith.streaming import counts


def test_junctions_and_edge_aggregates(spark):
    e = spark.createDataFrame([(0, 1, 0, "primary", 5.0), (0, 2, 0, "residential", None), (0, 3, 0, "residential", 2.0), (0, 4, 0, "odd", math.nan), (4, 0, 1, "trunk", 1.0), (1, 2, 0, None, 3.0)], "u long, v long, k int, highway string, w double")
    got = {r.node: r for r in graph.junctions(e).collect()}
    assert (got[0].degree, got[0].is_degree_4, got[0].is_degree_3, got[0].max_highway_rank, got[0].min_highway_rank) == (4, 1, 0, 6, -1)
    assert {r.node: r.value for r in graph.edges_to_nodes(e, "w", "sum").collect()} == {0: 8, 1: 8, 2: 3, 3: 2, 4: 1}
    nodes = spark.createDataFrame([(0, 1.0), (1, 3.0)], "node_id long, s double")
    assert {(r.u, r.v, r.k): r.s for r in graph.nodes_to_edges(e, nodes, ["s"], "mean").collect()}[0, 1, 0] == 2
    listed = spark.createDataFrame([(0, 1, 0, "0, 1")], "u long, v long, k int, rel string")
    assert graph.nodes_to_edges(listed, nodes, ["s"], relation="rel").first().s == 4


def test_filled_attribute(spark):
    e = spark.createDataFrame([(0, 1, 0), (1, 2, 0)], "u long, v long, k int")
    v = spark.createDataFrame([(0, 1, 0, 7.0)], "u long, v long, k int, flow double")
    assert sorted(r.flow for r in graph.fill_attribute(e, v, "flow").collect()) == [0, 7]
    with pytest.raises(ValueError):
        graph.fill_attribute(e.limit(0), v, "flow", strict=True)


def test_components_against_brute_force(spark):
    r = random.Random(4)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    parent = {i: i for i in range(400)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = graph.components(spark.createDataFrame(pairs, "left_id long, right_id long"), spark.range(400))
    assert {x.id: x.component for x in got.collect()} == {i: root(i) for i in range(400)}


def test_consolidation(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 3.0, 0.0, 1), (3, 6.0, 0.0, 0), (4, 100.0, 0.0, 0), (5, None, None, 0)], "node_id long, x double, y double, signal int")
    edges = spark.createDataFrame([(1, 1, 2, 3.0), (2, 3, 4, 94.0), (3, 1, 4, None), (4, 4, 5, 50.0)], "edge_id long, u long, v long, length double")
    merged, keyed = graph.consolidate(nodes, edges, 2.0, node_max=["signal"])
    assert {(r.node_id, r.x, r.parts, r.signal) for r in merged.collect()} == {(1, 3.0, 3, 1), (4, 100.0, 1, 0), (5, None, 1, 0)}
    assert {(r.u, r.v, r.k, r.length) for r in keyed.collect()} == {(1, 4, 0, 94.0), (1, 4, 1, 97.0), (4, 5, 0, 50.0)}


def test_obstacles(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, ["signal", "x"]), (2, 10.0, 0.0, []), (3, 50.0, 0.0, None)], "node_id long, x double, y double, tags array<string>")
    edges = spark.createDataFrame([(1, 2, True), (2, 3, False)], "u long, v long, r boolean")
    places = graph.obstacles(nodes, {"tags": "signal"}, edges=edges, roundabout=F.col("r"))
    assert {(r.kind, r.x) for r in places.collect()} == {("tags:signal", 0.0), ("roundabout", 5.0)}
    flagged = graph.flag_obstacles(nodes.select("node_id", "x", "y"), spark.createDataFrame([(48.0, 0.0), (200.0, 0.0)], "x double, y double"), 5.0, "flag")
    assert {r.node_id: r.flag for r in flagged.collect()} == {1: 0, 2: 0, 3: 1}


def test_poi_categories(spark):
    p = spark.createDataFrame([(1, "school", None), (2, None, "bakery"), (3, "bench", None), (4, "school", "bakery")], "osm_id long, amenity string, shop string")
    c = {"food": [("shop:bakery", 2.0), ("tourism:x", 1.0)], "school": [("amenity:school", 1.0)]}
    assert {(r.osm_id, r.food, r.food_weight, r.school) for r in poi.categorize(p, c).collect()} == {(1, 0, 0.0, 1), (2, 1, 2.0, 0), (4, 1, 2.0, 1)}
    assert poi.categorize(p, c, drop_unmatched=False).count() == 4
    assert {r.key: r["values"] for r in poi.tag_query(spark, c).collect()} == {"shop": ["bakery"], "tourism": ["x"], "amenity": ["school"]}
    with pytest.raises(ValueError):
        poi.categorize(p, {"shop": [("shop:bakery", 1.0)]})
    with pytest.raises(ValueError):
        poi.tag_query(spark, {"a": [("nocolon", 1.0)]})


def test_raster(spark):
    px = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, 7.0), (0, 2, -9.0)], "row int, col int, value double")
    g = raster.Grid(0.0, 20.0, 10.0, 10.0, nodata=-9.0)
    pts = spark.createDataFrame([(1, 10.0, 10.0), (2, 5.0, 15.0), (3, 25.0, 15.0), (4, 100.0, 0.0), (5, None, 1.0), (6, 20.0, 15.0)], "id long, x double, y double")
    got = {r.id: r.value for r in raster.sample(pts, px, g).collect()}
    assert got[1] == 4 and got[2] == 1 and all(math.isnan(got[i]) for i in (3, 4, 5, 6))
    near = {r.id: r.value for r in raster.sample(pts, px, g, method="nearest").collect()}
    assert near[1] == 7 and near[2] == 1 and math.isnan(near[3])
    assert {r.name for r in raster.tiles(spark, -0.5, 46.2, 1.5, 47.0).collect()} == {"N46_W001", "N46_E000", "N46_E001"}


def test_grids(spark):
    square = proximity.regions(spark.createDataFrame([("a", "POLYGON ((0 0, 100 0, 100 100, 0 100, 0 0))")], "id string, g string"), "id", "g")
    cells = grid.square(square, 10.0, nest=5)
    assert cells.count() == 100 and cells.select("zone_id").distinct().count() == 4
    hexes = grid.hexagonal(square, 5.0)
    assert abs(hexes.count() * 1.5 * 3**0.5 * 25 / 10_000 - 1) < 0.1


def test_sampling_follows_weights_and_repeats(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(1, 5)] + [(1, 9, 0.0), (1, 10, math.nan)], "g int, item long, s double")
    draws = spark.range(4000).select(F.lit(1).alias("g"), F.col("id").alias("draw"), flows.uniform(3, F.col("id")).alias("r"))
    got = flows.weighted_draws(rows, ["g"], "item", "s", draws)
    n = {r.item: r["count"] for r in got.groupBy("item").count().collect()}
    assert sum(n.values()) == 4000 and set(n) == {1, 2, 3, 4} and all(abs(n[i] / 4000 - i / 10) < 0.04 for i in n)
    assert got.exceptAll(flows.weighted_draws(rows, ["g"], "item", "s", draws)).isEmpty()


def test_nested_sample(spark):
    od = spark.createDataFrame([("cells_to_cells", 1, 1, 0.0, 1.0), ("cells_to_cells", 1, 2, 5.0, 1.0), ("cells_to_zones", 1, 3, 9.0, 1e6), ("zones_to_zones", 100, 4, 9.0, 1.0)], "tier string, origin long, dest long, cost double, w double")
    home = spark.createDataFrame([(1, 100)], "origin long, zone_origin long")
    starts = spark.createDataFrame([(1, 1.0), (2, 0.0)], "origin long, w double")
    got = flows.nested_sample(od, "w", home, starts, lambda c: F.exp(-c / 10), 50, 200, seed=1)
    assert got.count() == 200 and got.filter("dest = 3").count() > 190
    masked = flows.nested_sample(od, "w", home, starts, lambda c: F.exp(-c / 10), 50, 200, seed=1, mask=F.col("tier") != "cells_to_zones")
    assert {r.dest for r in masked.select("dest").distinct().collect()} == {1, 2, 4}


def test_counts_comparison(spark):
    m = spark.createDataFrame([(1, 2, 0, 10.0), (2, 3, 0, 20.0), (3, 4, 0, 35.0), (9, 9, 0, 1.0)], "u long, v long, k int, flow double")
    c = m.withColumnRenamed("flow", "observed")
    r = flows.compare_counts(m, c).first()
    assert (r.n, r.slope, r.rmse) == (4, 1, 0) and r.r2 == pytest.approx(1)
    assert flows.compare_counts(m, c.withColumn("observed", F.col("observed") * 3)).first().r2 == pytest.approx(1)
    assert flows.compare_counts(m, c.limit(0)).first().n == 0


def test_least_squares_against_numpy(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 2))
    y = 3 + x @ [2, -1] + r.normal(size=200)
    df = spark.createDataFrame([(1.0, float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(1.0, math.nan, 1.0, 1.0)], "one double, a double, b double, y double")
    fit = calibrate.least_squares(df, "y", ["one", "a", "b"])
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert np.allclose(fit.coefficients, want) and fit.n == 200 and (fit.p_values < 1e-6).all()
    assert calibrate._beta_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and calibrate._beta_tail(0.5, 3) == pytest.approx(0.6513, abs=1e-3)
    with pytest.raises(ValueError):
        calibrate.least_squares(df.withColumn("c", F.col("a") * 2), "y", ["a", "c"])


def test_calibration_recovers_planted_coefficients(spark):
    r = random.Random(7)
    n = 40
    slow = [float(r.random() < 0.5) for _ in range(n)]
    nodes = spark.createDataFrame([(i, 100.0 * i, 0.0) for i in range(n + 1)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(u, v, 100.0, 36.0, slow[i]) for i in range(n) for u, v in ((i, i + 1), (i + 1, i))], "u long, v long, length double, speed_kph double, slow double")
    legs = []
    for t in range(150):
        a, b = sorted(r.sample(range(n + 1), 2))
        time = sum(10 * (1 + 5 * slow[i]) for i in range(a, b)) + r.gauss(0, 3)
        legs.append((t, 100.0 * a, 0.0, 100.0 * b, 1.0, time))
    legs = spark.createDataFrame(legs, "trip_id long, orig_x double, orig_y double, dest_x double, dest_y double, time_measured double")
    got = calibrate.calibrate(edges, nodes, legs, factors=["slow"], iterations=2, max_snap=50.0, of="baseline")
    assert got.alpha == pytest.approx(1, abs=0.1) and got.factors["slow"] == pytest.approx(5, abs=0.5) and got.fit.r2 > 0.99
    assert calibrate.rmse_by_distance(got.predictions).filter("n > 0").count() == 1 and len(got.log) == 2
    assert got.edges.agg(F.min("duration")).first()[0] > 0


def test_plot_tables(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    v = spark.createDataFrame([("a", -math.inf), ("b", 4.0)], "cell_id string, v double")
    assert {(r.cell_id, r.value, r.least, r.greatest) for r in plotdata.cell_values(cells, v, "v").collect()} == {("a", None, 4.0, 4.0), ("b", 4.0, 4.0, 4.0)}
    assert {(r.cell_id, r.value_a, r.value_b) for r in plotdata.cell_comparison(cells, v, v, "v").collect()} == {("a", None, None), ("b", 4.0, 4.0)}
    od = spark.createDataFrame([("cells_to_cells", "x", "y"), ("zones_to_zones", "Z", "W"), ("cells_to_cells", "q", "r")], "tier string, origin string, dest string")
    home = spark.createDataFrame([("x", "Z")], "origin string, zone_origin string")
    assert {tuple(r) for r in plotdata.destinations_of(od, "x", home).collect()} == {("cells_to_cells", "y"), ("zones_to_zones", "W")}


def test_graphml_and_sinks(spark, tmp_path):
    (tmp_path / "g.graphml").write_text("""<?xml version='1.0'?><graphml><key id="d0" for="node" attr.name="x" attr.type="string"/><key id="d1" for="node" attr.name="is_degree_3" attr.type="string"/><key id="d2" for="edge" attr.name="length" attr.type="string"/>
<graph edgedefault="directed"><node id="1"><data key="d0">1.5</data><data key="d1">1.0</data></node><node id="2"><data key="d0">bad</data></node><edge source="1" target="2" id="0"><data key="d2">7</data></edge></graph></graphml>""")
    nodes, edges = networks.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {(r.node_id, r.x, r.is_degree_3) for r in nodes.collect()} == {("1", 1.5, 1), ("2", None, None)}
    assert [(r.u, r.v, r.k, r.length) for r in edges.collect()] == [("1", "2", 0, 7.0)]
    od = spark.createDataFrame([("cells_to_cells", 1, 2, 3.0), ("zones_to_zones", 1, 2, 4.0)], "tier string, origin long, dest long, cost double")
    networks.write_pairs(od, str(tmp_path / "od"))
    assert networks.read_pairs(spark, str(tmp_path / "od")).filter("tier = 'zones_to_zones'").first().cost == 4
    networks.write_csv(od, str(tmp_path / "csv"))
    assert networks.read_csv(spark, str(tmp_path / "csv"), "tier string, origin long, dest long, cost double").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(1, f"2024-01-0{1 + i % 5} 0{i % 9}:00:00", "ab"[i % 2], float(i)) for i in range(50)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    last = spark.createDataFrame([(0, "2024-03-01 00:00:00", "a", 0.0)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = counts.windowed(counts.read(spark, str(tmp_path / "in"), events.schema))
    q = counts.write(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and got <= {tuple(r) for r in counts.windowed(events).collect()} and len(got) == counts.windowed(events).count()
