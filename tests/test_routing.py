import math
import random

import pytest
from pyspark.sql import functions as F

from odolith.operators import overhead, routing, utility
from odolith.operators.routing import NodeAggregation, PathAggregation


@pytest.fixture(scope="module")
def triangle(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, 10.0), ("b", "c", 2.0, 20.0), ("a", "c", 10.0, 100.0)], "u string, v string, w double, attr double")
    return routing.collapse(edges, "w", ["attr"], directed=False)


def ask(spark, *pairs):
    return spark.createDataFrame([("cells_to_cells", a, b) for a, b in pairs], "tier string, origin string, dest string")


def by_dest(df):
    return {r.dest: r for r in df.collect()}


def test_costs_and_sums_from_either_end(spark, triangle):
    got = by_dest(routing.tiered_aggregate(ask(spark, ("a", "a"), ("a", "b"), ("a", "c"), ("a", "z")), triangle, edge_aggregations=[PathAggregation("s", "attr"), PathAggregation("m", "attr", "max")]))
    assert [got[d].cost for d in "abc"] == [0, 1, 3] and [got[d].s for d in "abc"] == [0, 10, 30]
    assert math.isnan(got["a"].m) and got["c"].m == 20
    assert got["z"].cost == math.inf and math.isnan(got["z"].s)
    back = by_dest(routing.tiered_aggregate(ask(spark, ("c", "a")), triangle, edge_aggregations=[PathAggregation("s", "attr")]))
    assert back["a"].cost == 3 and back["a"].s == 30


def test_cutoff_and_mask(spark, triangle):
    pairs = ask(spark, ("a", "b"), ("a", "c"))
    assert by_dest(routing.tiered_costs(pairs, triangle, cutoff=2.0))["c"].cost == math.inf
    assert by_dest(routing.tiered_costs(pairs, triangle, cutoff=3.0))["c"].cost == 3
    masked = by_dest(routing.tiered_costs(pairs.withColumn("ok", F.col("dest") == "b"), triangle, mask="ok"))
    assert masked["b"].cost == 1 and masked["c"].cost == math.inf


def test_nodes_along_the_path(spark, triangle):
    nodes = spark.createDataFrame([("a", 5), ("b", 1), ("c", 7)], "node_id string, signal int")
    aggs = [NodeAggregation("all", "signal"), NodeAggregation("inside", "signal", include_endpoints=False)]
    got = by_dest(routing.tiered_aggregate(ask(spark, ("a", "c"), ("a", "a")), triangle, nodes=nodes, node_aggregations=aggs))
    assert (got["c"].all, got["c"].inside, got["a"].all, got["a"].inside) == (13, 1, 5, 0)


def test_parallel_edges_collapse_to_the_lightest(spark):
    edges = spark.createDataFrame([("a", "b", 0, 5.0, 10.0), ("a", "b", 1, 1.0, 99.0), ("a", "b", 2, math.nan, 1.0), ("b", "b", 0, 0.0, 0.0)], "u string, v string, k int, w double, attr double")
    g = routing.collapse(edges, "w", ["attr"])
    assert [tuple(r) for r in g.collect()] == [("a", "b", 1.0, 1, 99.0)]


def test_given_paths(spark, triangle):
    paths = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, ["a"]), (4, ["a", "q"])], "id int, path array<string>")
    got = {r.id: r for r in routing.along_paths(paths, "id", triangle, edge_aggregations=[PathAggregation("s", "attr")]).collect()}
    assert (got[1].cost, got[1].s, got[3].cost, got[3].s) == (3, 30, 0, 0)
    assert got[2].cost == got[4].cost == math.inf and math.isnan(got[2].s)


def test_both_engines_agree_with_brute_force(spark):
    r = random.Random(1)
    edges = [(r.randrange(30), r.randrange(30), float(r.randint(1, 9))) for _ in range(70)]
    g = routing.collapse(spark.createDataFrame(edges, "u long, v long, w double"), "w")
    d = {(i, j): 0.0 if i == j else math.inf for i in range(30) for j in range(30)}
    for u, v, w in edges:
        if u != v:
            d[u, v] = min(d[u, v], w)
    for k in range(30):
        for i in range(30):
            for j in range(30):
                d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    origins = spark.range(5).select(F.col("id").alias("origin"))
    far = {(r.origin, r.node): r.cost for r in routing.relax(origins, g, cutoff=15.0).collect()}
    near = {(r.origin, r.dest): r.cost for r in routing.search(origins.crossJoin(spark.range(30).select(F.col("id").alias("dest"))), g, cutoff=15.0).collect()}
    for i in range(5):
        for j in range(30):
            want = d[i, j] if d[i, j] <= 15 else math.inf
            assert near[i, j] == want and far.get((i, j), math.inf) == want


def test_trips_and_flows(spark):
    edges = spark.createDataFrame([(u, v, 100.0, 5.0, s) for u, v, s in ((1, 2, 1.0), (2, 3, None), (3, 4, 0.0))], "u long, v long, length double, t double, slow double")
    g = routing.collapse(edges, "t", ["length", "slow"])
    trips = spark.createDataFrame([(7, 1, 4), (8, 1, 3), (9, 4, 1)], "trip_id long, origin long, dest long")
    got = {r.trip_id: r for r in routing.trip_metrics(trips, g, features={"slow": "length_weighted"}).collect()}
    assert set(got) == {7, 8} and (got[7].cost, got[7].distance) == (15, 300) and got[8].slow == 0.5
    flow = {(r.u, r.v): r.flow for r in routing.betweenness(trips.select("origin", "dest").unionByName(trips.select("origin", "dest")), g).collect()}
    assert flow == {(1, 2): 4, (2, 3): 4, (3, 4): 2}
    with pytest.raises(ValueError):
        routing.trip_metrics(trips, g, features={"cost": "sum"})


def test_floor(spark):
    df = spark.createDataFrame([("cells_to_cells", "a", 1, 0.0), ("cells_to_cells", "a", 2, 200.0), ("cells_to_cells", "a", 3, math.inf), ("zones_to_zones", "Z", 1, 5.0)], "tier string, origin string, dest int, cost double")
    assert sorted(r.cost for r in routing.floor_within_zone(df, 10.0).collect()) == [5, 10, 200, math.inf]
    table = df.sparkSession.createDataFrame([("b", 10.0)], "origin string, floor double")
    assert sorted(r.cost for r in routing.floor_within_zone(df, table).collect()) == [0, 5, 200, math.inf]


def test_utility(spark, triangle):
    u = utility.Utility(cost_coefficient=-2, route=(utility.RouteFeature(-0.1, PathAggregation("s", "attr")),))
    got = by_dest(utility.route_utility(ask(spark, ("a", "a"), ("a", "b"), ("a", "c"), ("a", "z")), triangle, u))
    assert [got[d].utility for d in "abc"] == [0, -3, -9] and math.isnan(got["z"].utility)
    cells = spark.createDataFrame([("1", "a", 100.0, 10.0), ("2", "a", 300.0, 20.0), ("3", "b", 200.0, 30.0), ("4", "b", 0.0, 5.0)], "cell_id string, node_id string, density double, jobs double")
    full = utility.Utility(1.0, -2, origin={"density": 0.01}, dest={"jobs": 0.1})
    base = utility.route_utility(ask(spark, ("a", "b")), triangle, full)
    assert utility.add_endpoints(base, full, cells).first().utility == pytest.approx(1 - 2 + 2 + 3.5)


def test_overheads(spark, triangle, rows):
    cells = spark.createDataFrame([("1", "a", "Z", 0.0, 0.0, 10.0, 1.0), ("2", "a", "Z", 100.0, 0.0, 30.0, 9.0), ("3", None, "Z", 200.0, 0.0, 5.0, 1.0)], "cell_id string, node_id string, zone_id string, x double, y double, oh double, w double")
    assert rows(overhead.per_node(cells, "oh")) == [("a", 20.0)] and rows(overhead.per_node(cells, "oh", weight="w")) == [("a", 28.0)]
    zones = spark.createDataFrame([("Z", "b", 100.0, 0.0), ("W", "c", 0.0, 0.0)], "zone_id string, node_id string, x double, y double")
    got = {r.group: r.overhead for r in overhead.per_group_straight(cells, zones, 2.0).collect()}
    assert got["Z"] == pytest.approx(200 / 3 / 2) and math.isnan(got["W"])
    assert {r.group: r.overhead for r in overhead.per_group_routed(cells, zones, triangle).collect()}["Z"] == 1
    od = spark.createDataFrame([("cells_to_cells", "a", "b", 1.0), ("zones_to_zones", "a", "b", 5.0)], "tier string, origin string, dest string, cost double")
    table = spark.createDataFrame([("a", 10.0), ("b", 100.0)], "node string, overhead double")
    assert sorted(r.cost for r in overhead.add_node(od, origin=table, dest_zone=table).collect()) == [11, 115]
    assert sorted(r.cost for r in overhead.add_geo(od, origin_zone=table, dest_cell=table).collect()) == [15, 101]
    info = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "node_id string, v double")
    assert sorted(r.cost for r in overhead.add_trip(od, info, zone_info=info, origin=F.col("v"), dest=F.col("v") * 10).collect()) == [33, 37]
    with pytest.raises(Exception, match="not finite"):
        overhead.add_trip(od, info, dest=F.col("v")).collect()
