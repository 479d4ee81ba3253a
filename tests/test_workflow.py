"""The toy world from end to end: pairs, routes, values and metrics with hand-computed results."""

import pytest
from pyspark.sql import functions as F

from odolith.operators import metrics, od, routing
from odolith.session import settled

CELLS = [("A0", 0.0, 0.0, "a0", "ZA", 10.0), ("A1", 0.0, 1.0, "a1", "ZA", 20.0), ("B0", 3.0, 0.0, "b0", "ZB", 30.0), ("B1", 3.0, 1.0, "b1", "ZB", 40.0), ("C0", 10.0, 0.0, "c0", "ZC", 50.0), ("C1", 10.0, 1.0, "c1", "ZC", 60.0)]
ZONES = [("ZA", "a0", 0.0, 0.5, 30.0), ("ZB", "b0", 3.0, 0.5, 70.0), ("ZC", "c0", 10.0, 0.5, 110.0)]
EDGES = [("a0", "a1", 1.0), ("b0", "b1", 1.0), ("c0", "c1", 1.0), ("a0", "b0", 3.0), ("b0", "c0", 7.0)]
BINS = (metrics.Bin("short", 0, 5), metrics.Bin("medium", 5, 15), metrics.Bin("long", 15, 100))


@pytest.fixture(scope="module")
def world(spark):
    cells = spark.createDataFrame(CELLS, "cell_id string, x double, y double, node_id string, zone_id string, population double")
    zones = spark.createDataFrame(ZONES, "zone_id string, node_id string, x double, y double, population double")
    graph = routing.collapse(spark.createDataFrame(EDGES, "u string, v string, length double"), "length", directed=False)
    return cells, zones, graph


def dests(pairs, tier, origin):
    return {r.dest for r in pairs.filter((F.col("tier") == tier) & (F.col("origin") == origin)).collect()}


def test_pairs_routes_and_reach(world):
    cells, zones, graph = world
    pairs = settled(od.tiered_pairs(cells, zones, 2.0, 15.0, 5.0))
    assert dests(pairs, "cells_to_cells", "a0") == {"a0", "a1"}
    assert dests(pairs, "cells_to_zones", "a0") == dests(pairs, "cells_to_zones", "a1") == {"b0"}
    assert dests(pairs, "zones_to_zones", "a0") == dests(pairs, "zones_to_zones", "b0") == {"c0"}
    assert dests(pairs, "zones_to_zones", "c0") == {"a0", "b0"}
    costs = settled(routing.tiered_costs(pairs, graph))
    got = {(r.tier, r.origin, r.dest): r.cost for r in costs.collect()}
    assert got["cells_to_zones", "a0", "b0"] == 3 and got["zones_to_zones", "a0", "c0"] == 10
    valued = od.dest_values(costs, ["population"], cells, zones)
    home = od.cell_to_zone(cells, zones)
    reach = {r.origin: r for r in metrics.cumulative(metrics.stitched(valued, home), ["population"], BINS).collect()}
    assert (reach["a0"].short__population, reach["a0"].medium__population, reach["a0"].long__population) == (100, 110, 0)
    assert (reach["c0"].short__population, reach["c0"].medium__population) == (110, 100)
    assert all(r.short__population + r.medium__population + r.long__population == 210 for r in reach.values())


def test_masks_limit_either_side(world):
    cells, zones, _ = world
    pairs = settled(od.tiered_pairs(cells, zones, 2.0, 15.0, 5.0, origins=F.col("cell_id") == "A0", destinations=F.col("population") > 15))
    assert dests(pairs, "cells_to_cells", "a0") == {"a1"}
    assert {r.origin for r in pairs.collect()} == {"a0"}


def test_radii_are_checked(world):
    with pytest.raises(ValueError):
        od.radii(5, 4)
    assert od.radii(1, 5) == (1, 5, 5) and od.radii(1, 50) == (1, 10, 50)


def test_cell_pairs_are_strict_and_averaged(spark, rows):
    cells = spark.createDataFrame([("C0", 0.0, 0.0, "N0"), ("C1", 0.0, 2.0, "N0"), ("C2", 1.0, 1.0, "N1"), ("C3", 2.0, 1.0, "N2"), ("C4", None, 1.0, "N3"), ("C5", 0.0, 0.0, None)], "cell_id string, x double, y double, node_id string")
    assert rows(od.cell_pairs(cells, 1.0).select("origin", "dest")) == [("N0", "N0"), ("N1", "N1"), ("N2", "N2")]
    assert ("N0", "N1") in rows(od.cell_pairs(cells, 1.01).select("origin", "dest"))


def test_shared_nodes_are_summed(spark, rows):
    cells = spark.createDataFrame([("C0", "N0", 10.0), ("C1", "N0", 20.0), ("C2", "N1", 30.0), ("C3", None, 5.0)], "cell_id string, node_id string, population double")
    pairs = spark.createDataFrame([("cells_to_cells", "N0", "N0"), ("cells_to_cells", "N0", "N1"), ("cells_to_cells", "N0", "N9")], "tier string, origin string, dest string")
    assert rows(od.dest_values(pairs, ["population"], cells).select("dest", "population")) == [("N0", 30.0), ("N1", 30.0), ("N9", None)]
    with pytest.raises(Exception, match="no unit at node"):
        od.node_values(cells, "population", pairs.select("dest").distinct()).collect()


def test_lift_to_units(spark, rows):
    cells = spark.createDataFrame([("C0", "N0", 30.0), ("C1", "N0", 60.0), ("C2", "N1", 45.0), ("C3", "N2", 90.0)], "cell_id string, node_id string, oh double")
    zones = spark.createDataFrame([("Z0", "ZN0"), ("Z1", "ZN1")], "zone_id string, node_id string")
    pairs = spark.createDataFrame([("cells_to_cells", "N0", "N1", 100.0), ("cells_to_zones", "N1", "ZN1", 180.0), ("zones_to_zones", "ZN0", "ZN1", 300.0)], "tier string, origin string, dest string, cost double")
    assert rows(od.to_geo_units(pairs, cells, zones)) == [("cells_to_cells", "C0", "C2", 100.0), ("cells_to_cells", "C1", "C2", 100.0), ("cells_to_zones", "C2", "Z1", 180.0), ("zones_to_zones", "Z0", "Z1", 300.0)]


def test_modes(spark, rows):
    m = [("walk", "A", "X", 100.0), ("walk", "A", "Y", 200.0), ("car", "A", "X", 50.0), ("car", "A", "Z", 100.0)]
    df = spark.createDataFrame([(a, "cells_to_cells", o, d, c) for a, o, d, c in m], "mode string, tier string, origin string, dest string, cost double")
    assert rows(od.across_modes(df).select("dest", "cost")) == [("X", 50.0), ("Y", 200.0), ("Z", 100.0)]
    import math

    two = spark.createDataFrame([(n, "cells_to_cells", "A", "X", 20.0) for n in ("a", "b")], "mode string, tier string, origin string, dest string, cost double")
    assert od.across_modes(two, "logsum", scale=5.0).first().cost == pytest.approx(20 - 5 * math.log(2))
    both = od.across_modes(df, lambda c: c["walk"] + c["car"], names=["walk", "car"])
    assert {r.dest: r.cost for r in both.collect()} == {"X": 150.0, "Y": math.inf, "Z": math.inf}
    od.check_same_tiers(df)
    with pytest.raises(ValueError):
        od.check_same_tiers(df.unionByName(two.withColumn("tier", F.lit("zones_to_zones"))))
