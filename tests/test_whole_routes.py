"""Queries over routes reach every destination the network reaches, however far the way."""

import __spark_entry__
import pytest

NODES = [(i, 1400.0 * i, 0.0, False) for i in range(3)]
CELLS = [(f"C{i}", f"Z{i}", i, 1400.0 * i, 0.0, 10.0, 1.0, 1, None) for i in range(3)]
ZONES = [(f"Z{i}", i, 1400.0 * i, 0.0, 10.0) for i in range(3)]
EDGES = [(i, i, i + 1, 0, i, length, 50.0, "primary", "2", False) for i, length in enumerate((1600.0, 2100.0))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("far")
    tables = {
        "nodes": (NODES, "node_id long, x double, y double, is_traffic_signal boolean"),
        "cells": (CELLS, "cell_id string, zone_id string, node_id long, x double, y double, population double, employment_tertiary double, building_count int, geometry string"),
        "zones": (ZONES, "zone_id string, node_id long, x double, y double, population double"),
        "edges": (EDGES, "edge_id long, u long, v long, k int, way_id long, length double, speed_kph double, highway string, lanes string, oneway boolean"),
        "legs": ([(7, 0, 2)], "trip_id long, nx_node_orig long, nx_node_dest long"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def run(spark, folder, name):
    return __spark_entry__.queries()[name](spark, folder).collect()


def far(rows, value):
    return {(r.origin, r.dest): r[value] for r in rows if r.tier == "zones_to_zones"}


def test_costs_and_features_beyond_the_old_cutoff(spark, folder):
    want = {(0, 1): 1600, (1, 0): 1600, (1, 2): 2100, (2, 1): 2100}
    assert far(run(spark, folder, "route_costs"), "cost") == want
    got = run(spark, folder, "route_aggregate")
    assert far(got, "cost") == want and far(got, "lanes_sum") == dict.fromkeys(want, 2)
    assert far(run(spark, folder, "route_utility_costs"), "utility") == {k: -0.01 * v for k, v in want.items()}
    assert all(v is not None for v in far(run(spark, folder, "route_utility"), "utility").values())


def test_trips_and_flows_beyond_the_old_cutoff(spark, folder):
    assert [tuple(r) for r in run(spark, folder, "route_trips")] == [(7, 3700, 3700)]
    assert {r.dest for r in run(spark, folder, "flow_sample") if r.origin == 2} == {1, 2}
    assert (2, 1) in {(r.u, r.v) for r in run(spark, folder, "flow_edges")}
