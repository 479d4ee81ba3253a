"""Paths and their features over a graph beyond the broadcast bound are those of the search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from odolith.operators import routing
from odolith.operators.routing import NodeAggregation, PathAggregation


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(4)
    edges = [(r.randrange(14), r.randrange(14), float(r.randint(0, 3)), r.choice((None, 1.0, 2.0, 5.0)), 100.0) for _ in range(30)]
    graph = routing.collapse(spark.createDataFrame(edges, "u long, v long, w double, lanes double, length double"), "w", ["lanes", "length"])
    nodes = spark.createDataFrame([(i, float(i % 3)) for i in range(13)], "node_id long, signal double")
    ends = [(o, d) for o in (0, 3, 99) for d in (*range(14), 99)]
    pairs = spark.createDataFrame([("cells_to_cells", *e) for e in ends], "tier string, origin long, dest long")
    trips = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "trip_id long, origin long, dest long")
    return graph, nodes, pairs, trips


def outcome(world):
    graph, nodes, pairs, trips = world
    aggs = [PathAggregation("n", "lanes"), PathAggregation("mean", "lanes", "mean"), PathAggregation("least", "lanes", "min")]
    at = [NodeAggregation("all", "signal"), NodeAggregation("inside", "signal", "max", include_endpoints=False)]
    results = [
        routing.tiered_aggregate(pairs, graph, nodes=nodes, edge_aggregations=aggs, node_aggregations=at, cutoff=6.0),
        routing.trip_metrics(trips, graph, features={"lanes": "length_weighted"}),
        routing.betweenness(pairs.select("origin", "dest"), graph),
        routing.routes(pairs.select("origin", "dest"), graph, paths=True).withColumn("path", F.col("path").cast("string")),
    ]
    return [sorted([tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in df.collect()], key=repr) for df in results]


def test_either_engine_gives_the_same_features_trips_and_flows(world, monkeypatch):
    by_search = outcome(world)
    assert len(by_search[0]) == 45 and any(r[3] not in (0, math.inf) for r in by_search[0])
    monkeypatch.setattr(routing, "BROADCAST_EDGES", 5)
    monkeypatch.setattr(routing, "_arrays", lambda *a: pytest.fail("the graph was taken to the driver"))
    assert outcome(world) == by_search


def test_nodes_count_too(world, monkeypatch):
    graph, nodes, *_ = world
    monkeypatch.setattr(routing, "BROADCAST_EDGES", graph.count())
    assert routing.fits(graph, nodes) and not routing.fits(graph, nodes.crossJoin(nodes.select("signal")))
