"""Queries on single routes, given paths, calibration, scores and shaping over the tables of a data folder, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, tags
from ..operators import calibrate, flows, graph, mapping, overhead, plotdata, raster, reshape, routing, utility
from ..operators import od as ods
from ..operators.proximity import points
from ..schema import finite
from ..session import settled, table_path
from ..sources import extracts
from ..streaming import counts
from .accessibility import PATHS, REACH, UNDEFINED, UNREACHABLE, _clean, number
from .network import CATEGORIES, RANKED, SHAPES, _lines
from .world import SQL, World

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[World], DataFrame]):
        _Q[name] = lambda spark, d: f(World(spark, d))
        if sql is not None:
            _S[name] = SQL + sql
        return f

    return add


@query("route_single", ", asked AS (SELECT min(node_id) AS origin FROM c WHERE node_id IN (SELECT u FROM g))" + REACH + "SELECT n AS node, round(c, 6) AS cost FROM d")
def _single(w: World) -> DataFrame:
    """From the first cell node on the network to every node in reach."""
    origin = w.cells.join(w.graph.select(F.col("u").alias("node_id")).distinct(), "node_id", "left_semi").agg(F.min("node_id")).first()[0]
    return _clean(routing.distances_from(w.graph, origin), ["node"])


@query("route_matrix", ", zn AS (SELECT DISTINCT node_id FROM z), asked AS (SELECT node_id AS origin FROM zn)" + REACH + f"SELECT a.node_id AS origin, b.node_id AS dest, coalesce(round(c, 6), CASE WHEN a.node_id = b.node_id THEN 0 ELSE {UNREACHABLE} END) AS cost FROM zn a CROSS JOIN zn b LEFT JOIN d ON o = a.node_id AND n = b.node_id")
def _matrix(w: World) -> DataFrame:
    ends = w.zones.select("node_id").distinct()
    return _clean(routing.pairwise(w.graph, ends.withColumnRenamed("node_id", "origin"), ends.withColumnRenamed("node_id", "dest")), ["origin", "dest"])


@query("ovh_group_routed", ", asked AS (SELECT DISTINCT node_id AS origin FROM z)" + REACH + f""", met AS (
  SELECT z.zone_id, c.population AS w, 30.0 + 0.5 * coalesce(building_count, 0) + 0.1 * coalesce(c.population, 0) + CASE WHEN z.node_id = c.node_id THEN 0 ELSE d.c END AS v
  FROM z LEFT JOIN c ON c.zone_id = z.zone_id AND c.node_id IS NOT NULL LEFT JOIN d ON o = z.node_id AND n = c.node_id
) SELECT zone_id AS "group", coalesce(round(sum(CASE WHEN v IS NOT NULL AND w > 0 THEN v * w END) / nullif(sum(CASE WHEN v IS NOT NULL AND w > 0 THEN w END), 0), 6), {UNDEFINED}) AS overhead FROM met GROUP BY zone_id""")
def _group_routed(w: World) -> DataFrame:
    cells = w.cells.withColumn("overhead", overhead.linear(30.0, {"building_count": 0.5, "population": 0.1}))
    return _clean(overhead.per_group_routed(cells, w.zones, w.graph, overhead="overhead", weight="population"), ["group"])


_CHAINS = """, en AS (SELECT DISTINCT edge_id, u, v FROM e WHERE u IS NOT NULL AND v IS NOT NULL AND u <> v),
ch AS (SELECT a.edge_id AS a, b.edge_id AS b, a.u AS n0, a.v AS n1, b.v AS n2 FROM en a JOIN en b ON a.v = b.u AND a.edge_id < b.edge_id)
"""


@query("route_given_paths", _CHAINS + f""", sg AS (SELECT node_id, max(is_traffic_signal)::DOUBLE AS s FROM n GROUP BY node_id)
SELECT concat(a, '-', b) AS id, CASE WHEN g1.w IS NULL OR g2.w IS NULL THEN {UNREACHABLE} ELSE round(g1.w + g2.w, 6) END AS cost,
  CASE WHEN g1.w IS NULL OR g2.w IS NULL THEN {UNDEFINED} ELSE coalesce(g1.lane_count, 0) + coalesce(g2.lane_count, 0) END AS lanes,
  CASE WHEN g1.w IS NULL OR g2.w IS NULL THEN {UNDEFINED} ELSE round(sqrt(g1.w * g1.w + g2.w * g2.w), 6) END AS norm,
  CASE WHEN g1.w IS NULL OR g2.w IS NULL THEN {UNDEFINED} ELSE coalesce(s0.s, 0) + coalesce(s1.s, 0) + coalesce(s2.s, 0) END AS signals,
  CASE WHEN g1.w IS NULL OR g2.w IS NULL THEN {UNDEFINED} ELSE coalesce(s1.s, 0) END AS inner_signals
FROM ch LEFT JOIN g g1 ON g1.u = n0 AND g1.v = n1 LEFT JOIN g g2 ON g2.u = n1 AND g2.v = n2
LEFT JOIN sg s0 ON s0.node_id = n0 LEFT JOIN sg s1 ON s1.node_id = n1 LEFT JOIN sg s2 ON s2.node_id = n2""")
def _given(w: World) -> DataFrame:
    """Paths of two edges that follow each other; ``norm`` is a reduction of one's own."""
    e = w.edges.filter("u is not null and v is not null and u <> v").select("edge_id", "u", "v").distinct()
    a, b = e.select(F.col("edge_id").alias("a"), F.col("u").alias("n0"), F.col("v").alias("n1")), e.select(F.col("edge_id").alias("b"), F.col("u").alias("n1"), F.col("v").alias("n2"))
    paths = a.join(b, "n1").filter("a < b").select(F.concat_ws("-", "a", "b").alias("id"), F.array("n0", "n1", "n2").alias("path"))
    edge = [routing.PathAggregation("lanes", "lane_count"), routing.PathAggregation("norm", F.col("weight"), lambda v: float((v * v).sum() ** 0.5))]
    node = [routing.NodeAggregation("signals", "is_traffic_signal"), routing.NodeAggregation("inner_signals", "is_traffic_signal", include_endpoints=False)]
    signals = w.nodes.groupBy("node_id").agg(F.max("is_traffic_signal").alias("is_traffic_signal"))
    return _clean(routing.along_paths(paths, "id", w.graph, nodes=signals, edge_aggregations=edge, node_aggregations=node), ["id"])


# every pair of zones nearer than 2,500 m, once, over the paths of ``route_aggregate``
@query("flow_betweenness", PATHS + """, trail(o, t, n, m) AS (
  SELECT origin, dest, dest, prev FROM (SELECT DISTINCT origin, dest FROM pairs WHERE tier = 'zones_to_zones' AND origin <> dest) JOIN pr ON o = origin AND n = dest
  UNION ALL
  SELECT t.o, t.t, t.m, pr.prev FROM trail t JOIN pr ON pr.o = t.o AND pr.n = t.m
) SELECT m AS u, n AS v, count(*)::DOUBLE AS flow FROM trail GROUP BY m, n""")
def _betweenness(w: World) -> DataFrame:
    pairs = w.written_pairs.filter("tier = 'zones_to_zones'").select("origin", "dest").distinct()
    return routing.betweenness(pairs, w.graph)


@query("route_trip_features", ", t AS (SELECT DISTINCT trip_id, nx_node_orig AS origin, nx_node_dest AS dest FROM legs WHERE nx_node_orig IS NOT NULL AND nx_node_dest IS NOT NULL)" + PATHS.replace("FROM pairs)", "FROM t)") + f"""
SELECT trip_id, round(c, 6) AS cost, round(c, 6) AS distance, round(lanes0, 6) AS lanes, round(CASE WHEN c > 0 THEN lw / c ELSE 0 END, 6) AS mean_lanes
FROM t JOIN st_ ON st_.o = origin AND st_.n = dest""")
def _trip_features(w: World) -> DataFrame:
    trips = w.raw("legs").filter("nx_node_orig is not null and nx_node_dest is not null").select("trip_id", F.col("nx_node_orig").alias("origin"), F.col("nx_node_dest").alias("dest")).distinct()
    g = w.graph.withColumn("lanes", F.col("lane_count")).withColumn("mean_lanes", F.col("lane_count"))
    return _clean(routing.trip_metrics(trips, g, features={"lanes": "sum", "mean_lanes": "length_weighted"}), ["trip_id"])


@query("net_edge_times", f""" SELECT edge_id, CASE WHEN isfinite(speed_kph) AND speed_kph > 0 THEN round(length / (speed_kph / 3.6), 6) END AS base,
  round(greatest(length / (greatest(30.0 * (1 - 0.1 * coalesce(lane_count, 0)), 5.0) / 3.6) + 2.0 * coalesce(k, 0), length / (60.0 / 3.6)), 6) AS time,
  round(length / (greatest(30.0 * (1 - 0.1 * coalesce(lane_count, 0)), 5.0) / 3.6) + 2.0 * coalesce(k, 0), 6) + length AS both_ FROM e""")
def _edge_times(w: World) -> DataFrame:
    e = routing.with_weight(w.edges, "time0", routing.edge_time(speed=F.lit(30.0), slowed={"lane_count": -0.1}, added={"k": 2.0}, least_kph=5.0))
    e = routing.with_weight(e, "time0", F.round("time0", 6))
    e = routing.with_combined(e, ["time0", "length"], "both_")
    e = routing.with_weight(e, "time", routing.edge_time(speed=F.lit(30.0), slowed={"lane_count": -0.1}, added={"k": 2.0}, least_kph=5.0, most_kph=60.0))
    base = F.when(finite("speed_kph") & (F.col("speed_kph") > 0), F.round(F.col("length") / (F.col("speed_kph") / 3.6), 6)).alias("base")
    return e.select("edge_id", base, number("time").alias("time"), "both_")


@query("calib_durations", " SELECT edge_id, round(b, 6) AS base, round(greatest(1.1 * b + b * 0.2 * coalesce(lane_count, 0) + 3.0 * coalesce(k, 0), 0.01), 6) AS duration FROM (SELECT *, length / (speed_kph / 3.6) AS b FROM e WHERE isfinite(speed_kph) AND speed_kph > 0)")
def _durations(w: World) -> DataFrame:
    e = w.edges.filter(finite("speed_kph") & (F.col("speed_kph") > 0)).withColumn("base", calibrate.baseline_duration())
    return _clean(e.select("edge_id", "base", calibrate.durations(F.col("base"), 1.1, {"lane_count": 0.2}, {"k": 3.0}).alias("duration")), ["edge_id"])


_LEGS = """, lg AS (
  SELECT trip_id, min((orig_x, orig_y, dest_x, dest_y, time_measured)) AS r FROM legs
  WHERE isfinite(orig_x) AND isfinite(orig_y) AND isfinite(dest_x) AND isfinite(dest_y) AND isfinite(time_measured) AND trip_id IS NOT NULL
    AND sqrt(pow(orig_x - dest_x, 2) + pow(orig_y - dest_y, 2)) >= 300 AND sqrt(pow(orig_x - dest_x, 2) + pow(orig_y - dest_y, 2)) < 1200
    AND isfinite(dist_measured) AND dist_measured < 3 * sqrt(pow(orig_x - dest_x, 2) + pow(orig_y - dest_y, 2))
  GROUP BY trip_id
), m AS (SELECT DISTINCT node_id, x, y FROM n), snapped AS (
  SELECT trip_id, r[5] AS y, (SELECT (min((sqrt(pow(x - r[1], 2) + pow(y - r[2], 2)), node_id))) FROM m WHERE x BETWEEN r[1] - 150 AND r[1] + 150 AND y BETWEEN r[2] - 150 AND r[2] + 150) AS a,
    (SELECT (min((sqrt(pow(x - r[3], 2) + pow(y - r[4], 2)), node_id))) FROM m WHERE x BETWEEN r[3] - 150 AND r[3] + 150 AND y BETWEEN r[4] - 150 AND r[4] + 150) AS b
  FROM lg
), usable AS (SELECT trip_id, y, a[1] AS a_d, a[2] AS origin, b[1] AS b_d, b[2] AS dest FROM snapped WHERE a[1] <= 150 AND b[1] <= 150)
"""


def _usable(w: World) -> DataFrame:
    return calibrate.usable_legs(w.raw("legs"), w.nodes, min_line=300.0, max_line=1200.0, max_ratio=3.0, max_snap=150.0)


@query("calib_legs", _LEGS + "SELECT trip_id, origin, dest, round(a_d, 6) AS origin_snap, round(b_d, 6) AS dest_snap FROM usable")
def _calib_legs(w: World) -> DataFrame:
    return _clean(_usable(w).select("trip_id", "origin", "dest", "origin_snap", "dest_snap"), ["trip_id", "origin", "dest"])


_TIMED = """, bw AS (
  SELECT u, v, k, length / (speed_kph / 3.6) AS w, length FROM e WHERE isfinite(length) AND length >= 0 AND isfinite(speed_kph) AND speed_kph > 0 AND u IS NOT NULL AND v IS NOT NULL AND u <> v
  UNION ALL
  SELECT v, u, k, length / (speed_kph / 3.6), length FROM e WHERE isfinite(length) AND length >= 0 AND isfinite(speed_kph) AND speed_kph > 0 AND u IS NOT NULL AND v IS NOT NULL AND u <> v AND NOT coalesce(oneway, false)
), tg AS (SELECT u, v, min(w) AS w FROM bw GROUP BY u, v), asked AS (SELECT DISTINCT origin FROM usable)
""" + REACH.replace("JOIN g ON", "JOIN tg g ON")


@query("calib_fit", _LEGS + _TIMED + "SELECT round(regr_intercept(y, t), 3) AS constant, round(regr_slope(y, t), 5) AS alpha, round(regr_r2(y, t), 6) AS r2, regr_count(y, t)::BIGINT AS n FROM (SELECT y, CASE WHEN origin = dest THEN 0 ELSE c END AS t FROM usable LEFT JOIN d ON o = origin AND n = dest) WHERE t IS NOT NULL")
def _calib_fit(w: World) -> DataFrame:
    """One round of the calibration without features: snapped legs, routes by baseline durations, least squares. As in SQL,
    no trip gives nulls, one trip or trips of one duration a slope of NaN and else nulls, and equal measured times an R² of 1."""
    edges = w.edges.filter(finite("speed_kph") & (F.col("speed_kph") > 0))
    got = calibrate.calibrate(edges, w.nodes, w.raw("legs"), iterations=1, oneway="oneway", strict=False, min_line=300.0, max_line=1200.0, max_ratio=3.0, max_snap=150.0)
    constant, alpha = map(float, got.fit.coefficients)
    if math.isnan(alpha):
        row = (None, alpha if got.fit.n else None, None, got.fit.n)
    else:
        row = (round(constant, 3), round(alpha, 5), round(1.0 if math.isnan(got.fit.r2) else float(got.fit.r2), 6), got.fit.n)
    return w.spark.createDataFrame([row], "constant double, alpha double, r2 double, n bigint")


@query("calib_loop")
def _calib_loop(w: World) -> DataFrame:
    """The whole calibration on all legs: factors, sums and endpoint terms, two rounds; coefficients with their p-values.

    Null where the trips determine none: too few, or features that depend on each other; ``n`` is of the last round done.
    """
    edges = w.edges.filter(finite("speed_kph") & (F.col("speed_kph") > 0)).withColumn("lanes_known", F.coalesce("lane_count", F.lit(1.0))).withColumn("segments", F.lit(1.0))
    nodes = graph.edges_to_nodes(w.edges, "lane_count", "mean").withColumnRenamed("node", "node_id")
    nodes = w.nodes.join(nodes.withColumnRenamed("value", "lanes_at"), "node_id", "left").withColumn("lanes_at", F.coalesce("lanes_at", F.lit(1.0)))
    got = calibrate.calibrate(edges, nodes, w.raw("legs"), factors=["lanes_known"], sums=["segments"], endpoints=["lanes_at", "snap_dist"], iterations=2, oneway="oneway", of="baseline", strict=False, max_snap=300.0)
    defined = lambda x: None if math.isnan(x) else float(x)
    rows = [(n, defined(c), defined(p), defined(got.fit.r2), got.fit.n) for n, c, p in zip(got.fit.names, got.fit.coefficients, got.fit.p_values, strict=True)]
    return w.spark.createDataFrame(rows, "name string, coefficient double, p_value double, r2 double, n bigint")


@query("calib_endpoints", _LEGS + f", sg AS (SELECT node_id, max(is_traffic_signal)::DOUBLE AS s FROM n GROUP BY node_id) SELECT trip_id, 1.0::DOUBLE AS const, round(y / 2, 6) AS baseline_time, round(y / 2 * 0.25, 6) AS share__mult, 3.0::DOUBLE AS steps, a.s AS is_traffic_signal_orig, b.s AS is_traffic_signal_dest, round(a_d, 6) AS snap_dist_orig, round(b_d, 6) AS snap_dist_dest FROM usable LEFT JOIN sg a ON a.node_id = origin LEFT JOIN sg b ON b.node_id = dest")
def _endpoints(w: World) -> DataFrame:
    """The design matrix of given routes: cost, a factor, a sum, node columns and snapping distances at both ends."""
    legs = settled(_usable(w))
    routed = legs.select("trip_id", (F.col("time_measured") / 2).alias("cost"), F.lit(0.25).alias("share"), F.lit(3.0).alias("steps"))
    routed = calibrate.with_endpoints(routed, legs, w.nodes, ["is_traffic_signal", "snap_dist"])
    x, _ = calibrate.design(routed, ["share"], ["steps"], ["is_traffic_signal", "snap_dist"])
    return _clean(x, ["trip_id"])


@query("calib_rmse", """, q AS (SELECT DISTINCT trip_id, dist_line AS line, time_measured AS m, dist_line / 8.0 AS p FROM legs WHERE isfinite(dist_line) AND isfinite(time_measured)),
b(band, lo, hi) AS (VALUES ('<10 km', -1e18, 10000.0), ('10-25 km', 10000.0, 25000.0), ('>=25 km', 25000.0, 1e18))
SELECT band, count(m) AS n, round(sqrt(avg((m - p) * (m - p))), 6) AS rmse FROM b LEFT JOIN q ON line >= lo AND line < hi GROUP BY band""")
def _rmse(w: World) -> DataFrame:
    p = w.raw("legs").filter(finite("dist_line") & finite("time_measured")).select("trip_id", F.col("dist_line").alias("line"), F.col("time_measured").alias("measured"), (F.col("dist_line") / 8.0).alias("predicted")).distinct()
    return _clean(calibrate.rmse_by_distance(p), ["band", "n"])


_INFO = "ci AS (SELECT node_id, sum(population) AS v FROM c WHERE node_id IS NOT NULL GROUP BY node_id), zi AS (SELECT node_id, sum(population) AS v FROM z GROUP BY node_id)"


@query("ovh_add_trip", f", {_INFO}, oc AS (SELECT run_id, tier, origin, dest, cost, coalesce(CASE tier WHEN 'zones_to_zones' THEN a2.v ELSE a1.v END, -1) AS va, coalesce(CASE tier WHEN 'cells_to_cells' THEN b1.v ELSE b2.v END, -1) AS vb FROM od LEFT JOIN ci a1 ON a1.node_id = origin LEFT JOIN zi a2 ON a2.node_id = origin LEFT JOIN ci b1 ON b1.node_id = dest LEFT JOIN zi b2 ON b2.node_id = dest WHERE isfinite(cost)) SELECT run_id, tier, origin, dest, round(cost + 0.1 * va + 0.01 * vb, 6) AS cost FROM oc WHERE va >= 0 AND vb >= 0")
def _add_trip(w: World) -> DataFrame:
    """Costs with callbacks over the cells' or zones' info at either end, of the pairs that have both."""
    info = lambda df: df.filter("node_id is not null").groupBy("node_id").agg(F.sum("population").alias("v"))
    od = w.od.filter(finite("cost")).select("run_id", "tier", "origin", "dest", "cost")
    out = overhead.add_trip(od, info(w.cells), zone_info=info(w.zones), origin=0.1 * F.col("v"), dest=0.01 * F.col("v"), verify=False)
    return _clean(out.filter(F.col("cost").isNotNull()), ["run_id", "tier", "origin", "dest"])


@query("ovh_floor_by_origin", ", fl AS (SELECT node_id AS origin, sum(population) AS floor FROM c WHERE node_id IS NOT NULL GROUP BY node_id) SELECT run_id, tier, od.origin, dest, CASE WHEN isfinite(cost) THEN CASE WHEN tier = 'cells_to_cells' AND floor IS NOT NULL THEN greatest(cost, floor) ELSE cost END WHEN isinf(cost) THEN " + f"{UNREACHABLE} WHEN isnan(cost) THEN {UNDEFINED} END AS cost FROM od LEFT JOIN fl ON fl.origin = od.origin")
def _floor_by_origin(w: World) -> DataFrame:
    floors = w.cells.filter("node_id is not null").groupBy(F.col("node_id").alias("origin")).agg(F.sum("population").alias("floor"))
    return _clean(routing.floor_within_zone(w.od.select("run_id", "tier", "origin", "dest", "cost"), floors), ["run_id", "tier", "origin", "dest"], 9)


@query("utility_endpoints", ", ou AS (SELECT 'cell' AS kind, node_id, 0.01 * avg(building_count) AS u FROM c WHERE node_id IS NOT NULL GROUP BY node_id), du AS (SELECT 'cell' AS kind, node_id, 0.001 * coalesce(sum(population), 0) AS u FROM c WHERE node_id IS NOT NULL GROUP BY node_id UNION ALL SELECT 'zone', node_id, 0.001 * coalesce(sum(population), 0) FROM z GROUP BY node_id)"
  + f" SELECT run_id, tier, origin, dest, CASE WHEN isfinite(cost) THEN round(-0.01 * cost + 0.5 + coalesce(CASE WHEN tier = 'zones_to_zones' THEN 0 ELSE ou.u END, 0) + coalesce(du.u, 0), 6) + 0.0 ELSE {UNDEFINED} END AS utility FROM od LEFT JOIN ou ON ou.node_id = origin AND tier <> 'zones_to_zones' LEFT JOIN du ON du.node_id = dest AND du.kind = CASE tier WHEN 'cells_to_cells' THEN 'cell' ELSE 'zone' END")
def _utility_endpoints(w: World) -> DataFrame:
    u = utility.Utility(0.5, -0.01, (), {"building_count": 0.01}, {"population": 0.001})
    od = w.od.select("run_id", "tier", "origin", "dest", F.when(finite("cost"), -0.01 * F.col("cost")).otherwise(float("nan")).alias("utility"))
    return _clean(utility.add_endpoints(od, u, w.cells, w.zones), ["run_id", "tier", "origin", "dest"])


@query("flow_draws", ", sc AS (SELECT run_id, origin, dest, pop * exp(-0.001 * cost) AS w FROM od WHERE tier = 'cells_to_cells' AND isfinite(cost) AND isfinite(pop) AND pop * exp(-0.001 * cost) > 0), cm AS (SELECT *, sum(w) OVER (PARTITION BY run_id, origin ORDER BY dest ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY run_id, origin) AS total FROM sc), dr AS (SELECT DISTINCT run_id, origin, i AS draw, (i + 0.37) / 8 AS r FROM sc, range(8) t(i)) SELECT run_id, origin, draw, dest FROM dr JOIN cm USING (run_id, origin) WHERE cum >= r * total AND cum - w < r * total")
def _draws(w: World) -> DataFrame:
    """Eight draws at stated places of the distribution of each origin's destinations."""
    sc = w.od.filter("tier = 'cells_to_cells'").filter(finite("cost") & finite("pop")).select("run_id", "origin", "dest", (F.col("pop") * F.exp(-0.001 * F.col("cost"))).alias("w"))
    sc = settled(sc.filter("w > 0"))
    ask = sc.select("run_id", "origin").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))).withColumn("r", (F.col("draw") + 0.37) / 8)
    return flows.weighted_draws(sc, ["run_id", "origin"], "dest", "w", ask, order=F.col("dest").cast("double"))


@query("flow_lognormal_density", " SELECT trip_id, round(CASE WHEN t > 5 THEN exp(-pow((ln(t - 5) - 6.0) / 0.8, 2) / 2) / ((t - 5) * 0.8 * sqrt(2 * pi())) ELSE 0 END, 12) AS density FROM (SELECT DISTINCT trip_id, time_measured AS t FROM legs WHERE isfinite(time_measured))")
def _density(w: World) -> DataFrame:
    t = w.raw("legs").filter(finite("time_measured")).select("trip_id", "time_measured").distinct()
    return t.select("trip_id", F.round(flows.lognormal_density(F.col("time_measured"), 6.0, 0.8, 5.0), 12).alias("density"))


@query("net_elevation", ", el AS (SELECT node_id, max((x + 2 * y) % 97) AS z FROM n GROUP BY node_id) SELECT edge_id, CASE WHEN a.z IS NOT NULL AND b.z IS NOT NULL THEN round(greatest(b.z - a.z, 0), 6) END AS elev_gain, CASE WHEN a.z IS NOT NULL AND b.z IS NOT NULL THEN round(greatest(a.z - b.z, 0), 6) END AS elev_loss FROM e LEFT JOIN el a ON a.node_id = u LEFT JOIN el b ON b.node_id = v")
def _elevation(w: World) -> DataFrame:
    at = w.nodes.withColumn("elevation", (F.col("x") + 2 * F.col("y")) % 97)
    return _clean(graph.elevation_change(w.edges.select("edge_id", "u", "v"), at).select("edge_id", "elev_gain", "elev_loss"), ["edge_id"])


@query("net_scores", f""", q AS (SELECT edge_id, highway, oneway, {RANKED} AS r FROM e)
SELECT edge_id, CASE WHEN highway IN ('cycleway', 'footway', 'pedestrian', 'path', 'living_street') THEN 5.0 WHEN r < 0 THEN 4.0 ELSE least(5, greatest(1, least(5, 6 - r)) + CASE WHEN oneway THEN 2 WHEN NOT oneway THEN 1 ELSE 0 END) END::DOUBLE AS bike,
  CASE WHEN r >= 6 THEN 'highway' WHEN r >= 3 THEN 'main' ELSE 'local' END AS tier, CASE highway WHEN 'primary' THEN 1.0 WHEN 'residential' THEN 4.0 ELSE 3.0 END::DOUBLE AS class FROM q""")
def _scores(w: World) -> DataFrame:
    """Cycling scores, tiers and classes by street class; one-way streets stand for ones with a track, others for ones with a lane."""
    side = F.when(F.col("oneway"), "track").when(~F.col("oneway"), "lane")
    return w.edges.select("edge_id", tags.bike_score("highway", cycleway=side).alias("bike"), tags.highway_tier("highway").alias("tier"), tags.road_class("highway", {"primary": 1.0, "residential": 4.0}).alias("class"))


@query("net_mean_numbers", ", q AS (SELECT DISTINCT way_id, lanes FROM e WHERE lanes IS NOT NULL AND way_id IS NOT NULL) SELECT way_id, round(avg(CASE WHEN regexp_full_match(trim(lanes), '[0-9]+([.][0-9]+)?') THEN CAST(trim(lanes) AS DOUBLE) END), 6) AS mean FROM q GROUP BY way_id HAVING count(CASE WHEN regexp_full_match(trim(lanes), '[0-9]+([.][0-9]+)?') THEN 1 END) > 0")
def _mean_numbers(w: World) -> DataFrame:
    plain = F.when(F.trim("lanes").rlike(r"^[0-9]+([.][0-9]+)?$"), F.trim("lanes")).otherwise("no number")
    lists = w.edges.filter("lanes is not null and way_id is not null").select("way_id", "lanes").distinct().groupBy("way_id").agg(F.collect_list(plain).alias("all"))
    return lists.select("way_id", F.round(tags.mean_numeric("all").try_cast("double"), 6).alias("mean")).filter("mean is not null")


@query("shape_wide_sums", " SELECT way_id, " + ", ".join(f"round(coalesce(sum(CASE WHEN highway = '{h}' AND isfinite(length) THEN length END), 0), 6) AS {h}" for h in ("residential", "primary", "footway")) + " FROM e GROUP BY way_id")
def _wide(w: World) -> DataFrame:
    return _clean(reshape.wide_sums(w.edges, ["way_id"], "highway", ["residential", "primary", "footway"], "length"), ["way_id"])


@query("shape_rescaled", ", u AS (SELECT cell_id, zone_id, CASE WHEN building_count > 20 THEN 3.0 ELSE 1.5 END * coalesce(population, 0) AS e FROM c), s AS (SELECT zone_id, sum(e) AS s FROM u GROUP BY zone_id), t AS (SELECT zone_id, max(coalesce(population, 0) * 0.5) AS t FROM z GROUP BY zone_id) SELECT u.cell_id, round(u.e * coalesce(CASE WHEN s.s <> 0 THEN t.t / s.s END, 0), 6) AS jobs FROM u LEFT JOIN s ON s.zone_id = u.zone_id LEFT JOIN t ON t.zone_id = u.zone_id")
def _rescaled(w: World) -> DataFrame:
    """Jobs predicted from a tag and a size, scaled to half of each zone's population."""
    units = w.cells.select("cell_id", "zone_id", F.when(F.col("building_count") > 20, "many").otherwise("few").alias("tag"), "population")
    prior = reshape.predicted(units, "tag", "population", {"many": (3.0,)}, ["jobs"], (1.5,))
    totals = w.zones.select("zone_id", F.col("population").alias("jobs"), F.lit(0.5).alias("share"))
    return _clean(reshape.rescaled(prior, totals, "zone_id", ["jobs"], share="share").select("cell_id", "jobs"), ["cell_id"])


@query("shape_all_ids", " SELECT DISTINCT id FROM (SELECT cell_id AS id FROM cells WHERE population > 100 UNION SELECT zone_id FROM cells WHERE employment_tertiary > 50 UNION SELECT zone_id FROM zones) WHERE id IS NOT NULL")
def _all_ids(w: World) -> DataFrame:
    cells = w.raw("cells")
    return reshape.all_ids(cells.filter("population > 100").select("cell_id"), cells.filter("employment_tertiary > 50 and not isnan(employment_tertiary)").select("zone_id"), w.raw("zones").select("zone_id"), name="id")


_BOX = (1_202_000.0, 702_000.0, 1_205_000.0, 706_500.0)


@query("shape_inside_ratio", SHAPES + f""", strip AS (
  SELECT cell_id, sign, y1 AS ya, y2 AS yb, greatest(least(y1, y2), {_BOX[1]}) AS lo, least(greatest(y1, y2), {_BOX[3]}) AS hi, x1, y1, x2, y2 FROM side WHERE y1 <> y2
), ends AS (SELECT *, x1 + (lo - y1) / (y2 - y1) * (x2 - x1) AS xl, x1 + (hi - y1) / (y2 - y1) * (x2 - x1) AS xh FROM strip WHERE lo < hi
), fine AS (SELECT *, CASE WHEN xl < {_BOX[0]} THEN 0 WHEN xl > {_BOX[2]} THEN pow({_BOX[2] - _BOX[0]}, 2) / 2 + {_BOX[2] - _BOX[0]} * (xl - {_BOX[2]}) ELSE pow(xl - {_BOX[0]}, 2) / 2 END AS gl,
  CASE WHEN xh < {_BOX[0]} THEN 0 WHEN xh > {_BOX[2]} THEN pow({_BOX[2] - _BOX[0]}, 2) / 2 + {_BOX[2] - _BOX[0]} * (xh - {_BOX[2]}) ELSE pow(xh - {_BOX[0]}, 2) / 2 END AS gh FROM ends
), per AS (
  SELECT cell_id, sum(sign * CASE WHEN y2 > y1 THEN 1 ELSE -1 END * (hi - lo) * CASE WHEN abs(xh - xl) > 1e-7 THEN (gh - gl) / (xh - xl) ELSE least(greatest(xl - {_BOX[0]}, 0), {_BOX[2] - _BOX[0]}) END) AS inside FROM fine GROUP BY cell_id
) SELECT cell_id, round(inside, 2) AS area_inside, round(least(1, inside / area), 5) AS inside_ratio FROM per JOIN total USING (cell_id) WHERE inside > 0.01""")
def _ratio(w: World) -> DataFrame:
    units = w.raw("cells").filter("cell_id is not null").select("cell_id", geo.rings_of_wkt("geometry").alias("rings")).distinct().filter(F.size("rings") > 0)
    x0, y0, x1, y1 = _BOX
    got = reshape.inside_ratio(units, "rings", [(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
    return got.filter("area_inside > 0.01").select("cell_id", F.round("area_inside", 2).alias("area_inside"), F.round("inside_ratio", 5).alias("inside_ratio"))


@query("poi_extract", ", q AS (SELECT DISTINCT osm_id, x, y, " + ", ".join("CAST(" + " + ".join(f"CASE WHEN {k.split(':')[0]} = '{k.split(':')[1]}' THEN 1 ELSE 0 END" for k, _ in v) + f" AS INTEGER) AS {c}" for c, v in CATEGORIES.items()) + f" FROM (SELECT DISTINCT osm_id, amenity, shop, railway, x, y FROM pois)) SELECT * FROM q WHERE x > {_BOX[0]} AND x < {_BOX[2]} AND y > {_BOX[1]} AND y < {_BOX[3]} AND " + " + ".join(CATEGORIES) + " > 0")
def _extract(w: World) -> DataFrame:
    x0, y0, x1, y1 = _BOX
    got = extracts.pois_within(w.raw("pois").select("osm_id", "amenity", "shop", "railway", "x", "y"), [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]], CATEGORIES)
    return got.select("osm_id", "x", "y", *CATEGORIES)


@query("net_extract", f", inn AS (SELECT DISTINCT node_id FROM n WHERE x > {_BOX[0]} AND x < {_BOX[2]} AND y > {_BOX[1]} AND y < {_BOX[3]}) SELECT edge_id, u, v FROM e WHERE u IN (SELECT node_id FROM inn) AND v IN (SELECT node_id FROM inn)")
def _net_extract(w: World) -> DataFrame:
    x0, y0, x1, y1 = _BOX
    return extracts.network_within(w.nodes, w.edges.select("edge_id", "u", "v"), [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]])[1]


@query("raster_tiles", " SELECT lo::DOUBLE AS lon, la::DOUBLE AS lat, concat(CASE WHEN la < 0 THEN 'S' ELSE 'N' END, lpad(abs(la)::VARCHAR, 2, '0'), '_', CASE WHEN lo < 0 THEN 'W' ELSE 'E' END, lpad(abs(lo)::VARCHAR, 3, '0')) AS name FROM range(-2, 4) a(lo), range(-1, 3) b(la)")
def _tiles(w: World) -> DataFrame:
    return raster.tiles(w.spark, -1.5, -0.2, 3.3, 2.9)


@query("geo_bearings", ", ln AS (SELECT edge_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM e JOIN n a ON a.node_id = u JOIN n b ON b.node_id = v), q AS (SELECT edge_id, degrees(atan2(x2 - x1, y2 - y1)) AS d FROM ln), p AS (SELECT edge_id, CASE WHEN d < 0 THEN d + 360 ELSE d END AS b FROM q) SELECT edge_id, round(b, 6) AS bearing, round(least(abs(b - 200), 360 - abs(b - 200)), 6) AS turn, round(least(least(abs(b - 200), 360 - abs(b - 200)), 180 - least(abs(b - 200), 360 - abs(b - 200))), 6) AS bend FROM p")
def _bearings(w: World) -> DataFrame:
    at = _lines(w).select(F.col("id").alias("edge_id"), geo.bearing_at("path").alias("bearing"))
    other = F.lit(200.0)
    return _clean(at.select("edge_id", "bearing", geo.angular_difference("bearing", other).alias("turn"), geo.angular_difference("bearing", other, undirected=True).alias("bend")), ["edge_id"])


@query("radius_filled", ", q AS (SELECT DISTINCT cell_id, x, y, coalesce(population, 0) AS population FROM c) SELECT a.cell_id AS id, round(sum(b.population) / (pi() * 0.09), 6) AS population_r300, round(CASE WHEN count(CASE WHEN b.population > 0 THEN 1 END) > 0 THEN sum(b.population) / (count(CASE WHEN b.population > 0 THEN 1 END) * 0.01) ELSE 0 END, 6) AS population_r300_filled FROM q a JOIN q b ON b.x BETWEEN a.x - 300 AND a.x + 300 AND b.y BETWEEN a.y - 300 AND a.y + 300 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 300 GROUP BY a.cell_id")
def _filled(w: World) -> DataFrame:
    return _clean(mapping.sum_within(points(w.cells, "cell_id", population="population"), ["population"], 300.0, densities=True, filled=True, areas=F.lit(10_000.0)), ["id"])


@query("plot_comparison", ", a AS (SELECT cell_id, max(population) AS a FROM c GROUP BY cell_id), b AS (SELECT cell_id, max(employment_tertiary) AS b FROM c GROUP BY cell_id), v AS (SELECT a AS v FROM a UNION ALL SELECT b FROM b) SELECT a.cell_id, a AS value_a, b AS value_b, (SELECT min(v) FROM v) AS least, (SELECT max(v) FROM v) AS greatest FROM a JOIN b USING (cell_id)")
def _comparison(w: World) -> DataFrame:
    a = w.cells.groupBy("cell_id").agg(F.max("population").alias("v"))
    b = w.cells.groupBy("cell_id").agg(F.max("employment_tertiary").alias("v"))
    return plotdata.cell_comparison(a.select("cell_id"), a, b, "v")


@query("plot_destinations", ", me AS (SELECT min(origin) AS o FROM ctz WHERE origin IN (SELECT origin FROM pairs WHERE tier = 'cells_to_cells')) SELECT DISTINCT tier, dest FROM pairs, me WHERE tier <> 'zones_to_zones' AND origin = o UNION SELECT DISTINCT tier, dest FROM pairs, me JOIN ctz ON ctz.origin = o WHERE tier = 'zones_to_zones' AND pairs.origin = zone_origin")
def _destinations(w: World) -> DataFrame:
    near = w.written_pairs.filter("tier = 'cells_to_cells'").select("origin").distinct()
    home = settled(w.cell_to_zone)
    one = home.join(near, "origin", "left_semi").agg(F.min("origin")).first()[0]
    return plotdata.destinations_of(w.written_pairs, one, home)


@query("stream_closed", " SELECT strftime(d, '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, date_trunc('day', ts) AS d FROM events) WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY ALL")
def _stream_closed(w: World) -> DataFrame:
    """The windows that the stream itself has closed and written, run over the table's files until what is there is processed."""
    schema = w.raw("events").schema
    events = w.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(w.d)
    out, log = table_path(w.spark), table_path(w.spark)
    counts.write(counts.windowed(events), out, log).awaitTermination()
    got = w.spark.read.schema("window_start timestamp, event_type string, n bigint, total double").parquet(out)
    return got.withColumn("total", F.round("total", 4)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
