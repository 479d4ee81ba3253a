"""Queries on pairs, metrics, overheads and routes over the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, overhead, routing, utility
from ..operators import od as ods
from ..schema import finite
from .world import SQL, World

BINS = (metrics.Bin("short", 0, 600), metrics.Bin("medium", 600, 1800), metrics.Bin("long", 1800, 7200), metrics.Bin("any", 0, 1e9))
PROPERTIES = ("pop", "emp")
#: All that the bins of ``workflow_cumulative`` reach; the other routes are not cut.
CUTOFF = 1500.0
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[World], DataFrame]):
        _Q[name] = lambda spark, d: f(World(spark, d))
        if sql is not None:
            _S[name] = SQL + sql
        return f

    return add


#: How results that are no finite numbers are compared: each kind by a number of its own, null as null.
UNREACHABLE, BELOW_ALL, UNDEFINED = 1e300, -1e300, 1e299


def number(c: Column | str, digits: int = 6) -> Column:
    """A result for comparison: rounded; infinite and undefined values as marks, so that they cannot be taken for each other."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    marked = F.when(F.isnan(c), F.lit(UNDEFINED)).when(c == float("inf"), F.lit(UNREACHABLE)).when(c == float("-inf"), F.lit(BELOW_ALL))
    return F.when(c.isNotNull(), marked.otherwise(F.round(c, digits) + 0.0))  # no negative zero


def _clean(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[number(c, digits).alias(c) for c in df.columns if c not in keys])


def marked(finite_sql: str, value: str = "cost") -> str:
    """SQL of a result: ``finite_sql`` where the value it comes from is finite, else that value's mark."""
    return f"CASE WHEN isnan({value}) THEN {UNDEFINED} WHEN {value} = 'infinity'::DOUBLE THEN {UNREACHABLE} WHEN {value} = '-infinity'::DOUBLE THEN {BELOW_ALL} ELSE {finite_sql} END"


_OK = "isfinite(cost)"
_W = "CASE WHEN isfinite({0}) OR isinf({0}) THEN {0} ELSE 0 END"


@query("acc_cumulative", "SELECT run_id, origin, " + ", ".join(f"coalesce(sum(CASE WHEN {_OK} AND cost >= {b.low} AND cost < {b.high} THEN {_W.format(p)} END), 0) AS {b.name}__{p}" for b in BINS for p in PROPERTIES) + " FROM st GROUP BY run_id, origin")
def _cumulative(w: World) -> DataFrame:
    return metrics.cumulative(metrics.stitched(w.od, w.cell_to_zone, ["run_id"]), PROPERTIES, BINS, by=["run_id"], nan_weight="zero")


DECAYS = (metrics.exp_decay("exp", 0.002), metrics.power_decay("power", 1.0))
_DECAY_SQL = {"exp": "exp(-0.002 * cost)", "power": "CASE WHEN cost = 0 THEN NULL ELSE pow(cost, -1.0) END"}


@query("acc_gravity", "SELECT run_id, origin, " + ", ".join(f"round(coalesce(sum(CASE WHEN {_OK} THEN {_DECAY_SQL[d.name]} * {_W.format(p)} END), 0), 6) AS {d.name}__{p}" for d in DECAYS for p in PROPERTIES) + " FROM st GROUP BY run_id, origin")
def _gravity(w: World) -> DataFrame:
    return _clean(metrics.gravity(metrics.stitched(w.od, w.cell_to_zone, ["run_id"]), PROPERTIES, DECAYS, by=["run_id"], nan_weight="zero"), ["run_id", "origin"])


@query("acc_logsum", "SELECT run_id, origin, CASE WHEN a > 0 THEN round(ln(a), 6) END AS exp__pop FROM (SELECT run_id, origin, sum(CASE WHEN " + _OK + " THEN " + _DECAY_SQL["exp"] + " * " + _W.format("pop") + " END) AS a FROM st GROUP BY run_id, origin)")
def _logsum(w: World) -> DataFrame:
    g = metrics.gravity(metrics.stitched(w.od, w.cell_to_zone, ["run_id"]), ["pop"], DECAYS[:1], by=["run_id"], nan_weight="zero")
    return _clean(metrics.logsum(g, ["exp__pop"]), ["run_id", "origin"])


KS = (100, 1000)


def _nearest_sql(value: str) -> str:
    run = "SELECT run_id, origin, '{0}' AS p, cost, w, sum(w) OVER (PARTITION BY run_id, origin ORDER BY cost ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT run_id, origin, cost, sum({0}) AS w FROM st WHERE isfinite(cost) AND isfinite({0}) AND {0} > 0 GROUP BY ALL)"
    out = ", ".join(f"coalesce(round({value.format(k=k, p=p)}, 6), {UNDEFINED}) AS \"{k}__{p}\"" for k in KS for p in PROPERTIES)
    return f", run AS ({' UNION ALL '.join(run.format(p) for p in PROPERTIES)}) SELECT o.run_id, o.origin, {out} FROM (SELECT DISTINCT run_id, origin FROM st) o LEFT JOIN run r ON r.run_id = o.run_id AND r.origin = o.origin GROUP BY o.run_id, o.origin"


@query("acc_nearest_mean", _nearest_sql("CASE WHEN max(CASE WHEN p = '{p}' THEN cum END) >= {k} THEN sum(CASE WHEN p = '{p}' THEN cost * greatest(0, least(w, {k} - (cum - w))) END) / {k} END"))
def _nearest_mean(w: World) -> DataFrame:
    return _clean(metrics.nearest_k(metrics.stitched(w.od, w.cell_to_zone, ["run_id"]), PROPERTIES, KS, by=["run_id"]), ["run_id", "origin"])


@query("acc_nearest_at", _nearest_sql("min(CASE WHEN p = '{p}' AND cum >= {k} THEN cost END)"))
def _nearest_at(w: World) -> DataFrame:
    return _clean(metrics.nearest_k(metrics.stitched(w.od, w.cell_to_zone, ["run_id"]), PROPERTIES, KS, how="cost_at_k", by=["run_id"]), ["run_id", "origin"])


@query("od_describe", "SELECT run_id, tier, count(*) AS entries, count(DISTINCT origin) AS origins, count(*) FILTER (NOT coalesce(isfinite(cost), false)) AS non_finite, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.95), 6) AS p95, min(v) AS least, max(v) AS greatest FROM (SELECT *, CASE WHEN isfinite(cost) THEN cost END AS v FROM od) GROUP BY run_id, tier")
def _describe(w: World) -> DataFrame:
    return _clean(ods.describe(w.od, by=["run_id"]), ["run_id", "tier", "entries", "origins", "non_finite"])


@query("od_max_cost", "SELECT run_id, coalesce(max(CASE WHEN isfinite(cost) THEN cost END), 0) AS max_cost FROM od GROUP BY run_id")
def _max_cost(w: World) -> DataFrame:
    return ods.max_cost(w.od, by=["run_id"])


@query("od_mask", "SELECT run_id, tier, count(*) AS entries, count(DISTINCT origin) AS origins, round(avg(CASE WHEN cost < 900 AND NOT isnan(cost) THEN 1.0 ELSE 0.0 END), 9) AS true_share FROM od GROUP BY run_id, tier")
def _mask(w: World) -> DataFrame:
    d = ods.describe(ods.masked(w.od, lambda c: c < 900), "mask", ["run_id"])
    return d.withColumn("true_share", F.round("true_share", 9))


@query("od_modes_min", f"SELECT tier, origin, dest, coalesce(min(CASE WHEN isfinite(cost) THEN cost END), {UNREACHABLE}) AS cost FROM od GROUP BY tier, origin, dest")
def _modes_min(w: World) -> DataFrame:
    m = w.od.withColumn("cost", F.when(finite("cost"), F.col("cost")))
    return _clean(ods.across_modes(m, "min", mode="run_id"), ["tier", "origin", "dest"], 9)


@query("od_modes_logsum", f"SELECT tier, origin, dest, coalesce(round(min(c) - 60 * ln(sum(exp((low - c) / 60))), 6), {UNREACHABLE}) AS cost FROM (SELECT *, min(c) OVER (PARTITION BY tier, origin, dest) AS low FROM (SELECT tier, origin, dest, CASE WHEN isfinite(cost) THEN cost END AS c FROM od)) GROUP BY tier, origin, dest")
def _modes_logsum(w: World) -> DataFrame:
    m = w.od.withColumn("cost", F.when(finite("cost"), F.col("cost")))
    return _clean(ods.across_modes(m, "logsum", mode="run_id", scale=60.0), ["tier", "origin", "dest"])


@query("od_modes_custom", f"SELECT tier, origin, dest, coalesce(round((min(c) + max(c)) / 2, 6), {UNREACHABLE}) AS cost FROM (SELECT tier, origin, dest, run_id, CASE WHEN isfinite(cost) THEN cost END AS c FROM od) GROUP BY tier, origin, dest")
def _modes_custom(w: World) -> DataFrame:
    """Midway between the least and the greatest finite cost over all runs, as an aggregation of one's own."""
    m = w.od.withColumn("cost", F.when(finite("cost"), F.col("cost")))
    runs = [str(r[0]) for r in m.select("run_id").distinct().orderBy("run_id").collect()]  # a mode each
    least = lambda c: F.least(*c.values()) if len(c) > 1 else next(iter(c.values()))
    most = lambda c: F.array_max(F.filter(F.array(*c.values()), lambda v: v < float("inf")))
    return _clean(ods.across_modes(m, lambda c: F.coalesce((least(c) + most(c)) / 2, F.lit(float("inf"))), mode="run_id", names=runs), ["tier", "origin", "dest"])


@query("od_cell_to_zone", "SELECT origin, zone_origin FROM ctz")
def _ctz(w: World) -> DataFrame:
    return w.cell_to_zone


@query("od_pairs_tiered", "SELECT tier, origin, dest FROM pairs")
def _pairs(w: World) -> DataFrame:
    return w.pairs()


_AT = "(SELECT node_id AS id, avg(x) AS x, avg(y) AS y FROM c WHERE node_id IS NOT NULL GROUP BY node_id)"


@query("od_pairs_cells", f"SELECT 'cells_to_cells' AS tier, a.id AS origin, b.id AS dest FROM {_AT} a JOIN {_AT} b ON b.x BETWEEN a.x - 250 AND a.x + 250 AND b.y BETWEEN a.y - 250 AND a.y + 250 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 250")
def _pairs_cells(w: World) -> DataFrame:
    return ods.cell_pairs(w.cells, 250.0)


@query("od_pairs_masked", f"SELECT 'cells_to_cells' AS tier, a.id AS origin, b.id AS dest FROM {_AT} a JOIN {_AT} b ON b.x BETWEEN a.x - 250 AND a.x + 250 AND b.y BETWEEN a.y - 250 AND a.y + 250 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 250 AND a.id IN (SELECT node_id FROM c WHERE population > 50) AND b.id IN (SELECT node_id FROM c WHERE employment_tertiary > 10)")
def _pairs_masked(w: World) -> DataFrame:
    return ods.cell_pairs(w.cells, 250.0, origins=F.col("population") > 50, destinations=F.col("employment_tertiary") > 10)


_SUMS = "sums AS (SELECT 'cell' AS kind, node_id AS dest, sum(population) AS population FROM c WHERE node_id IS NOT NULL GROUP BY node_id UNION ALL SELECT 'zone', node_id, sum(population) FROM z GROUP BY node_id)"


@query("od_dest_values", f", {_SUMS} SELECT p.tier, p.origin, p.dest, population FROM pairs p LEFT JOIN sums s ON s.dest = p.dest AND s.kind = CASE tier WHEN 'cells_to_cells' THEN 'cell' ELSE 'zone' END")
def _dest_values(w: World) -> DataFrame:
    return ods.dest_values(w.pairs(), ["population"], w.cells, w.zones)


@query("od_node_values", ", wanted AS (SELECT DISTINCT node_id AS dest FROM c WHERE node_id IS NOT NULL) SELECT dest, sum(population) AS population FROM wanted JOIN c ON node_id = dest GROUP BY dest")
def _node_values(w: World) -> DataFrame:
    return ods.node_values(w.cells, "population", w.cells.filter("node_id is not null").select(F.col("node_id").alias("dest")).distinct())


_LIFT = """, unit AS (SELECT DISTINCT 'cell' AS kind, node_id AS node, cell_id AS unit FROM c WHERE node_id IS NOT NULL UNION ALL SELECT DISTINCT 'zone', node_id, zone_id FROM z),
lift AS (SELECT run_id, tier, a.unit AS origin, b.unit AS dest, cost FROM od
  JOIN unit a ON a.node = od.origin AND a.kind = CASE tier WHEN 'zones_to_zones' THEN 'zone' ELSE 'cell' END
  JOIN unit b ON b.node = od.dest AND b.kind = CASE tier WHEN 'cells_to_cells' THEN 'cell' ELSE 'zone' END)
"""


def _lifted(w: World) -> DataFrame:
    return ods.to_geo_units(w.od.select("tier", "origin", "dest", "run_id", "cost"), w.cells, w.zones)


@query("od_geo_lift", _LIFT + f"SELECT run_id, tier, origin, dest, {marked('cost')} AS cost FROM lift")
def _geo_lift(w: World) -> DataFrame:
    return _clean(_lifted(w), ["run_id", "tier", "origin", "dest"], 9)


@query("od_geo_values", _LIFT + "SELECT run_id, l.tier, l.origin, l.dest, CASE l.tier WHEN 'cells_to_cells' THEN c.population ELSE z.population END AS population FROM lift l LEFT JOIN c ON c.cell_id = l.dest LEFT JOIN z ON z.zone_id = l.dest")
def _geo_values(w: World) -> DataFrame:
    return ods.dest_values_geo(_lifted(w).drop("cost"), ["population"], w.cells, w.zones)


@query("od_euclidean", "SELECT tier, origin, dest, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM pairs JOIN n a ON a.node_id = origin JOIN n b ON b.node_id = dest")
def _euclid(w: World) -> DataFrame:
    have = w.nodes.select("node_id")
    known = w.pairs().join(have.withColumnRenamed("node_id", "origin"), "origin", "left_semi").join(have.withColumnRenamed("node_id", "dest"), "dest", "left_semi").select("tier", "origin", "dest")
    return _clean(ods.euclidean(known, w.nodes), ["tier", "origin", "dest"])


_OH = "30.0 + 0.5 * coalesce(building_count, 0) + 0.1 * coalesce(population, 0)"


def _with_overhead(w: World) -> DataFrame:
    return w.cells.withColumn("overhead", overhead.linear(30.0, {"building_count": 0.5, "population": 0.1}))


@query("ovh_linear", f"SELECT cell_id, round({_OH}, 6) AS overhead FROM c")
def _ovh_linear(w: World) -> DataFrame:
    return _with_overhead(w).select("cell_id", number("overhead").alias("overhead"))


_NODE_OH = f"(SELECT node_id AS node, sum(({_OH}) * population) / sum(population) AS overhead FROM c WHERE node_id IS NOT NULL AND population > 0 GROUP BY node_id)"


@query("ovh_node_mean", f"SELECT DISTINCT c.node_id AS node, coalesce(round(overhead, 6), {UNDEFINED}) AS overhead FROM c LEFT JOIN {_NODE_OH} o ON o.node = c.node_id WHERE c.node_id IS NOT NULL")
def _ovh_node(w: World) -> DataFrame:
    return _clean(overhead.per_node(_with_overhead(w), "overhead", weight="population"), ["node"])


_GROUP_OH = f"SELECT z.zone_id, avg(({_OH.replace('population', 'c.population')}) + sqrt((c.x - z.x) * (c.x - z.x) + (c.y - z.y) * (c.y - z.y)) / 1.4) AS overhead FROM z LEFT JOIN c USING (zone_id) GROUP BY z.zone_id"


@query("ovh_group_straight", f'SELECT zone_id AS "group", coalesce(round(overhead, 6), {UNDEFINED}) AS overhead FROM ({_GROUP_OH.replace("30.0 +", "CASE WHEN c.cell_id IS NULL THEN NULL ELSE 30.0 END +")})')
def _ovh_group(w: World) -> DataFrame:
    return _clean(overhead.per_group_straight(_with_overhead(w), w.zones, 1.4, overhead="overhead"), ["group"])


@query("ovh_add_node", f"SELECT run_id, tier, origin, dest, {marked("round(cost + coalesce(a.overhead, 0) + CASE tier WHEN 'cells_to_cells' THEN coalesce(b.overhead, 0) ELSE 0 END, 6)")} AS cost FROM od LEFT JOIN {_NODE_OH} a ON a.node = origin LEFT JOIN {_NODE_OH} b ON b.node = dest")
def _ovh_add_node(w: World) -> DataFrame:
    table = overhead.per_node(_with_overhead(w), "overhead", weight="population").filter(finite("overhead"))
    return _clean(overhead.add_node(w.od.select("run_id", "tier", "origin", "dest", "cost"), origin=table, dest_cell=table), ["run_id", "tier", "origin", "dest"])


@query("ovh_add_origin_cell", _LIFT + f", co AS (SELECT cell_id, {_OH} AS oh FROM c), zo AS (SELECT zone_id, avg({_OH}) AS oh FROM c WHERE zone_id IS NOT NULL GROUP BY zone_id) SELECT run_id, tier, origin, dest, {marked("round(cost + coalesce(CASE tier WHEN 'zones_to_zones' THEN zo.oh ELSE co.oh END, 0), 6)")} AS cost FROM lift LEFT JOIN co ON cell_id = origin LEFT JOIN zo ON zone_id = origin")
def _ovh_origin_cell(w: World) -> DataFrame:
    return _clean(overhead.add_origin_cell(_lifted(w), _with_overhead(w), "overhead"), ["run_id", "tier", "origin", "dest"])


@query("ovh_floor", "SELECT run_id, tier, origin, dest, " + marked("CASE WHEN tier = 'cells_to_cells' AND cost IS NOT NULL THEN greatest(cost, 120) ELSE cost END") + " AS cost FROM od")
def _ovh_floor(w: World) -> DataFrame:
    return _clean(routing.floor_within_zone(w.od.select("run_id", "tier", "origin", "dest", "cost"), 120.0), ["run_id", "tier", "origin", "dest"], 9)


# Fixed-point relaxation: per (origin, node) the least cost, from the origins in ``asked``.
REACH = """, d(o, n, c) USING KEY (o, n) AS (
  SELECT DISTINCT origin, origin, 0.0::DOUBLE FROM asked
  UNION
  SELECT o, n, min(c) FROM (
    SELECT d.o AS o, g.v AS n, d.c + g.w AS c FROM d JOIN g ON g.u = d.n LEFT JOIN recurring.d r ON r.o = d.o AND r.n = g.v
    WHERE r.c IS NULL OR d.c + g.w < r.c) GROUP BY o, n
)
"""
_ROUTES = ", asked AS (SELECT DISTINCT origin, dest FROM pairs)" + REACH

# The paths themselves: fewest edges among the cheapest, then the smaller previous node, and what lies along them.
PATHS = _ROUTES + """, h(o, n, h) USING KEY (o, n) AS (
  SELECT o, n, 0 FROM d WHERE o = n
  UNION
  SELECT h.o, g.v, min(h.h + 1) FROM h JOIN d a ON a.o = h.o AND a.n = h.n JOIN g ON g.u = h.n JOIN d b ON b.o = h.o AND b.n = g.v AND b.c = a.c + g.w
  LEFT JOIN recurring.h r ON r.o = h.o AND r.n = g.v WHERE r.h IS NULL GROUP BY h.o, g.v
), pr AS (
  SELECT b.o, b.n, min(a.n) AS prev FROM h b JOIN g ON g.v = b.n JOIN h a ON a.o = b.o AND a.n = g.u AND a.h = b.h - 1
  JOIN d da ON da.o = a.o AND da.n = a.n JOIN d db ON db.o = b.o AND db.n = b.n AND db.c = da.c + g.w WHERE b.h > 0 GROUP BY b.o, b.n
), sig AS (SELECT node_id, coalesce(max(is_traffic_signal), 0)::DOUBLE AS s FROM n GROUP BY node_id),
st_(o, n, c, lanes0, lw, longest, signals, inner_) AS (
  SELECT o, n, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, coalesce(s, 0.0)::DOUBLE, 0.0::DOUBLE FROM d LEFT JOIN sig ON sig.node_id = d.n WHERE o = n
  UNION ALL
  SELECT t.o, pr.n, t.c + g.w, t.lanes0 + coalesce(g.lane_count, 0), t.lw + coalesce(g.lane_count, 0) * g.w, greatest(t.longest, g.w), t.signals + coalesce(b.s, 0), t.inner_ + CASE WHEN t.n = t.o THEN 0 ELSE coalesce(a.s, 0) END
  FROM st_ t JOIN pr ON pr.o = t.o AND pr.prev = t.n JOIN g ON g.u = pr.prev AND g.v = pr.n LEFT JOIN sig a ON a.node_id = t.n LEFT JOIN sig b ON b.node_id = pr.n
)
"""


@query("route_costs", _ROUTES + f"SELECT tier, p.origin, p.dest, coalesce(round(c, 6), {UNREACHABLE}) AS cost FROM pairs p LEFT JOIN d ON d.o = p.origin AND d.n = p.dest")
def _route_costs(w: World) -> DataFrame:
    return _clean(routing.tiered_costs(w.written_pairs, w.graph), ["tier", "origin", "dest"])


def _metric_pairs(w: World) -> DataFrame:
    found = routing.tiered_costs(w.written_pairs, w.graph, cutoff=CUTOFF)
    return ods.dest_values(found, ["population"], w.cells, w.zones)


@query("workflow_cumulative", _ROUTES + f", {_SUMS}, oc AS (SELECT p.tier, p.origin, p.dest, c AS cost, coalesce(population, 0) AS population FROM pairs p LEFT JOIN d ON d.o = p.origin AND d.n = p.dest LEFT JOIN sums s ON s.dest = p.dest AND s.kind = CASE tier WHEN 'cells_to_cells' THEN 'cell' ELSE 'zone' END), whole AS (SELECT origin, cost, population FROM oc WHERE tier <> 'zones_to_zones' AND origin IN (SELECT origin FROM oc WHERE tier = 'cells_to_cells') UNION ALL SELECT o.origin, f.cost, f.population FROM (SELECT DISTINCT origin FROM oc WHERE tier = 'cells_to_cells') o JOIN ctz USING (origin) JOIN oc f ON f.origin = zone_origin AND f.tier = 'zones_to_zones') SELECT origin, coalesce(sum(CASE WHEN cost >= 0 AND cost < 500 THEN population END), 0) AS near__population, coalesce(sum(CASE WHEN cost >= 500 AND cost < 1500 THEN population END), 0) AS far__population FROM whole GROUP BY origin")
def _workflow(w: World) -> DataFrame:
    """From units and streets to opportunities within reach: pairs, routing, values, metric."""
    bins = (metrics.Bin("near", 0, 500), metrics.Bin("far", 500, 1500))
    return metrics.cumulative(metrics.stitched(_metric_pairs(w), w.cell_to_zone), ["population"], bins, nan_weight="zero")


@query("route_aggregate", PATHS + f"SELECT tier, p.origin, p.dest, coalesce(round(c, 6), {UNREACHABLE}) AS cost, coalesce(round(lanes0, 6), {UNDEFINED}) AS lanes_sum, coalesce(round(longest, 6), {UNDEFINED}) AS longest, coalesce(signals, {UNDEFINED}) AS signals, coalesce(inner_, {UNDEFINED}) AS signals_inside FROM pairs p LEFT JOIN st_ ON st_.o = p.origin AND st_.n = p.dest")
def _route_aggregate(w: World) -> DataFrame:
    edge = [routing.PathAggregation("lanes_sum", "lane_count"), routing.PathAggregation("longest", "length", "max")]
    node = [routing.NodeAggregation("signals", "is_traffic_signal"), routing.NodeAggregation("signals_inside", "is_traffic_signal", include_endpoints=False)]
    return _clean(routing.tiered_aggregate(w.written_pairs, w.graph, nodes=w.nodes, edge_aggregations=edge, node_aggregations=node), ["tier", "origin", "dest"])


@query("route_utility", PATHS + f""", ou AS (SELECT node_id, 0.01 * avg(building_count) AS u FROM c WHERE node_id IS NOT NULL GROUP BY node_id),
du AS (SELECT 'cell' AS kind, node_id, 0.001 * coalesce(sum(population), 0) AS u FROM c WHERE node_id IS NOT NULL GROUP BY node_id UNION ALL SELECT 'zone', node_id, 0.001 * coalesce(sum(population), 0) FROM z GROUP BY node_id)
SELECT tier, p.origin, p.dest, coalesce(round(-0.01 * c - 0.1 * lanes0 + 0.5 + coalesce(ou.u, 0) + coalesce(du.u, 0), 6) + 0.0, {UNDEFINED}) AS utility
FROM pairs p LEFT JOIN st_ ON st_.o = p.origin AND st_.n = p.dest LEFT JOIN ou ON ou.node_id = p.origin AND tier <> 'zones_to_zones'
LEFT JOIN du ON du.node_id = p.dest AND du.kind = CASE tier WHEN 'cells_to_cells' THEN 'cell' ELSE 'zone' END""")
def _route_utility(w: World) -> DataFrame:
    u = utility.Utility(0.5, -0.01, (utility.RouteFeature(-0.1, routing.PathAggregation("lanes_sum", "lane_count")),), {"building_count": 0.01}, {"population": 0.001})
    u0 = utility.route_utility(w.written_pairs, w.graph, u)
    return _clean(utility.add_endpoints(u0, u, w.cells, w.zones), ["tier", "origin", "dest"])


@query("route_utility_costs", _ROUTES + f"SELECT tier, p.origin, p.dest, coalesce(round(-0.01 * c, 6) + 0.0, {UNDEFINED}) AS utility FROM pairs p LEFT JOIN d ON d.o = p.origin AND d.n = p.dest")
def _utility_costs(w: World) -> DataFrame:
    return _clean(utility.route_utility(w.written_pairs, w.graph, utility.Utility(cost_coefficient=-0.01)), ["tier", "origin", "dest"])


@query("route_trips", ", t AS (SELECT DISTINCT trip_id, nx_node_orig AS origin, nx_node_dest AS dest FROM legs WHERE nx_node_orig IS NOT NULL AND nx_node_dest IS NOT NULL), asked AS (SELECT origin, dest FROM t)" + REACH + "SELECT trip_id, round(c, 6) AS cost, round(c, 6) AS distance FROM t JOIN d ON d.o = origin AND d.n = dest")
def _route_trips(w: World) -> DataFrame:
    trips = w.raw("legs").filter("nx_node_orig is not null and nx_node_dest is not null").select("trip_id", F.col("nx_node_orig").alias("origin"), F.col("nx_node_dest").alias("dest")).distinct()
    return _clean(routing.trip_metrics(trips, w.graph), ["trip_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
