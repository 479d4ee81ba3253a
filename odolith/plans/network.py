"""Queries on spatial mapping, network preparation, flows and calibration over the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, tags
from ..operators import calibrate, flows, graph, grid, mapping, plotdata, poi, raster, routing
from ..operators import od as ods
from ..operators.proximity import points, regions
from ..schema import finite
from ..streaming import counts
from .accessibility import UNDEFINED, _clean, number
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


_PT = ", p AS (SELECT DISTINCT osm_id, x, y FROM pois WHERE osm_id IS NOT NULL AND isfinite(x) AND isfinite(y))"
_RING = """, ring AS (
  SELECT cell_id, list_transform(string_split(t, ','), lambda s: list_transform(string_split(trim(s), ' '), lambda v: CAST(v AS DOUBLE))) AS pts
  FROM (SELECT cell_id, unnest(ts) AS t FROM (
    SELECT DISTINCT cell_id, regexp_extract_all(regexp_replace(geometry, '\\s+', ' ', 'g'), '\\(([^()]+)\\)', 1) AS ts FROM cells WHERE cell_id IS NOT NULL))
), seg AS (
  SELECT cell_id, pts[i][1] AS x1, pts[i][2] AS y1, pts[i + 1][1] AS x2, pts[i + 1][2] AS y2 FROM (SELECT cell_id, pts, unnest(range(1, len(pts))) AS i FROM ring)
), box AS (SELECT cell_id, min(x1) AS x0, max(x1) AS x1, min(y1) AS y0, max(y1) AS y1 FROM seg GROUP BY cell_id)
"""
_IN = """, hit AS (
  SELECT {id} AS point, cell_id FROM (SELECT {id}, cell_id, x, y FROM {pts} JOIN box ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) JOIN seg USING (cell_id)
  WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) / (y2 - y1) * (x2 - x1) GROUP BY {id}, cell_id HAVING count(*) % 2 = 1)
"""


def _cells(w: World) -> DataFrame:
    return regions(w.raw("cells"), "cell_id", "geometry")


def _pois(w: World) -> DataFrame:
    return points(w.raw("pois"), "osm_id")


def _nodes(w: World) -> DataFrame:
    return points(w.raw("nodes"), "node_id")


@query("map_points_to_regions", _PT + _RING + _IN.format(id="osm_id", pts="p") + "SELECT osm_id AS left_id, min(cell_id) AS right_id FROM p LEFT JOIN hit ON point = osm_id GROUP BY osm_id")
def _p2r(w: World) -> DataFrame:
    return mapping.points_to_regions(_pois(w), _cells(w), allow_nearest=False).select("left_id", "right_id")


_SEG_D = "sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2))"
_NEAR = f""", free AS (SELECT * FROM p WHERE osm_id NOT IN (SELECT point FROM hit)),
cand AS (SELECT osm_id, cell_id, min({_SEG_D}) AS dist FROM (
  SELECT osm_id, seg.cell_id, x, y, seg.x1, seg.y1, seg.x2, seg.y2,
    greatest(0, least(1, ((x - seg.x1) * (seg.x2 - seg.x1) + (y - seg.y1) * (seg.y2 - seg.y1)) / nullif((seg.x2 - seg.x1) * (seg.x2 - seg.x1) + (seg.y2 - seg.y1) * (seg.y2 - seg.y1), 0))) AS t
  FROM free JOIN box ON x BETWEEN box.x0 - 100 AND box.x1 + 100 AND y BETWEEN box.y0 - 100 AND box.y1 + 100 JOIN seg USING (cell_id)) GROUP BY osm_id, cell_id HAVING min({_SEG_D}) <= 100)
"""


@query("map_points_to_nearest_region", _PT + _RING + _IN.format(id="osm_id", pts="p") + _NEAR + "SELECT p.osm_id AS left_id, coalesce(min(hit.cell_id), arg_min(cand.cell_id, (dist, cand.cell_id))) AS right_id, round(CASE WHEN min(hit.cell_id) IS NULL THEN min(dist) END, 6) AS distance FROM p LEFT JOIN cand USING (osm_id) LEFT JOIN hit ON point = p.osm_id GROUP BY p.osm_id")
def _p2nr(w: World) -> DataFrame:
    return _clean(mapping.points_to_regions(_pois(w), _cells(w), max_distance=100.0), ["left_id", "right_id"])


@query("map_regions_to_points", _PT + _RING + _IN.format(id="osm_id", pts="p") + "SELECT cell_id AS left_id, CAST(min(point) AS VARCHAR) AS right_id FROM box LEFT JOIN hit USING (cell_id) GROUP BY cell_id")
def _r2p(w: World) -> DataFrame:
    return mapping.regions_to_points(_cells(w), _pois(w), allow_nearest=False).select("left_id", F.col("right_id").cast("string").alias("right_id"))


@query("map_regions_to_nearest_point", _PT + _RING + _IN.format(id="osm_id", pts="p") + f""", free AS (SELECT cell_id FROM box WHERE cell_id NOT IN (SELECT cell_id FROM hit)),
cand AS (SELECT cell_id, osm_id, {_SEG_D} AS dist FROM (
  SELECT osm_id, seg.cell_id, x, y, seg.x1, seg.y1, seg.x2, seg.y2,
    greatest(0, least(1, coalesce(((x - seg.x1) * (seg.x2 - seg.x1) + (y - seg.y1) * (seg.y2 - seg.y1)) / nullif((seg.x2 - seg.x1) * (seg.x2 - seg.x1) + (seg.y2 - seg.y1) * (seg.y2 - seg.y1), 0), 0))) AS t
  FROM free JOIN seg USING (cell_id) JOIN p ON x BETWEEN least(x1, x2) - 500 AND greatest(x1, x2) + 500 AND y BETWEEN least(y1, y2) - 500 AND greatest(y1, y2) + 500)),
best AS (SELECT cell_id, min((dist, osm_id)) AS m FROM cand WHERE dist <= 500 GROUP BY cell_id)
SELECT box.cell_id AS left_id, CAST(coalesce(min(point), any_value(m[2])) AS VARCHAR) AS right_id, round(CASE WHEN min(point) IS NULL THEN any_value(m[1]) END, 6) AS distance FROM box LEFT JOIN hit USING (cell_id) LEFT JOIN best USING (cell_id) GROUP BY box.cell_id""")
def _r2np(w: World) -> DataFrame:
    """Every region's point: one inside, else the nearest to its boundary within 500 m."""
    return _clean(mapping.regions_to_points(_cells(w), _pois(w), max_distance=500.0).withColumn("right_id", F.col("right_id").cast("string")), ["left_id", "right_id"])


@query("map_points_to_points", _PT + ", m AS (SELECT DISTINCT node_id, x, y FROM n) SELECT osm_id AS left_id, arg_min(node_id, (d, node_id)) AS right_id, round(min(d), 6) AS distance FROM (SELECT osm_id, node_id, sqrt((p.x - m.x) * (p.x - m.x) + (p.y - m.y) * (p.y - m.y)) AS d FROM p, m) GROUP BY osm_id")
def _p2p(w: World) -> DataFrame:
    return _clean(mapping.nearest(_pois(w), _nodes(w)), ["left_id", "right_id"])


@query("map_snap", ", m AS (SELECT DISTINCT node_id, x, y FROM n WHERE is_traffic_signal = 1), c1 AS (SELECT DISTINCT cell_id, x, y FROM c) SELECT c1.cell_id AS left_id, CAST(arg_min(node_id, (d, node_id)) AS VARCHAR) AS right_id, round(min(d), 6) AS distance FROM c1 LEFT JOIN (SELECT cell_id, node_id, sqrt((c1.x - m.x) * (c1.x - m.x) + (c1.y - m.y) * (c1.y - m.y)) AS d FROM c1, m) q ON q.cell_id = c1.cell_id AND d <= 400 GROUP BY c1.cell_id")
def _snap(w: World) -> DataFrame:
    have = points(w.nodes, "node_id", signal="is_traffic_signal")
    return _clean(mapping.snap(points(w.cells, "cell_id"), have, max_distance=400.0, eligible=F.col("signal") == 1).withColumn("right_id", F.col("right_id").cast("string")), ["left_id", "right_id"])


def _lines(w: World) -> DataFrame:
    """Edges as straight lines between their nodes."""
    at = w.nodes.select("node_id", "x", "y")
    a = at.select(F.col("node_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = at.select(F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    path = F.array(F.struct(F.col("ux").alias("x"), F.col("uy").alias("y")), F.struct(F.col("vx").alias("x"), F.col("vy").alias("y")))
    return w.edges.join(a, "u").join(b, "v").select(F.col("edge_id").alias("id"), path.alias("path"), "highway", "oneway").distinct()


_LINE = ", ln AS (SELECT edge_id, highway, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM e JOIN n a ON a.node_id = u JOIN n b ON b.node_id = v)"
_T = "greatest(0, least(1, coalesce(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0)))"


_ALONG = f"{{t}} * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"
_NEAR_LINES = "SELECT osm_id, edge_id, x, y, x1, y1, x2, y2, {t} AS t FROM p JOIN ln ON {where} AND x BETWEEN least(x1, x2) - {r} AND greatest(x1, x2) + {r} AND y BETWEEN least(y1, y2) - {r} AND greatest(y1, y2) + {r}"


@query("map_points_to_lines", _PT + _LINE + f", q AS (SELECT osm_id, edge_id, {_SEG_D} AS d, t * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS a FROM ({_NEAR_LINES.format(t=_T, where="highway IN ('residential', 'footway')", r=80)})), b AS (SELECT osm_id, min((d, edge_id, a)) AS m FROM q WHERE d <= 80 GROUP BY osm_id) SELECT p.osm_id AS left_id, CAST(m[2] AS VARCHAR) AS right_id, round(m[1], 6) AS distance, round(m[3], 6) AS dist_along FROM p LEFT JOIN b USING (osm_id)")
def _p2l(w: World) -> DataFrame:
    got = mapping.points_to_lines(_pois(w), _lines(w), 80.0, eligible=F.col("line_highway").isin("residential", "footway"))
    return _clean(got.withColumn("right_id", F.col("right_id").cast("string")), ["left_id", "right_id"])


@query("map_counters", _PT + _LINE + f", q AS (SELECT osm_id, edge_id, {_SEG_D} AS d, t * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS a, abs((degrees(atan2(x2 - x1, y2 - y1)) + 360) % 360 - (osm_id * 37) % 360) AS turn FROM ({_NEAR_LINES.format(t=_T, where='true', r=60)})), b AS (SELECT osm_id, min((d, edge_id, a)) AS m FROM q WHERE d <= 60 AND least(turn, 360 - turn) <= 30 GROUP BY osm_id) SELECT p.osm_id AS left_id, CAST(m[2] AS VARCHAR) AS right_id, round(m[1], 6) AS distance, round(m[3], 6) AS dist_along FROM p LEFT JOIN b USING (osm_id)")
def _counters(w: World) -> DataFrame:
    """Points of interest as counters that look in a direction of their own."""
    c = _pois(w).withColumn("bearing_deg", F.pmod(F.col("id") * 37, F.lit(360)).cast("double"))
    got = mapping.snap_counters(c, _lines(w), radius=60.0, tolerance=30.0)
    return _clean(got.withColumn("right_id", F.col("right_id").cast("string")), ["left_id", "right_id"])


# Rings with the sign that makes shells count positive and holes negative, whichever way they are written: the first ring of a
# part is its shell. ``side`` are their edges, ``total`` the area and centroid.
SHAPES = """, gm AS (
  SELECT DISTINCT cell_id, regexp_replace(regexp_replace(regexp_replace(upper(geometry), '\\s+', ' ', 'g'), ' ?([(),]) ?', '\\1', 'g'), '^[A-Z ]+', '') AS t FROM cells WHERE cell_id IS NOT NULL AND geometry LIKE '%(%'
), part AS (SELECT cell_id, generate_subscripts(ps, 1) AS part, unnest(ps) AS p FROM (SELECT cell_id, string_split(t, ')),((') AS ps FROM gm)
), rg AS (
  SELECT cell_id, part, generate_subscripts(rs, 1) AS ring, list_transform(string_split(unnest(rs), ','), lambda s: list_transform(string_split(trim(s), ' '), lambda v: CAST(v AS DOUBLE))) AS pts
  FROM (SELECT cell_id, part, list_filter(regexp_extract_all(p, '[^()]+'), lambda r: r <> ',') AS rs FROM part)
), sd AS (
  SELECT cell_id, part, ring, pts[1][1] AS ox, pts[1][2] AS oy, pts[i][1] AS x1, pts[i][2] AS y1, pts[i % len(pts) + 1][1] AS x2, pts[i % len(pts) + 1][2] AS y2 FROM (SELECT *, unnest(range(1, len(pts) + 1)) AS i FROM rg)
), turn AS (
  SELECT cell_id, part, ring, sign(sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))) * CASE WHEN ring = 1 THEN 1 ELSE -1 END AS sign FROM sd GROUP BY cell_id, part, ring
), anchor AS (SELECT cell_id, min(x1) AS ax, min(y1) AS ay FROM sd GROUP BY cell_id),
side AS (SELECT sd.cell_id, sign, ax, ay, x1, y1, x2, y2 FROM sd JOIN turn USING (cell_id, part, ring) JOIN anchor USING (cell_id)),
cross_ AS (SELECT *, sign * ((x1 - ax) * (y2 - ay) - (x2 - ax) * (y1 - ay)) AS c FROM side),
total AS (SELECT cell_id, sum(c) / 2 AS area, any_value(ax) + sum((x1 + x2 - 2 * ax) * c) / (3 * sum(c)) AS cx, any_value(ay) + sum((y1 + y2 - 2 * ay) * c) / (3 * sum(c)) AS cy FROM cross_ GROUP BY cell_id)
"""


@query("map_transport_centroids", ", np AS (SELECT DISTINCT node_id, x, y FROM n)" + _RING + _IN.format(id="node_id", pts="np") + "SELECT cell_id AS id, round(median(x), 6) AS x, round(median(y), 6) AS y FROM hit JOIN np ON node_id = point GROUP BY cell_id")
def _centroids(w: World) -> DataFrame:
    return _clean(mapping.transport_centroids(_cells(w), _nodes(w)), ["id"])


@query("map_assign_centroid", ", np AS (SELECT DISTINCT node_id, x, y FROM n)" + _RING + _IN.format(id="node_id", pts="np") + SHAPES + """, mid AS (SELECT cell_id, median(x) AS x, median(y) AS y FROM hit JOIN np ON node_id = point GROUP BY cell_id),
goal AS (SELECT cell_id, coalesce(mid.x, cx) AS x, coalesce(mid.y, cy) AS y FROM box LEFT JOIN mid USING (cell_id) LEFT JOIN total USING (cell_id)),
best AS (SELECT cell_id, min((sqrt((goal.x - np.x) * (goal.x - np.x) + (goal.y - np.y) * (goal.y - np.y)), node_id)) AS m FROM goal, np GROUP BY cell_id)
SELECT cell_id AS left_id, m[2]::BIGINT AS right_id, round(m[1], 3) AS distance FROM best""")
def _assign(w: World) -> DataFrame:
    rings = w.raw("cells").select(F.col("cell_id").alias("id"), geo.rings_of_wkt("geometry").alias("rings")).distinct().filter(F.size("rings") > 0)
    return _clean(mapping.assign_to_centroid(_cells(w), _nodes(w), rings=rings), ["left_id", "right_id"], 3)


@query("radius_cross_sum", _PT + ", t AS (SELECT DISTINCT node_id, x, y FROM n) SELECT t.node_id AS id, CAST(count(p.osm_id) AS DOUBLE) AS total FROM t LEFT JOIN p ON p.x BETWEEN t.x - 100 AND t.x + 100 AND p.y BETWEEN t.y - 100 AND t.y + 100 AND sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y)) <= 100 GROUP BY t.node_id")
def _cross(w: World) -> DataFrame:
    return mapping.cross_sum(_nodes(w), _pois(w), 100.0)


@query("radius_sum_within", ", q AS (SELECT DISTINCT cell_id, x, y, coalesce(population, 0) AS population FROM c) SELECT a.cell_id AS id, round(sum(b.population) / (pi() * 0.09), 6) AS population_r300 FROM q a JOIN q b ON b.x BETWEEN a.x - 300 AND a.x + 300 AND b.y BETWEEN a.y - 300 AND a.y + 300 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 300 GROUP BY a.cell_id")
def _sum_within(w: World) -> DataFrame:
    return _clean(mapping.sum_within(points(w.cells, "cell_id", population="population"), ["population"], 300.0, densities=True), ["id"])


@query("net_edges_to_nodes", ", ends AS (SELECT u AS node, edge_id, length FROM e UNION SELECT v, edge_id, length FROM e) SELECT node, max(length) AS value FROM ends WHERE node IS NOT NULL AND length IS NOT NULL AND NOT isnan(length) GROUP BY node")
def _e2n(w: World) -> DataFrame:
    return graph.edges_to_nodes(w.edges, "length", "max")


@query("net_nodes_to_edges", ", s AS (SELECT node_id, is_traffic_signal FROM n), ends AS (SELECT edge_id, u AS node FROM e UNION ALL SELECT edge_id, v FROM e) SELECT e.edge_id, CAST(sum(is_traffic_signal) AS DOUBLE) AS is_traffic_signal FROM e LEFT JOIN ends ON ends.edge_id = e.edge_id LEFT JOIN s ON s.node_id = node GROUP BY e.edge_id")
def _n2e(w: World) -> DataFrame:
    return graph.nodes_to_edges(w.edges.select("edge_id", "u", "v", "k"), w.nodes, ["is_traffic_signal"]).select("edge_id", "is_traffic_signal")


# Ranks of street classes, written out here so that the check does not share the operator's table.
RANKED = """CASE highway WHEN 'motorway' THEN 7 WHEN 'motorway_link' THEN 7 WHEN 'trunk' THEN 6 WHEN 'trunk_link' THEN 6 WHEN 'primary' THEN 5 WHEN 'primary_link' THEN 5
  WHEN 'secondary' THEN 4 WHEN 'secondary_link' THEN 4 WHEN 'tertiary' THEN 3 WHEN 'tertiary_link' THEN 3 WHEN 'residential' THEN 2 WHEN 'road' THEN 2
  WHEN 'living_street' THEN 1 WHEN 'pedestrian' THEN 1 ELSE -1 END"""
_JUNCTIONS = "count(DISTINCT other) AS degree, CAST(count(DISTINCT other) = 3 AS INTEGER) AS is_degree_3, CAST(count(DISTINCT other) >= 4 AS INTEGER) AS is_degree_4, max(r) AS max_highway_rank, min(r) AS min_highway_rank"


@query("net_junctions", f", ends AS (SELECT u AS node, v AS other, {RANKED} AS r FROM e WHERE u IS NOT NULL AND v IS NOT NULL UNION ALL SELECT v, u, {RANKED} FROM e WHERE u IS NOT NULL AND v IS NOT NULL) SELECT node, {_JUNCTIONS} FROM ends GROUP BY node")
def _junctions(w: World) -> DataFrame:
    return graph.junctions(w.edges)


@query("net_lanes", ", q AS (SELECT edge_id, oneway, TRY_CAST(nullif(regexp_extract(lanes, '[0-9]+([.][0-9]+)?', 0), '') AS DOUBLE) AS m FROM e) SELECT edge_id, CASE WHEN m IS NULL OR m <= 1 THEN 1.0 WHEN coalesce(oneway, false) THEN m ELSE m / 2 END::DOUBLE AS lanes_per_direction FROM q")
def _lanes(w: World) -> DataFrame:
    return w.edges.select("edge_id", tags.lanes_per_direction("lanes", "oneway").alias("lanes_per_direction"))


@query("net_collapse_ranks", f", r AS (SELECT way_id, highway, {RANKED} AS r FROM e WHERE highway IS NOT NULL) SELECT way_id, max(r) AS rank FROM r GROUP BY way_id")
def _ranks(w: World) -> DataFrame:
    lists = w.edges.filter("highway is not null and way_id is not null").groupBy("way_id").agg(F.sort_array(F.collect_set("highway")).alias("all"))
    return lists.select("way_id", tags.highway_rank(tags.collapse_by_rank("all")).alias("rank"))


@query("net_fill_attribute", ", q AS (SELECT u, v, k, max(speed_kph) AS s FROM e WHERE speed_kph > 50 AND NOT isnan(speed_kph) GROUP BY u, v, k) SELECT edge_id, coalesce(s, 0) AS fast FROM e LEFT JOIN q ON q.u = e.u AND q.v = e.v AND q.k = e.k")
def _fill(w: World) -> DataFrame:
    fast = w.edges.filter(finite("speed_kph") & (F.col("speed_kph") > 50)).groupBy("u", "v", "k").agg(F.max("speed_kph").alias("fast"))
    return graph.fill_attribute(w.edges, fast, "fast").select("edge_id", "fast")


@query("net_obstacles", " SELECT DISTINCT 'is_traffic_signal:1' AS kind, x, y FROM n WHERE is_traffic_signal = 1 UNION SELECT DISTINCT 'roundabout', (a.x + b.x) / 2, (a.y + b.y) / 2 FROM e JOIN n a ON a.node_id = u JOIN n b ON b.node_id = v WHERE highway = 'raceway'")
def _obstacles(w: World) -> DataFrame:
    return graph.obstacles(w.nodes, {"is_traffic_signal": "1"}, edges=w.edges, roundabout=F.col("highway") == "raceway")


@query("net_flag_obstacles", ", np AS (SELECT DISTINCT node_id, x, y FROM n), rail AS (SELECT DISTINCT x, y FROM pois WHERE railway IS NOT NULL AND isfinite(x) AND isfinite(y)), hit AS (SELECT min((sqrt((rail.x - np.x) * (rail.x - np.x) + (rail.y - np.y) * (rail.y - np.y)), node_id)) AS m FROM rail JOIN np ON np.x BETWEEN rail.x - 30 AND rail.x + 30 AND np.y BETWEEN rail.y - 30 AND rail.y + 30 GROUP BY rail.x, rail.y) SELECT node_id, CAST(node_id IN (SELECT m[2] FROM hit WHERE m[1] <= 30) AS INTEGER) AS is_near_rail FROM n")
def _flag(w: World) -> DataFrame:
    places = w.raw("pois").filter("railway is not null").filter(finite("x") & finite("y")).select("x", "y")
    return graph.flag_obstacles(w.nodes.select("node_id", "x", "y"), places, 30.0, "is_near_rail").select("node_id", "is_near_rail")


# Merged junctions: ``lab`` names the component of each node, ``mg`` are their places, ``ke`` the edges between them.
_MERGED = """, pr AS (SELECT a.node_id AS l, b.node_id AS r FROM n a JOIN n b ON a.node_id <> b.node_id AND b.x BETWEEN a.x - 20 AND a.x + 20 AND b.y BETWEEN a.y - 20 AND a.y + 20 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 20),
lab(id, m) USING KEY (id) AS (SELECT DISTINCT node_id, node_id FROM n UNION SELECT id, min(m) FROM (SELECT pr.r AS id, lab.m FROM lab JOIN pr ON pr.l = lab.id JOIN recurring.lab o ON o.id = pr.r WHERE lab.m < o.m) GROUP BY id)
"""
_KEYED = _MERGED + """, pt AS (SELECT node_id AS id, max(x) AS x, max(y) AS y FROM n GROUP BY node_id), mg AS (SELECT m, avg(x) AS x, avg(y) AS y, count(*) AS parts FROM lab JOIN pt USING (id) GROUP BY m),
ke AS (
  SELECT DISTINCT a.m AS u, b.m AS v, edge_id, CASE WHEN isfinite(length) THEN length ELSE sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) END AS length, highway, lanes, oneway
  FROM e JOIN lab a ON a.id = u JOIN lab b ON b.id = v JOIN mg p ON p.m = a.m JOIN mg q ON q.m = b.m WHERE a.m <> b.m
)
"""


@query("net_components", _MERGED + "SELECT m AS node_id, count(*) AS parts FROM lab GROUP BY m")
def _consolidated(w: World) -> DataFrame:
    """Junctions merged within 10 m buffers: how many nodes each is made of."""
    merged, _ = graph.consolidate(w.nodes, w.edges, 10.0)
    return merged.select("node_id", "parts")


@query("net_consolidated_edges", _KEYED + "SELECT u, v, row_number() OVER (PARTITION BY u, v ORDER BY length, edge_id, highway NULLS FIRST) - 1 AS k, edge_id, round(length, 6) AS length, highway FROM (SELECT DISTINCT u, v, edge_id, length, highway FROM ke)")
def _consolidated_edges(w: World) -> DataFrame:
    links = graph.consolidate(w.nodes, w.edges, 10.0, edge_keep=["highway"])[1]
    return links.select("u", "v", F.col("k").cast("long").alias("k"), "edge_id", number("length").alias("length"), "highway")


def _consolidated_whole(w: World) -> tuple[DataFrame, DataFrame]:
    edges = w.edges.select("edge_id", "u", "v", "k", "length", "highway", "lanes", "oneway")
    return graph.consolidated_network(w.nodes, edges, 10.0, obstacle_tags={"traffic_signal": ("is_traffic_signal", "1")}, roundabout=F.col("highway") == "raceway")


_SPOT = "(SELECT min((sqrt(pow(mg.x - s.x, 2) + pow(mg.y - s.y, 2)), m)) AS b FROM {0} s JOIN mg ON mg.x BETWEEN s.x - 30 AND s.x + 30 AND mg.y BETWEEN s.y - 30 AND s.y + 30 GROUP BY s.x, s.y)"


@query("net_consolidated_nodes", _KEYED + f""", ends AS (SELECT u AS node, v AS other, {RANKED} AS r FROM ke UNION ALL SELECT v, u, {RANKED} FROM ke), j AS (SELECT node, {_JUNCTIONS} FROM ends GROUP BY node),
sg AS (SELECT DISTINCT x, y FROM n WHERE is_traffic_signal = 1), rb AS (SELECT DISTINCT (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y FROM e JOIN n a ON a.node_id = u JOIN n b ON b.node_id = v WHERE highway = 'raceway')
SELECT m AS node_id, parts, coalesce(degree, 0) AS degree, coalesce(is_degree_3, 0) AS is_degree_3, coalesce(is_degree_4, 0) AS is_degree_4, coalesce(max_highway_rank, -1) AS max_highway_rank, coalesce(min_highway_rank, -1) AS min_highway_rank,
  CAST(m IN (SELECT b[2] FROM {_SPOT.format('sg')} WHERE b[1] <= 30) AS INTEGER) AS is_traffic_signal, CAST(m IN (SELECT b[2] FROM {_SPOT.format('rb')} WHERE b[1] <= 30) AS INTEGER) AS is_roundabout
FROM mg LEFT JOIN j ON node = m""")
def _consolidated_nodes(w: World) -> DataFrame:
    """The whole preparation in one call: merged junctions with their flags, ranks and obstacles."""
    return _consolidated_whole(w)[0].select("node_id", "parts", "degree", "is_degree_3", "is_degree_4", "max_highway_rank", "min_highway_rank", "is_traffic_signal", "is_roundabout")


@query("net_consolidated_lanes", _KEYED + ", q AS (SELECT *, TRY_CAST(nullif(regexp_extract(lanes, '[0-9]+([.][0-9]+)?', 0), '') AS DOUBLE) AS m FROM ke) SELECT u, v, edge_id, CASE WHEN m IS NULL OR m <= 1 THEN 1.0 WHEN coalesce(oneway, false) THEN m ELSE m / 2 END::DOUBLE AS lanes_per_direction FROM q")
def _consolidated_lanes(w: World) -> DataFrame:
    return _consolidated_whole(w)[1].select("u", "v", "edge_id", "lanes_per_direction")


CATEGORIES = {"groceries": (("shop:supermarket", 2.0), ("shop:greengrocer", 1.0), ("shop:bakery", 0.5)), "schools": (("amenity:school", 1.0), ("amenity:university", 3.0)), "transit": (("railway:station", 2.0), ("railway:tram_stop", 1.0))}


@query("poi_categories", ", " + "q AS (SELECT DISTINCT osm_id, " + ", ".join(" + ".join(f"CASE WHEN {k.split(':')[0]} = '{k.split(':')[1]}' THEN 1 ELSE 0 END" for k, _ in v) + f" AS {c}, " + " + ".join(f"CASE WHEN {k.split(':')[0]} = '{k.split(':')[1]}' THEN {wt} ELSE 0.0 END" for k, wt in v) + f" AS {c}_w" for c, v in CATEGORIES.items()) + " FROM pois) SELECT osm_id, " + ", ".join(f"CAST({c} AS INTEGER) AS {c}, CAST({c}_w AS DOUBLE) AS {c}_weight" for c in CATEGORIES) + " FROM q WHERE " + " + ".join(CATEGORIES) + " > 0")
def _poi(w: World) -> DataFrame:
    return poi.categorize(w.pois.select("osm_id", "amenity", "shop", "railway"), CATEGORIES).drop("amenity", "shop", "railway")


@query("poi_tag_query", " SELECT key, string_agg(DISTINCT value, ',' ORDER BY value) AS values FROM (VALUES " + ", ".join(f"('{k.split(':')[0]}', '{k.split(':')[1]}')" for v in CATEGORIES.values() for k, _ in v) + ") t(key, value) GROUP BY key")
def _poi_query(w: World) -> DataFrame:
    return poi.tag_query(w.spark, CATEGORIES).withColumn("values", F.concat_ws(",", "values"))


GRID = raster.Grid(1_200_000.0, 710_000.0, 500.0, 500.0)


def _pixels(w: World) -> DataFrame:
    """Population as pixels of 500 m."""
    at = w.cells.select(F.floor((GRID.y0 - F.col("y")) / GRID.dy).cast("long").alias("row"), F.floor((F.col("x") - GRID.x0) / GRID.dx).cast("long").alias("col"), "population")
    return at.groupBy("row", "col").agg(F.sum("population").alias("value"))


_PIXELS = ", px AS (SELECT CAST(floor((710000 - y) / 500) AS BIGINT) AS r, CAST(floor((x - 1200000) / 500) AS BIGINT) AS c, sum(population) AS v FROM c GROUP BY ALL)"


@query("raster_nearest", _PT + _PIXELS + " SELECT osm_id AS id, coalesce(v, " + f"{UNDEFINED}" + ") AS value FROM p LEFT JOIN px ON r = floor((710000 - y) / 500) AND c = floor((x - 1200000) / 500)")
def _raster_nearest(w: World) -> DataFrame:
    return _clean(raster.sample(_pois(w), _pixels(w), GRID, method="nearest").select("id", "value"), ["id"], 9)


@query("raster_bilinear", _PT + _PIXELS + ", f AS (SELECT osm_id, (710000 - y) / 500 - 0.5 AS rr, (x - 1200000) / 500 - 0.5 AS cc FROM p), four AS (SELECT osm_id, floor(rr) + i AS r, floor(cc) + j AS c, (CASE WHEN i = 1 THEN rr - floor(rr) ELSE 1 - (rr - floor(rr)) END) * (CASE WHEN j = 1 THEN cc - floor(cc) ELSE 1 - (cc - floor(cc)) END) AS w FROM f, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) SELECT osm_id AS id, coalesce(round(CASE WHEN count(*) = count(v) THEN sum(w * v) END, 6), " + f"{UNDEFINED}" + ") AS value FROM four LEFT JOIN px USING (r, c) WHERE w > 0 GROUP BY osm_id")
def _raster_bilinear(w: World) -> DataFrame:
    return _clean(raster.sample(_pois(w), _pixels(w), GRID).select("id", "value"), ["id"])


_GRID_IN = ", gi AS (SELECT id, x, y FROM (SELECT DISTINCT id, x, y FROM centre) JOIN box ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 JOIN seg USING (cell_id) WHERE (seg.y1 > y) <> (seg.y2 > y) AND x < seg.x1 + (y - seg.y1) / (seg.y2 - seg.y1) * (seg.x2 - seg.x1) GROUP BY id, x, y, cell_id HAVING count(*) % 2 = 1)"


@query("grid_square", _RING + ", centre AS (SELECT concat(i, '_', j) AS id, (i + 0.5) * 50 AS x, (j + 0.5) * 50 AS y FROM (SELECT i, unnest(range(floor(y0 / 50)::BIGINT, floor(y1 / 50)::BIGINT + 1)) AS j FROM (SELECT y0, y1, unnest(range(floor(x0 / 50)::BIGINT, floor(x1 / 50)::BIGINT + 1)) AS i FROM box)))" + _GRID_IN + " SELECT DISTINCT id AS cell_id, x::DOUBLE AS x, y::DOUBLE AS y, concat('z_', floor((x / 50 - 0.5) / 4)::BIGINT, '_', floor((y / 50 - 0.5) / 4)::BIGINT) AS zone_id FROM gi")
def _grid_square(w: World) -> DataFrame:
    return grid.square(_cells(w), 50.0)


@query("grid_hexagonal", _RING + ", rows_ AS (SELECT x0, x1, unnest(range(floor(y0 / 45)::BIGINT, ceil(y1 / 45)::BIGINT + 1)) AS r FROM box), centre AS (SELECT concat(q, '_', r) AS id, sqrt(3.0) * 30 * (q + r / 2.0) AS x, (45.0 * r)::DOUBLE AS y FROM (SELECT r, unnest(range(floor(x0 / (sqrt(3.0) * 30) - r / 2.0)::BIGINT - 1, ceil(x1 / (sqrt(3.0) * 30) - r / 2.0)::BIGINT + 2)) AS q FROM rows_))" + _GRID_IN + " SELECT DISTINCT id AS cell_id, round(x, 6)::DOUBLE AS x, round(y, 6)::DOUBLE AS y FROM gi")
def _grid_hex(w: World) -> DataFrame:
    return grid.hexagonal(_cells(w), 30.0).select("cell_id", number("x").alias("x"), number("y").alias("y"))


def _sample(w: World) -> DataFrame:
    pairs = routing.tiered_costs(w.written_pairs, w.graph)
    valued = ods.dest_values(pairs, ["population"], w.cells, w.zones)
    starts = w.cells.filter("node_id is not null").groupBy(F.col("node_id").alias("origin")).agg(F.sum("population").alias("w"))
    return flows.nested_sample(valued, "population", w.cell_to_zone, starts, lambda c: F.exp(-0.001 * c), 2_000, 10, seed=5)


@query("flow_sample")
def _flow_sample(w: World) -> DataFrame:
    return _sample(w)


@query("flow_edges")
def _flow_edges(w: World) -> DataFrame:
    return _clean(flows.edge_flows(_sample(w).select("origin", "dest"), w.graph, 10_000.0), ["u", "v"])


@query("flow_compare", ", q AS (SELECT lane_count AS m, speed_kph AS o FROM e WHERE isfinite(lane_count) AND isfinite(speed_kph)) SELECT count(*) AS n, round(pow(corr(m, o), 2), 6) AS r2, round(sum(m * o) / sum(o * o), 6) AS slope, round(sqrt(avg((m - o) * (m - o))), 6) AS rmse FROM q")
def _compare(w: World) -> DataFrame:
    e = w.edges.select("edge_id", F.col("lane_count").alias("flow"), F.col("speed_kph").alias("observed"))
    return _clean(flows.compare_counts(e.select("edge_id", "flow"), e.select("edge_id", "observed"), key=["edge_id"]), ["n"])


@query("flow_lognormal", " SELECT count(*) AS n, round(avg(ln(t)), 6) AS mu, round(stddev_pop(ln(t)), 6) AS sigma FROM (SELECT DISTINCT trip_id, time_measured AS t FROM legs) WHERE isfinite(t) AND t > 0")
def _lognormal(w: World) -> DataFrame:
    return _clean(flows.lognormal(w.raw("legs").select("trip_id", "time_measured").distinct(), "time_measured"), ["n"])


@query("calib_ols", " SELECT round(regr_intercept(dist_measured, dist_line), 4) AS constant, round(regr_slope(dist_measured, dist_line), 6) AS slope, round(regr_r2(dist_measured, dist_line), 6) AS r2, regr_count(dist_measured, dist_line)::BIGINT AS n FROM (SELECT DISTINCT trip_id, dist_measured, dist_line FROM legs WHERE isfinite(dist_measured) AND isfinite(dist_line))")
def _ols(w: World) -> DataFrame:
    legs = w.raw("legs").select("trip_id", "dist_measured", "dist_line").distinct().withColumn("one", F.lit(1.0))
    fit = calibrate.least_squares(legs, "dist_measured", ["one", "dist_line"])
    row = [(round(float(fit.coefficients[0]), 4), round(float(fit.coefficients[1]), 6), round(float(fit.r2), 6), fit.n)]
    return w.spark.createDataFrame(row, "constant double, slope double, r2 double, n bigint")


@query("plot_cells", ", q AS (SELECT DISTINCT cell_id, population FROM c) SELECT cell_id, population AS value, (SELECT min(population) FROM q) AS least, (SELECT max(population) FROM q) AS greatest FROM q")
def _plot_cells(w: World) -> DataFrame:
    c = w.cells.select("cell_id", "population").distinct()
    return plotdata.cell_values(c.select("cell_id"), c, "population")


@query("plot_edges", " SELECT edge_id, coalesce(lane_count, 1.0) AS lane_count, CASE highway WHEN 'motorway' THEN 3.0 WHEN 'trunk' THEN 2.0 ELSE 1.0 END::DOUBLE AS width FROM e")
def _plot_edges(w: World) -> DataFrame:
    keyed = w.edges.select("edge_id", "u", "v", "k", "highway")
    values = w.edges.filter("lane_count is not null").select("u", "v", "k", "lane_count").distinct()
    return plotdata.edge_values(keyed, values, "lane_count", default=1.0, widths={"motorway": 3.0, "trunk": 2.0}).select("edge_id", "lane_count", "width")


@query("stream_counts", " SELECT strftime(ts, '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _stream_counts(w: World) -> DataFrame:
    """The batch form of the windowed counts; the streaming form of the same expression is tested against it."""
    return counts.windowed(w.raw("events")).withColumn("total", F.round("total", 4)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("geo_measures", SHAPES + " SELECT cell_id, round(area, 3) AS area, round(cx, 3) AS x, round(cy, 3) AS y FROM total")
def _measures(w: World) -> DataFrame:
    g = w.raw("cells").filter("cell_id is not null").select("cell_id", geo.rings_of_wkt("geometry").alias("r")).distinct().filter(F.size("r") > 0)
    c = geo.centroid("r")
    return g.select("cell_id", number(geo.area("r"), 3).alias("area"), number(c["x"], 3).alias("x"), number(c["y"], 3).alias("y"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
