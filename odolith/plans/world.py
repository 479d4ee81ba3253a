"""The tables of a data folder as clean inputs of the accessibility operators, in Spark and, for the checks, in SQL.

Exact duplicates count once, a pair delivered again counts as delivered last, rows without key or place are left out.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import first_whole
from ..operators import od as ods
from ..operators import routing
from ..schema import finite
from ..session import settled
from ..sources.tables import table


class World:
    """Lazy views of one data folder."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d = spark, d

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.d, name)

    @property
    def od(self) -> DataFrame:
        return ods.newest(self.raw("od_pairs"), ["run_id", "tier", "origin", "dest"], "loaded_at", ["cost", "pop", "emp"])

    @property
    def nodes(self) -> DataFrame:
        return self.raw("nodes").filter(F.col("node_id").isNotNull() & finite("x") & finite("y")).select("node_id", "x", "y", "is_traffic_signal").distinct()

    @property
    def cells(self) -> DataFrame:
        c = self.raw("cells").filter(F.col("cell_id").isNotNull() & finite("x") & finite("y"))
        num = lambda n: F.when(finite(n), F.col(n)).alias(n)
        return c.select("cell_id", "zone_id", "node_id", "x", "y", num("population"), num("employment_tertiary"), "building_count", "geometry").distinct()

    @property
    def zones(self) -> DataFrame:
        z = self.raw("zones").filter(F.col("zone_id").isNotNull() & F.col("node_id").isNotNull() & finite("x") & finite("y"))
        return z.select("zone_id", "node_id", "x", "y", F.when(finite("population"), F.col("population")).alias("population")).distinct()

    @property
    def edges(self) -> DataFrame:
        e = self.raw("edges").select("edge_id", "u", "v", "k", "way_id", "length", "speed_kph", "highway", "lanes", "oneway").distinct()
        return e.withColumn("lane_count", first_whole("lanes", 1, 12).cast("double"))

    @property
    def pois(self) -> DataFrame:
        return self.raw("pois").select("osm_id", "amenity", "shop", "railway", "highway", "x", "y").distinct()

    @property
    def cell_to_zone(self) -> DataFrame:
        return ods.cell_to_zone(self.cells, self.zones)

    @cached_property
    def graph(self) -> DataFrame:
        """The collapsed network, written once: it is counted, then sent out or joined."""
        return settled(routing.collapse(self.edges, "length", ["lane_count", "length"], oneway="oneway"))

    def pairs(self) -> DataFrame:
        return ods.tiered_pairs(self.cells, self.zones, 700.0, 2500.0, 1300.0)

    @cached_property
    def written_pairs(self) -> DataFrame:
        """The pairs as a table, for plans that both route and value them."""
        return settled(self.pairs())


SQL = """
WITH RECURSIVE od AS (
  SELECT run_id, tier, origin, dest, cost, pop, emp FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, tier, origin, dest ORDER BY loaded_at DESC) AS newest FROM od_pairs) WHERE newest = 1
), n AS (
  SELECT DISTINCT node_id, x, y, is_traffic_signal FROM nodes WHERE node_id IS NOT NULL AND isfinite(x) AND isfinite(y)
), c AS (
  SELECT DISTINCT cell_id, zone_id, node_id, x, y, CASE WHEN isfinite(population) THEN population END AS population,
    CASE WHEN isfinite(employment_tertiary) THEN employment_tertiary END AS employment_tertiary, building_count, geometry
  FROM cells WHERE cell_id IS NOT NULL AND isfinite(x) AND isfinite(y)
), z AS (
  SELECT DISTINCT zone_id, node_id, x, y, CASE WHEN isfinite(population) THEN population END AS population
  FROM zones WHERE zone_id IS NOT NULL AND node_id IS NOT NULL AND isfinite(x) AND isfinite(y)
), lane AS (
  SELECT DISTINCT edge_id, u, v, k, way_id, length, speed_kph, highway, lanes, oneway,
    TRY_CAST(nullif(regexp_extract(lanes, '-?[0-9]+([.][0-9]+)?', 0), '') AS DOUBLE) AS number FROM edges
), e AS (SELECT *, CASE WHEN number = floor(number) AND number BETWEEN 1 AND 12 THEN number END AS lane_count FROM lane),
ctz AS (SELECT c.node_id AS origin, arg_max(z.node_id, cell_id) AS zone_origin FROM c JOIN z USING (zone_id) WHERE c.node_id IS NOT NULL GROUP BY c.node_id),
st AS (
  SELECT run_id, origin, dest, cost, pop, emp FROM od WHERE tier = 'cells_to_cells'
  UNION ALL
  SELECT run_id, origin, dest, cost, pop, emp FROM od WHERE tier = 'cells_to_zones' AND (run_id, origin) IN (SELECT run_id, origin FROM od WHERE tier = 'cells_to_cells')
  UNION ALL
  SELECT f.run_id, o.origin, f.dest, f.cost, f.pop, f.emp
  FROM (SELECT DISTINCT run_id, origin FROM od WHERE tier = 'cells_to_cells') o JOIN ctz USING (origin) JOIN od f ON f.run_id = o.run_id AND f.origin = zone_origin AND f.tier = 'zones_to_zones'
), both_ways AS (
  SELECT u, v, k, length, lane_count FROM e WHERE isfinite(length) AND length >= 0 AND u IS NOT NULL AND v IS NOT NULL AND u <> v
  UNION ALL
  SELECT v, u, k, length, lane_count FROM e WHERE isfinite(length) AND length >= 0 AND u IS NOT NULL AND v IS NOT NULL AND u <> v AND NOT coalesce(oneway, false)
), g AS (
  SELECT u, v, length AS w, lane_count FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY length, k, lane_count NULLS FIRST) AS best FROM both_ways) WHERE best = 1
), zz AS (
  SELECT a.zone_id AS zo, a.node_id AS no, b.zone_id AS zd, b.node_id AS nd, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
  FROM z a JOIN z b ON abs(a.x - b.x) <= 2500 AND abs(a.y - b.y) <= 2500 WHERE a.zone_id IN (SELECT zone_id FROM c WHERE node_id IS NOT NULL)
), pairs AS (
  SELECT DISTINCT 'cells_to_cells' AS tier, o.node_id AS origin, t.node_id AS dest
  FROM zz JOIN c o ON o.zone_id = zo JOIN c t ON t.zone_id = zd WHERE (zo = zd OR d < 700) AND o.node_id IS NOT NULL AND t.node_id IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'cells_to_zones', o.node_id, nd FROM zz JOIN c o ON o.zone_id = zo WHERE zo <> zd AND d >= 700 AND d < 1300 AND o.node_id IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'zones_to_zones', no, nd FROM zz WHERE zo <> zd AND d >= 1300 AND d < 2500
)
"""
