"""Queries on nearness, orphan references and filled values over the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import NOTHING, SEPARATORS, first_whole, is_missing
from ..operators import impute, proximity, references
from ..schema import union_all
from ..session import settled, small
from ..sources.tables import table

NEAR, REACH = 15.0, 60.0


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """``near`` nodes, the cell around (``within``) each poi, and the further nodes in ``reach`` of each cell."""
    nodes, cells, pois = (table(spark, d, t) for t in ("nodes", "cells", "pois"))
    text = lambda c: F.col(c).cast("string")
    pts = proximity.points(nodes, "node_id")
    near = proximity.near_pairs(pts, NEAR).select(F.lit("near").alias("rel"), text("left_id").alias("left_id"), text("right_id").alias("right_id"))
    within = proximity.inside(proximity.points(pois, "osm_id"), proximity.regions(cells, "cell_id", "geometry"))
    within = within.select(F.lit("within").alias("rel"), text("left_id").alias("left_id"), text("right_id").alias("right_id"))
    reach = proximity.within_distance(proximity.points(cells, "cell_id", own="node_id"), pts, REACH)
    reach = reach.filter(~F.col("left_own").eqNullSafe(F.col("right_id"))).select(F.lit("reach").alias("rel"), text("left_id").alias("left_id"), text("right_id").alias("right_id"))
    return union_all(near.distinct(), within.distinct(), reach.distinct())


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    cells, legs, nodes, zones = (table(spark, d, t) for t in ("cells", "legs", "nodes", "zones"))

    def refs(df: DataFrame, tbl: str, key: str, at: str, *fields: str) -> DataFrame:
        pairs = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("ref")) for f in fields]))
        return df.select(F.lit(tbl).alias("tbl"), F.col(key).cast("string").alias("rec_key"), F.col(at).alias("at"), pairs)

    to_nodes = union_all(refs(cells, "cells", "cell_id", "snapped_at", "node_id"), refs(legs, "legs", "trip_id", "measured_at", "nx_node_orig", "nx_node_dest"))
    found = union_all(
        references.orphans(to_nodes, nodes, ref="ref", at="at", spread="rec_key", key="node_id").drop("ref"),
        references.orphans(refs(cells, "cells", "cell_id", "snapped_at", "zone_id"), zones, ref="ref", at="at", spread="rec_key", key="zone_id").drop("ref"),
    )
    return found.select("tbl", "field", F.date_format("at", "yyyy-MM").alias("period"), "kind", "rec_key").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field, month and kind."""
    return _orphans(spark, d).groupBy("tbl", "field", "period", "kind").agg(F.count(F.lit(1)).alias("references"))


def _completed(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges")
    listed = table(spark, d, "tag_values").filter("tag_key = 'highway' and tag_value is not null").select(F.col("tag_value").alias("highway"), F.lit(True).alias("__listed")).distinct()
    edges = edges.join(small(settled(listed)), "highway", "left")
    fields = [impute.Field("highway", F.when(~is_missing("highway"), F.col("highway")), F.col("__listed")), impute.Field("lanes", first_whole("lanes", 1, 12), number=(1, 12))]
    speed = F.when(F.col("speed_kph").isNotNull() & ~F.isnan("speed_kph"), F.floor(F.col("speed_kph") / 10))
    return impute.chained(edges, "edge_id", "way_id", fields, {"speed": speed, "oneway": F.col("oneway"), "parallel": F.col("k")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """What the chained equations fill on the evidence of the street."""
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("filled_value"), F.col(f"{f}_by").alias("by")) for f in ("highway", "lanes")]))
    return _completed(spark, d).select("edge_id", each).filter("by = 'group'").select("edge_id", "field", "filled_value").distinct()


def p5_completed(spark: SparkSession, d: str) -> DataFrame:
    """Every edge with both fields completed, by its street or else by seeded draws from the fitted models, and marks of what was filled."""
    return _completed(spark, d)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Per field how many edges knew it, had it filled by their street, by the chain, or not at all."""
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f"{f}_by"), F.when(F.col(f).isNotNull(), "known").otherwise("empty")).alias("by")) for f in ("highway", "lanes")]))
    return _completed(spark, d).select(each).groupBy("field", "by").agg(F.count(F.lit(1)).alias("edges"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (p2_found, p3_found, p3_report, p5_found, p5_completed, p5_report)}


_P2 = f"""
WITH n AS (SELECT DISTINCT node_id, x, y FROM nodes WHERE node_id IS NOT NULL AND isfinite(x) AND isfinite(y)),
p AS (SELECT DISTINCT osm_id, x, y FROM pois WHERE osm_id IS NOT NULL AND isfinite(x) AND isfinite(y)),
c AS (SELECT DISTINCT cell_id, node_id, x, y FROM cells WHERE cell_id IS NOT NULL AND isfinite(x) AND isfinite(y)),
ring AS (
  SELECT cell_id, ring_no, list_transform(string_split(t, ','), lambda s: list_transform(string_split(trim(s), ' '), lambda v: CAST(v AS DOUBLE))) AS pts
  FROM (SELECT cell_id, generate_subscripts(ts, 1) AS ring_no, unnest(ts) AS t FROM (
    SELECT DISTINCT cell_id, regexp_extract_all(regexp_replace(geometry, '\\s+', ' ', 'g'), '\\(([^()]+)\\)', 1) AS ts FROM cells WHERE cell_id IS NOT NULL))
), edge AS (
  SELECT cell_id, pts[i][1] AS x1, pts[i][2] AS y1, pts[i + 1][1] AS x2, pts[i + 1][2] AS y2
  FROM (SELECT cell_id, pts, unnest(range(1, len(pts))) AS i FROM ring)
), box AS (SELECT cell_id, min(x1) AS x0, max(x1) AS x1, min(y1) AS y0, max(y1) AS y1 FROM edge GROUP BY cell_id),
maybe AS (SELECT osm_id, cell_id, x, y FROM p JOIN box ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1),
odd AS (
  SELECT osm_id, cell_id FROM maybe JOIN edge USING (cell_id)
  WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) / (y2 - y1) * (x2 - x1)
  GROUP BY osm_id, cell_id HAVING count(*) % 2 = 1
)
SELECT 'near' AS rel, CAST(a.node_id AS VARCHAR) AS left_id, CAST(b.node_id AS VARCHAR) AS right_id
FROM n a JOIN n b ON a.node_id < b.node_id AND b.x BETWEEN a.x - {NEAR} AND a.x + {NEAR} AND b.y BETWEEN a.y - {NEAR} AND a.y + {NEAR}
WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {NEAR}
UNION ALL
SELECT 'within', CAST(osm_id AS VARCHAR), cell_id FROM odd
UNION ALL
SELECT DISTINCT 'reach', cell_id, CAST(n.node_id AS VARCHAR)
FROM c JOIN n ON n.x BETWEEN c.x - {REACH} AND c.x + {REACH} AND n.y BETWEEN c.y - {REACH} AND c.y + {REACH}
WHERE sqrt((c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y)) <= {REACH} AND c.node_id IS DISTINCT FROM n.node_id
"""

_P3 = """
WITH refs AS (
  SELECT 'cells' AS tbl, 'node_id' AS field, cell_id AS rec_key, CAST(node_id AS VARCHAR) AS ref, snapped_at AS t FROM cells
  UNION SELECT 'cells', 'zone_id', cell_id, zone_id, snapped_at FROM cells
  UNION SELECT 'legs', 'nx_node_orig', CAST(trip_id AS VARCHAR), CAST(nx_node_orig AS VARCHAR), measured_at FROM legs
  UNION SELECT 'legs', 'nx_node_dest', CAST(trip_id AS VARCHAR), CAST(nx_node_dest AS VARCHAR), measured_at FROM legs
), parents AS (
  SELECT DISTINCT 'zone_id' AS to_field, zone_id AS key, loaded_at, removed_at FROM zones
  UNION ALL SELECT DISTINCT 'node_id', CAST(node_id AS VARCHAR), loaded_at, removed_at FROM nodes
), judged AS (
  SELECT tbl, field, strftime(t, '%Y-%m') AS period, rec_key,
    CASE WHEN key IS NULL THEN 'missing' WHEN removed_at <= t THEN 'deleted' WHEN p.loaded_at > t THEN 'late' END AS kind
  FROM refs LEFT JOIN parents p ON ref = key AND to_field = CASE field WHEN 'zone_id' THEN 'zone_id' ELSE 'node_id' END
  WHERE ref IS NOT NULL
)
"""

_NOTHING = ", ".join(f"'{x}'" for x in NOTHING)
_P5 = rf"""
WITH e AS (
  SELECT DISTINCT edge_id, way_id, highway, lanes,
    highway IS NULL OR trim(regexp_replace(lower(highway), '{SEPARATORS}', ' ', 'g')) IN ({_NOTHING}) AS no_highway,
    TRY_CAST(nullif(regexp_extract(lanes, '-?[0-9]+([.][0-9]+)?', 0), '') AS DOUBLE) AS number
  FROM edges
), k AS (SELECT *, CASE WHEN number = floor(number) AND number BETWEEN 1 AND 12 THEN CAST(number AS INTEGER) END AS n FROM e),
h AS (
  SELECT way_id, highway, row_number() OVER (PARTITION BY way_id ORDER BY count(*) DESC, encode(highway)) AS best
  FROM k WHERE highway IN (SELECT tag_value FROM tag_values WHERE tag_key = 'highway') GROUP BY way_id, highway
), l AS (
  SELECT way_id, n, row_number() OVER (PARTITION BY way_id ORDER BY count(*) DESC, n) AS best FROM k WHERE n IS NOT NULL GROUP BY way_id, n
)
"""
_P5_FOUND = """
SELECT DISTINCT edge_id, 'highway' AS field, h.highway AS filled_value FROM k JOIN h USING (way_id) WHERE no_highway AND best = 1
UNION ALL
SELECT DISTINCT edge_id, 'lanes', CAST(l.n AS VARCHAR) FROM k JOIN l USING (way_id) WHERE k.n IS NULL AND best = 1
"""
# every edge that is neither known nor on a street that tells is left to the models, which fill all they are asked
_P5_REPORT = """
SELECT 'highway' AS field, CASE WHEN NOT no_highway THEN 'known' WHEN h.highway IS NOT NULL THEN 'group' ELSE 'chain' END AS "by", count(*) AS edges
FROM k LEFT JOIN h ON h.way_id = k.way_id AND best = 1 WHERE edge_id IS NOT NULL GROUP BY ALL
UNION ALL
SELECT 'lanes', CASE WHEN k.n IS NOT NULL THEN 'known' WHEN l.n IS NOT NULL THEN 'group' ELSE 'chain' END, count(*)
FROM k LEFT JOIN l ON l.way_id = k.way_id AND best = 1 WHERE edge_id IS NOT NULL GROUP BY ALL
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2,
        "p3_found": _P3 + "SELECT DISTINCT tbl, field, period, kind, rec_key FROM judged WHERE kind IS NOT NULL",
        "p3_report": _P3 + 'SELECT tbl, field, period, kind, count(*) AS "references" FROM (SELECT DISTINCT * FROM judged WHERE kind IS NOT NULL) GROUP BY ALL',
        "p5_found": _P5 + _P5_FOUND,
        "p5_report": _P5 + _P5_REPORT,
    }
