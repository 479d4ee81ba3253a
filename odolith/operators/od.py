"""Tiered origin-destination pairs in long form: building, filtering, valuing, lifting and describing them.

A pair table has ``tier``, ``origin``, ``dest`` and value columns. Keys are network nodes (node space) or cells and zones
(geo space); ``cells_to_cells`` and ``cells_to_zones`` start at cells, ``zones_to_zones`` at zones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..schema import CELLS, INF, MIDDLE, TIERS, ZONES, DataError, col, finite, require, union_all
from .proximity import within_distance

KEY = ("tier", "origin", "dest")


def newest(df: DataFrame, key: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Per key the row delivered last; equal times are settled by the larger values."""
    best = F.max(F.struct(F.col(at).alias("at"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]))
    return df.groupBy(*key).agg(best.alias("best")).select(*key, *[F.col(f"best.v{i}").alias(v) for i, v in enumerate(values)])


def radii(r_cells: float, r_zones: float, r_medium: float | None = None) -> tuple[float, float, float]:
    """The three radii in order; the middle one is by default ten times the first, at most the last."""
    r_medium = min(10 * r_cells, r_zones) if r_medium is None else r_medium
    if not 0 <= r_cells <= r_medium <= r_zones:
        raise ValueError("radii must satisfy 0 <= r_cells <= r_medium <= r_zones")
    return r_cells, r_medium, r_zones


def cell_pairs(cells: DataFrame, r_cells: float, *, cell: str = "cell_id", node: str = "node_id", origins: Column | None = None, destinations: Column | None = None) -> DataFrame:
    """Pairs of nodes nearer than ``r_cells`` (strictly), self-pairs included. A node lies at the mean of its cells' points;
    ``origins`` and ``destinations`` are predicates on cells that limit either side to the nodes of the cells they hold for.

    Cells without node or point contribute nothing. Cells are reduced to nodes before the join, so cells that share a
    node cost one row.
    """
    require(cells, cell, node, "x", "y")
    here = cells.filter(F.col(node).isNotNull() & finite("x") & finite("y"))
    flags = [F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in (("is_orig", origins), ("is_dest", destinations)) if c is not None]
    at = here.groupBy(F.col(node).alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), *flags)
    left = (at.filter("is_orig") if origins is not None else at).select("id", "x", "y")
    right = (at.filter("is_dest") if destinations is not None else at).select("id", "x", "y")
    return within_distance(left, right, r_cells, strict=True).select(F.lit(CELLS).alias("tier"), F.col("left_id").alias("origin"), F.col("right_id").alias("dest"))


def tiered_pairs(cells: DataFrame, zones: DataFrame, r_cells: float, r_zones: float, r_medium: float | None = None, *, zone: str = "zone_id", node: str = "node_id", origins: Column | None = None, destinations: Column | None = None, dest_zones: Column | None = None) -> DataFrame:
    """Distinct node pairs of all three tiers, by the distance of the zones' centres: below ``r_cells``, or within one
    zone, cells to cells; below ``r_medium`` cells to the other zone; below ``r_zones`` zone to zone.

    ``origins`` and ``destinations`` are predicates on cells, ``dest_zones`` one on zones. Cells without node or without a zone
    of the list, and zones without node or centre, contribute nothing.
    """
    r_cells, r_medium, r_zones = radii(r_cells, r_zones, r_medium)
    z = zones.filter(F.col(zone).isNotNull() & F.col(node).isNotNull() & finite("x") & finite("y"))
    z = z.select(F.col(zone).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(node).alias("znode"), (F.lit(True) if dest_zones is None else F.coalesce(dest_zones, F.lit(False))).alias("wanted")).distinct()
    units = cells.filter(F.col(node).isNotNull())
    by_zone = lambda p: (units if p is None else units.filter(p)).select(F.col(zone).alias("zid"), F.col(node).alias("cnode")).distinct()
    starts, ends = by_zone(origins), by_zone(destinations)
    # zones without an origin never start a pair
    active = z.join(starts.select(F.col("zid").alias("id")).distinct(), "id", "left_semi")
    pairs = within_distance(active, z, r_zones, strict=True) if r_zones > 0 else None
    same = active.select(F.col("id").alias("left_id"), F.col("znode").alias("left_znode"), F.col("id").alias("right_id"), F.col("znode").alias("right_znode"), F.col("wanted").alias("right_wanted"), F.lit(0.0).alias("distance"))
    if pairs is not None:
        same = same.unionByName(pairs.filter(F.col("left_id") != F.col("right_id")).select(same.columns))
    d = F.col("distance")
    tier = F.when((F.col("left_id") == F.col("right_id")) | (d < r_cells), CELLS).when(d < r_medium, MIDDLE).otherwise(ZONES)
    zz = same.withColumn("tier", tier)
    out_of = zz.join(starts.withColumnRenamed("zid", "left_id").withColumnRenamed("cnode", "origin"), "left_id")
    near = out_of.filter(F.col("tier") == CELLS).join(ends.withColumnRenamed("zid", "right_id").withColumnRenamed("cnode", "dest"), "right_id").select(*KEY)
    middle = out_of.filter((F.col("tier") == MIDDLE) & F.col("right_wanted")).select("tier", "origin", F.col("right_znode").alias("dest"))
    far = zz.filter((F.col("tier") == ZONES) & F.col("right_wanted")).select("tier", F.col("left_znode").alias("origin"), F.col("right_znode").alias("dest"))
    return union_all(near, middle, far).distinct()


def cell_to_zone(cells: DataFrame, zones: DataFrame, *, cell: str = "cell_id", zone: str = "zone_id", node: str = "node_id") -> DataFrame:
    """``(origin, zone_origin)``: the zone node of each cell node. A node of cells in several zones takes that of the
    largest cell id; nodes whose zones have no node are left out."""
    z = zones.filter(F.col(node).isNotNull()).select(zone, F.col(node).alias("zone_origin")).distinct()
    met = cells.filter(F.col(node).isNotNull()).select(F.col(cell).alias("cell"), zone, F.col(node).alias("origin")).join(z, zone)
    return met.groupBy("origin").agg(F.max(F.struct("cell", "zone_origin")).alias("m")).select("origin", F.col("m.zone_origin").alias("zone_origin"))


def node_sums(units: DataFrame, columns: Sequence[str], node: str = "node_id") -> DataFrame:
    """Sums of unit values per node (``dest``); units without a node are left out, null and NaN count as nothing."""
    sums = [F.sum(F.when(~F.isnan(F.col(c)), F.col(c))).alias(c) for c in columns]
    return units.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("dest")).agg(*sums)


def node_values(units: DataFrame, column: str, wanted: DataFrame, node: str = "node_id") -> DataFrame:
    """``wanted`` nodes (``dest``) with their summed value; DataError if one of them has no unit."""
    out = wanted.join(node_sums(units, [column], node).withColumn("there", F.lit(True)), "dest", "left")
    return out.withColumn(column, F.when(F.coalesce("there", F.lit(False)), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("no unit at node "), F.col("dest").cast("string"))).cast("double"))).drop("there")


def dest_values(pairs: DataFrame, columns: Sequence[str], cells: DataFrame, zones: DataFrame | None = None, *, node: str = "node_id") -> DataFrame:
    """Values of each pair's destination: sums over the cells, or at zone tiers the zones, at that node; null where there
    is none. One join over all tiers: the tier's kind of unit is part of the key."""
    kinds = [node_sums(cells, columns, node).withColumn("kind", F.lit("cell"))]
    if zones is not None:
        kinds.append(node_sums(zones, columns, node).withColumn("kind", F.lit("zone")))
    kind = F.when(F.col("tier") == CELLS, "cell").otherwise("zone")
    return pairs.withColumn("kind", kind).join(union_all(*kinds), ["kind", "dest"], "left").drop("kind").select(*pairs.columns, *columns)


def dest_values_geo(pairs: DataFrame, columns: Sequence[str], cells: DataFrame, zones: DataFrame | None = None, *, cell: str = "cell_id", zone: str = "zone_id") -> DataFrame:
    """Values of each pair's destination unit in geo space, as they are; of a unit with several rows those of the least one."""
    unit = lambda df, k, key: df.groupBy(F.lit(k).alias("kind"), F.col(key).alias("dest")).agg(F.min(F.struct(*columns)).alias("v")).select("kind", "dest", *[F.col(f"v.{c}").alias(c) for c in columns])
    kinds = [unit(cells, "cell", cell), *([unit(zones, "zone", zone)] if zones is not None else [])]
    kind = F.when(F.col("tier") == CELLS, "cell").otherwise("zone")
    return pairs.withColumn("kind", kind).join(union_all(*kinds), ["kind", "dest"], "left").select(*pairs.columns, *columns)


def to_geo_units(pairs: DataFrame, cells: DataFrame, zones: DataFrame | None = None, *, cell: str = "cell_id", cell_node: str = "node_id", zone: str = "zone_id", zone_node: str = "node_id") -> DataFrame:
    """Pairs lifted from nodes to the units that sit on them, values repeated for every unit of either side."""
    unit = lambda df, kind, key, node: df.filter(F.col(node).isNotNull() & F.col(key).isNotNull()).select(F.lit(kind).alias("kind"), F.col(node).alias("node"), F.col(key).alias("unit")).distinct()
    units = unit(cells, "cell", cell, cell_node)
    if zones is not None:
        units = units.unionByName(unit(zones, "zone", zone, zone_node))
    values = [c for c in pairs.columns if c not in KEY]
    side = pairs.withColumn("from_kind", F.when(F.col("tier") == ZONES, "zone").otherwise("cell")).withColumn("to_kind", F.when(F.col("tier") == CELLS, "cell").otherwise("zone"))
    a = units.select(F.col("kind").alias("from_kind"), F.col("node").alias("origin"), F.col("unit").alias("from_unit"))
    b = units.select(F.col("kind").alias("to_kind"), F.col("node").alias("dest"), F.col("unit").alias("to_unit"))
    met = side.join(a, ["from_kind", "origin"]).join(b, ["to_kind", "dest"])
    return met.select("tier", F.col("from_unit").alias("origin"), F.col("to_unit").alias("dest"), *values)


def euclidean(pairs: DataFrame, nodes: DataFrame, *, node: str = "node_id", name: str = "distance") -> DataFrame:
    """Straight distance of each pair; an unknown node is an error."""
    at = nodes.select(F.col(node).alias("node"), F.col("x").alias("x"), F.col("y").alias("y"))
    o = at.select(F.col("node").alias("origin"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    t = at.select(F.col("node").alias("dest"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    met = pairs.join(o, "origin", "left").join(t, "dest", "left")
    known = F.col("ox").isNotNull() & F.col("dx").isNotNull()
    d = F.when(known, geo.distance(F.col("ox"), F.col("oy"), F.col("dx"), F.col("dy"))).otherwise(F.raise_error(F.lit("a pair has a node without coordinates")).cast("double"))
    return met.select(*pairs.columns, d.alias(name))


def masked(pairs: DataFrame, rule: Callable[[Column], Column], value: str = "cost", name: str = "mask") -> DataFrame:
    """A boolean column: whether the rule holds for the value; false where it is undefined."""
    return pairs.withColumn(name, F.coalesce(rule(F.col(value)), F.lit(False)))


def max_cost(costs: DataFrame, value: str = "cost", by: Sequence[str] = ()) -> DataFrame:
    """The largest finite cost, 0.0 if there is none: the cutoff that loses nothing in a later search."""
    agg = F.coalesce(F.max(F.when(finite(value), F.col(value))), F.lit(0.0)).alias("max_cost")
    return costs.groupBy(*by).agg(agg) if by else costs.agg(agg)


def describe(od: DataFrame, value: str = "cost", by: Sequence[str] = ()) -> DataFrame:
    """Per tier: entries, distinct origins, non-finite entries, and of the finite ones mean, median, 5 %, 95 %, least and
    greatest; of a boolean column the share that is true."""
    if dict(od.dtypes)[value] == "boolean":
        return od.groupBy(*by, "tier").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("origin").alias("origins"), F.avg(F.col(value).cast("double")).alias("true_share"))
    v = F.when(finite(value), F.col(value))
    stats = [F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile(v, 0.05).alias("p5"), F.percentile(v, 0.95).alias("p95"), F.min(v).alias("least"), F.max(v).alias("greatest")]
    return od.groupBy(*by, "tier").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("origin").alias("origins"), F.count_if(v.isNull()).alias("non_finite"), *stats)


def across_modes(modes: DataFrame, how: str | Callable[[dict[str, Column]], Column] = "min", *, mode: str = "mode", value: str = "cost", scale: float = 1.0, fill: float = INF, names: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One value per pair over all modes: the full outer union of their pairs, a missing mode counting as ``fill``
    (``+inf`` for costs, ``-inf`` for utilities).

    ``min`` takes the least cost; ``logsum`` is ``-scale * ln(sum(exp(-cost / scale)))``, computed around the least cost so
    that it neither overflows nor vanishes; a callable gets one Column per mode name. Null values count as ``fill``.
    """
    v = F.coalesce(col(value).cast("double"), F.lit(fill))
    group = modes.groupBy(*by, *KEY)
    if how == "min":
        return group.agg(F.min(v).alias(value))
    if how == "logsum":
        one = group.agg(F.min(v).alias("low"), F.collect_list(v).alias("all"))  # one entry a mode: a handful
        gap = F.aggregate("all", F.lit(0.0), lambda a, c: a + F.when(F.col("low") < INF, F.exp((F.col("low") - c) / scale)).otherwise(0.0))
        return one.select(*by, *KEY, F.when(F.col("low") < INF, F.col("low") - scale * F.log(gap)).otherwise(INF).alias(value))
    if not names:
        raise ValueError("a custom aggregation needs the names of the modes")
    wide = group.agg(*[F.max(F.when(F.col(mode) == n, v)).alias(f"m{i}") for i, n in enumerate(names)])
    return wide.select(*by, *KEY, how({n: F.coalesce(F.col(f"m{i}"), F.lit(fill)) for i, n in enumerate(names)}).alias(value))


def check_same_tiers(modes: DataFrame, mode: str = "mode") -> None:
    """DataError unless all modes have the same tiers. Sets of tiers are reduced before they reach the driver: the first two
    different ones tell."""
    sets = {tuple(r.tiers) for r in modes.groupBy(mode).agg(F.sort_array(F.collect_set("tier")).alias("tiers")).select("tiers").distinct().orderBy("tiers").take(2)}
    if len(sets) > 1:
        raise DataError(f"modes differ in their tiers: {sorted(sets)}")
    unknown = {t for s in sets for t in s} - set(TIERS)
    if unknown:
        raise DataError(f"unknown tiers {sorted(unknown)}")


