"""First- and last-mile overheads: aggregating them to nodes and groups, and adding them to pair costs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..schema import CELLS, NAN, ZONES, finite, known, union_all
from .routing import costs as route_costs


def linear(constant: float, coefficients: dict[str, float]) -> Column:
    """``constant + sum(coefficient * column)``; an undefined column counts as 0."""
    out = F.lit(float(constant))
    for name, c in coefficients.items():
        out = out + F.lit(float(c)) * F.coalesce(known(F.col(name).cast("double")), F.lit(0.0))
    return out


def _mean(value: Column, weight: Column | None) -> Column:
    """Mean of the finite values; weighted over finite weights above 0; NaN without any."""
    if weight is None:
        return F.coalesce(F.avg(F.when(finite(value), value)), F.lit(NAN))
    ok = finite(value) & finite(weight) & (weight > 0)
    return F.coalesce(F.sum(F.when(ok, value * weight)) / F.nullif(F.sum(F.when(ok, weight)), F.lit(0.0)), F.lit(NAN))


def per_node(cells: DataFrame, overhead: str, *, node: str = "node_id", weight: str | None = None) -> DataFrame:
    """``(node, overhead)``: the (weighted) mean over the cells of each node."""
    return cells.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(_mean(F.col(overhead).cast("double"), None if weight is None else F.col(weight).cast("double")).alias("overhead"))


def per_group_straight(cells: DataFrame, groups: DataFrame, speed: float, *, group: str = "zone_id", overhead: str | None = None, weight: str | None = None) -> DataFrame:
    """``(group, overhead)`` of every group: the (weighted) mean over its cells of their overhead plus the straight way to
    the group's point at ``speed``; NaN for a group without cells."""
    if not speed > 0:
        raise ValueError("speed must be positive")
    at = groups.select(F.col(group).alias("group"), F.col("x").alias("gx"), F.col("y").alias("gy"))
    own = F.col(overhead).cast("double") if overhead else F.lit(0.0)
    c = cells.select(F.col(group).alias("group"), "x", "y", own.alias("own"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    met = at.join(c, "group", "left").withColumn("v", F.col("own") + geo.distance(F.col("x"), F.col("y"), F.col("gx"), F.col("gy")) / speed)
    return met.groupBy("group").agg(_mean(F.col("v"), F.col("w") if weight else None).alias("overhead"))


def per_group_routed(cells: DataFrame, groups: DataFrame, graph: DataFrame, *, group: str = "zone_id", node: str = "node_id", overhead: str | None = None, weight: str | None = None, cutoff: float = float("inf")) -> DataFrame:
    """As ``per_group_straight`` with the routed cost from the group's node to each cell's node; unreachable cells do not count."""
    at = groups.select(F.col(group).alias("group"), F.col(node).alias("origin"))
    own = F.col(overhead).cast("double") if overhead else F.lit(0.0)
    c = cells.filter(F.col(node).isNotNull()).select(F.col(group).alias("group"), F.col(node).alias("dest"), own.alias("own"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    met = at.join(c, "group", "left")
    routed = route_costs(met.filter("origin is not null and dest is not null").select("origin", "dest").distinct(), graph, cutoff=cutoff)
    out = met.join(routed, ["origin", "dest"], "left").withColumn("v", F.col("own") + F.col("cost"))
    return out.groupBy("group").agg(_mean(F.col("v"), F.col("w") if weight else None).alias("overhead"))


def _add(od: DataFrame, tables: Sequence[tuple[str, Column, DataFrame | None]]) -> DataFrame:
    """Add looked-up overheads, each by a column of the pair where its condition holds; a key that a table lacks adds 0."""
    out = od
    for side in ("origin", "dest"):  # one join a side: its tables become columns of one
        mine = [(i, where, t) for i, (at, where, t) in enumerate(tables) if at == side and t is not None]
        if not mine:
            continue
        long = union_all(*[t.select(F.col(t.columns[0]).alias(side), F.lit(i).alias("__i"), F.col(t.columns[1]).cast("double").alias("__o")) for i, _, t in mine])
        table = long.groupBy(side).agg(*[F.max(F.when(F.col("__i") == i, F.col("__o"))).alias(f"__o{i}") for i, _, _ in mine])
        out = out.join(table, side, "left")
        for i, where, _ in mine:
            out = out.withColumn("cost", F.col("cost") + F.when(where, F.coalesce(f"__o{i}", F.lit(0.0))).otherwise(0.0))
        out = out.drop(*[f"__o{i}" for i, _, _ in mine])
    return out.select(od.columns)


def add_node(od: DataFrame, *, origin: DataFrame | None = None, dest_cell: DataFrame | None = None, dest_zone: DataFrame | None = None) -> DataFrame:
    """Costs plus overheads by node, tables ``(node, overhead)``: ``origin`` at all tiers, ``dest_cell`` where the destination is
    a cell, ``dest_zone`` where it is a zone."""
    to_cell = F.col("tier") == CELLS
    return _add(od, [("origin", F.lit(True), origin), ("dest", to_cell, dest_cell), ("dest", ~to_cell, dest_zone)])


def add_geo(od: DataFrame, *, origin_cell: DataFrame | None = None, origin_zone: DataFrame | None = None, dest_cell: DataFrame | None = None, dest_zone: DataFrame | None = None) -> DataFrame:
    """Costs plus overheads by unit, tables ``(unit, overhead)``, each at the tiers where that end is such a unit."""
    to_cell, from_zone = F.col("tier") == CELLS, F.col("tier") == ZONES
    return _add(od, [("origin", ~from_zone, origin_cell), ("origin", from_zone, origin_zone), ("dest", to_cell, dest_cell), ("dest", ~to_cell, dest_zone)])


def add_origin_cell(od: DataFrame, cells: DataFrame, overhead: str, *, cell: str = "cell_id", zone: str = "zone_id", how: Callable[[Column], Column] = F.avg) -> DataFrame:
    """Costs in geo space plus the origin cell's overhead; at the far tier that of its zone, by default the cells' mean."""
    value = known(F.col(overhead).cast("double"))
    by_cell = cells.groupBy(cell).agg(F.min(value).alias("overhead"))
    by_zone = cells.filter(F.col(zone).isNotNull()).groupBy(zone).agg(how(value).alias("overhead"))
    return add_geo(od, origin_cell=by_cell, origin_zone=by_zone)


def add_trip(od: DataFrame, cell_info: DataFrame, *, zone_info: DataFrame | None = None, node: str = "node_id", origin: Column | None = None, dest: Column | None = None, verify: bool = True) -> DataFrame:
    """Costs plus expressions over the info row of either end (one row a node; cells' or zones' by tier).

    ``origin`` and ``dest`` are Columns over the info table's columns. With ``verify`` an overhead that is not finite, also for
    want of an info row, is an error; infinite costs stay infinite.
    """
    kinds = [cell_info.withColumn("__kind", F.lit("cell"))]
    if zone_info is not None:
        kinds.append(zone_info.withColumn("__kind", F.lit("zone")))
    out = od
    for side, value, zone_tier in (("origin", origin, F.col("tier") == ZONES), ("dest", dest, F.col("tier") != CELLS)):
        if value is None:
            continue
        name = f"__{side}_overhead"
        parts = [k.select(F.col("__kind"), F.col(node).alias(side), value.cast("double").alias(name)) for k in kinds]
        table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        out = out.withColumn("__kind", F.when(zone_tier, "zone").otherwise("cell")).join(table, ["__kind", side], "left").drop("__kind")
        v = F.col(name)
        if verify:
            v = F.when(finite(v), v).otherwise(F.raise_error(F.lit(f"{side} overhead is not finite")).cast("double"))
        out = out.withColumn("cost", F.col("cost") + v)
    return out.select(od.columns)
