"""The tables behind maps: values by cell, tier membership of one origin, styled edges. Drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import finite


def cell_values(cells: DataFrame, values: DataFrame, value: str, *, cell: str = "cell_id") -> DataFrame:
    """Every cell with its value, null where undefined or infinite, and the least and greatest value over all cells."""
    v = F.when(finite(value), F.col(value).cast("double"))
    clean = values.select(cell, v.alias("value"))
    ends = clean.agg(F.min("value").alias("least"), F.max("value").alias("greatest"))
    return cells.join(clean, cell, "left").crossJoin(F.broadcast(ends))  # one row


def cell_comparison(cells: DataFrame, a: DataFrame, b: DataFrame, value: str, *, cell: str = "cell_id") -> DataFrame:
    """Two values per cell (``value_a``, ``value_b``) on one scale (``least``, ``greatest`` over both)."""
    v = F.when(finite(value), F.col(value).cast("double"))
    x, y = a.select(cell, v.alias("value_a")), b.select(cell, v.alias("value_b"))
    ends = x.select(F.col("value_a").alias("v")).unionByName(y.select(F.col("value_b").alias("v"))).agg(F.min("v").alias("least"), F.max("v").alias("greatest"))
    return cells.join(x, cell, "left").join(y, cell, "left").crossJoin(F.broadcast(ends))  # one row


def destinations_of(od: DataFrame, origin, cell_to_zone: DataFrame | None = None) -> DataFrame:
    """``(tier, dest)`` of one origin over all tiers, the far one through its zone."""
    near = od.filter((F.col("tier") != "zones_to_zones") & (F.col("origin") == F.lit(origin))).select("tier", "dest")
    if cell_to_zone is None:
        return near.distinct()
    home = cell_to_zone.filter(F.col("origin") == F.lit(origin)).select("zone_origin")
    far = od.filter(F.col("tier") == "zones_to_zones").join(F.broadcast(home), F.col("origin") == F.col("zone_origin"), "left_semi").select("tier", "dest")  # one zone
    return near.unionByName(far).distinct()


def edge_values(edges: DataFrame, values: DataFrame, value: str, *, default: float = 0.0, widths: dict[str, float] | None = None, highway: str = "highway", sort: str | None = None) -> DataFrame:
    """Edges with a value (``default`` where missing) and a line width by street class, in drawing order if ``sort`` is given."""
    out = edges.join(values.select("u", "v", "k", value), ["u", "v", "k"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))
    width = F.lit(1.0)
    for k, w in (widths or {}).items():
        width = F.when(F.col(highway) == k, float(w)).otherwise(width)
    out = out.withColumn("width", width)
    return out.orderBy(sort, "u", "v", "k") if sort else out
