"""Cutting points of interest and networks out of larger extracts, read from files, and bringing them to planar metres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.poi import Categories, categorize
from ..schema import finite

Ring = Sequence[tuple[float, float]]

# The sphere of web maps in metres.
SPHERE = 6_378_137.0


def web_mercator(lon: Column, lat: Column) -> Column:
    """``struct<x, y>`` in metres of a place in degrees."""
    return F.struct((F.radians(lon) * SPHERE).alias("x"), (F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * SPHERE).alias("y"))


def within(df: DataFrame, region: Sequence[Ring], x: str = "x", y: str = "y") -> DataFrame:
    """The rows whose place lies inside the rings of a region; its bounding box is compared first and reaches the scan."""
    xs, ys = [a for r in region for a, _ in r], [b for r in region for _, b in r]
    if not xs:
        return df.filter("false")
    edges = geo.ring_edges(F.array(*[F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in r]) for r in region]))
    near = F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys))
    return df.filter(near & finite(x) & finite(y)).filter(geo.contains(edges, x, y))


def pois_within(pois: DataFrame, region: Sequence[Ring], categories: Categories, *, geometry: str | None = None, drop_unmatched: bool = True) -> DataFrame:
    """Points of interest inside a region with their categories. With ``geometry``, a polygon as text, a row without ``x`` and
    ``y`` lies at its centroid; rows with neither are left out. Repeated rows count once."""
    df = pois
    if geometry is not None:
        c = geo.centroid(geo.rings_of_wkt(geometry))
        df = df.withColumn("__c", c).withColumns({k: F.coalesce(F.when(finite(k), F.col(k)), F.col(f"__c.{k}")) for k in ("x", "y")}).drop("__c")
    return categorize(within(df, region).distinct(), categories, drop_unmatched=drop_unmatched)


def network_within(nodes: DataFrame, edges: DataFrame, region: Sequence[Ring], *, node: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """Nodes inside a region and the edges between two of them."""
    inside = within(nodes, region)
    ids = inside.select(node).distinct()
    both = edges.join(ids.withColumnRenamed(node, "u"), "u", "left_semi").join(ids.withColumnRenamed(node, "v"), "v", "left_semi")
    return inside, both.select(edges.columns)
