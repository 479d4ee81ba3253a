"""Linear utilities of pairs: cost, features along the route, features of origin and destination."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CELLS, INF, NAN, ZONES, finite, known
from .od import node_sums
from .routing import NodeAggregation, PathAggregation, tiered_aggregate, tiered_costs


@dataclass(frozen=True)
class RouteFeature:
    """A coefficient on an aggregation along the route, over edges or nodes."""

    coefficient: float
    aggregation: PathAggregation | NodeAggregation


@dataclass(frozen=True)
class Utility:
    """``U = constant + cost_coefficient * cost + route features + origin features + destination features``."""

    constant: float = 0.0
    cost_coefficient: float = 0.0
    route: tuple[RouteFeature, ...] = ()
    origin: dict[str, float] = field(default_factory=dict)
    dest: dict[str, float] = field(default_factory=dict)


def route_utility(pairs: DataFrame, graph: DataFrame, utility: Utility, *, nodes: DataFrame | None = None, node: str = "node_id", mask: str | None = None, cutoff: float = INF) -> DataFrame:
    """``pairs`` with ``utility`` of the route: NaN where unreachable or masked; an undefined feature of a reachable pair adds
    nothing. Without route features only costs are searched."""
    edge = [r.aggregation for r in utility.route if isinstance(r.aggregation, PathAggregation)]
    at_node = [r.aggregation for r in utility.route if isinstance(r.aggregation, NodeAggregation)]
    if utility.route:
        found = tiered_aggregate(pairs, graph, nodes=nodes, node=node, edge_aggregations=edge, node_aggregations=at_node, mask=mask, cutoff=cutoff)
    else:
        found = tiered_costs(pairs, graph, mask=mask, cutoff=cutoff)
    u = F.lit(utility.cost_coefficient) * F.col("cost")
    for r in utility.route:
        u = u + F.lit(r.coefficient) * F.coalesce(known(r.aggregation.name), F.lit(0.0))
    return found.select(*pairs.columns, F.when(finite("cost"), u).otherwise(NAN).alias("utility"))


def add_endpoints(od: DataFrame, utility: Utility, cells: DataFrame, zones: DataFrame | None = None, *, node: str = "node_id") -> DataFrame:
    """``utility`` plus the constant and the features of both ends: means over the origin's units, sums over the destination's.

    Features that a tier's units lack add nothing there; NaN stays NaN.
    """
    def side(df: DataFrame, kind: str, names: dict[str, float], key: str, mean: bool) -> DataFrame:
        have = [n for n in names if n in df.columns]
        if mean:
            table = df.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("dest")).agg(F.max(F.lit(1)).alias("one"), *[F.avg(known(F.col(n).cast("double"))).alias(n) for n in have])
        else:
            table = node_sums(df, have, node) if have else df.select(F.col(node).alias("dest")).distinct()
        value = sum((F.lit(names[n]) * F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in have), F.lit(0.0))
        return table.select(F.lit(kind).alias("__kind"), F.col("dest").alias(key), value.alias(f"__{key}"))

    out = od
    for key, names, zone_tier in (("origin", utility.origin, F.col("tier") == ZONES), ("dest", utility.dest, F.col("tier") != CELLS)):
        if not names:
            out = out.withColumn(f"__{key}", F.lit(0.0))
            continue
        table = side(cells, "cell", names, key, key == "origin")
        if zones is not None:
            table = table.unionByName(side(zones, "zone", names, key, key == "origin"))
        out = out.withColumn("__kind", F.when(zone_tier, "zone").otherwise("cell")).join(table, ["__kind", key], "left").drop("__kind")
    add = F.lit(utility.constant) + F.coalesce("__origin", F.lit(0.0)) + F.coalesce("__dest", F.lit(0.0))
    return out.withColumn("utility", F.col("utility") + add).select(od.columns)
