"""Shaping unit tables: wide sums, rescaling to group totals, ids over several layers, areas inside a region."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..schema import finite, union_all


def wide_sums(df: DataFrame, index: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    """One row per ``index`` with a column per listed value of ``column``: the sum of ``value``, 0 where there is none.

    The values are given, so the width is known without a pass over the data; rows with other values are left out, but their
    index comes out. Undefined numbers count as 0; null index values form a group of their own.
    """
    number = F.when(finite(value), F.col(value).cast("double")).otherwise(0.0)
    return df.groupBy(*index).agg(*[F.coalesce(F.sum(F.when(F.col(column) == v, number)), F.lit(0.0)).alias(v) for v in values])


def rescaled(units: DataFrame, totals: DataFrame, group: str, columns: Sequence[str], *, share: str | None = None) -> DataFrame:
    """``units`` with every column scaled so that it sums to the group's total in ``totals`` (one row a group), times the group's
    ``share`` if given.

    A group without a total gets zeros, and one whose units sum to 0 keeps zeros: its total has nothing to be spread over.
    Undefined unit values count as 0. Sums are combined before their shuffle; units are joined to one row a group.
    """
    num = lambda c: F.when(finite(c), F.col(c).cast("double")).otherwise(0.0)
    sums = units.groupBy(group).agg(*[F.sum(num(c)).alias(f"__s{i}") for i, c in enumerate(columns)])
    part = F.lit(1.0) if share is None else num(share)
    wanted = totals.groupBy(group).agg(*[F.max(num(c) * part).alias(f"__t{i}") for i, c in enumerate(columns)])
    factor = lambda i: F.coalesce(F.try_divide(F.col(f"__t{i}"), F.col(f"__s{i}")), F.lit(0.0))
    scale = sums.join(wanted, group, "left").select(group, *[factor(i).alias(f"__f{i}") for i in range(len(columns))])
    out = units.join(scale, group, "left")
    return out.withColumns({c: num(c) * F.coalesce(F.col(f"__f{i}"), F.lit(0.0)) for i, c in enumerate(columns)}).select(units.columns)


def predicted(units: DataFrame, tag: str, area: str, coefficients: Mapping[str, Sequence[float]], columns: Sequence[str], fallback: Sequence[float]) -> DataFrame:
    """``units`` with a prior per column: the tag's coefficient, or the fallback's, times the area."""
    out = {}
    for i, c in enumerate(columns):
        pairs = [F.lit(x) for k, v in coefficients.items() for x in (k, float(v[i]))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(tag)), F.lit(float(fallback[i]))) if pairs else F.lit(float(fallback[i]))
        out[c] = weight * F.when(finite(area), F.col(area).cast("double")).otherwise(0.0)
    return units.withColumns(out)


def all_ids(*layers: DataFrame, name: str = "cell_id") -> DataFrame:
    """The distinct ids, not null, that any layer has in its first column."""
    return union_all(*[df.select(F.col(df.columns[0]).alias(name)) for df in layers]).filter(F.col(name).isNotNull()).distinct()


def inside_ratio(units: DataFrame, rings: str, region: Sequence[tuple[float, float]]) -> DataFrame:
    """The units that touch a convex region with ``area_inside`` and ``inside_ratio``, its share of the unit's area within 0 and 1.

    Bounding boxes go first, so only units near the region are cut. Units without area have a ratio of 0 and do not come out.
    """
    xs, ys = [x for x, _ in region], [y for _, y in region]
    box = geo.bounds(rings)
    near = units.withColumn("__b", box).filter((F.col("__b.x0") <= max(xs)) & (F.col("__b.x1") >= min(xs)) & (F.col("__b.y0") <= max(ys)) & (F.col("__b.y1") >= min(ys))).drop("__b")
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in region])
    cut = near.withColumn("area_inside", geo.area_within(rings, ring)).withColumn("__a", geo.area(rings))
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide("area_inside", "__a")))
    return cut.withColumn("inside_ratio", F.coalesce(ratio, F.lit(0.0))).drop("__a").filter("area_inside > 0")
