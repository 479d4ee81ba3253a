"""Running totals within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of one doubling of the order value; a group's rows are totalled part by part.
PARTS_PER_DOUBLING = 64


def running_total(df: DataFrame, keys: Sequence[str], order: Column, tie: Sequence[str], weight: Column, name: str = "cum") -> DataFrame:
    """``df`` with ``name``, the sum of ``weight`` over the rows of the same keys up to this one by (``order``, ``tie``).

    A group is cut into parts by the size of ``order`` (a non-negative number), totals run within parts, and each part
    starts from the sum of the parts before it, so a group that holds a large share of all rows is spread over many
    tasks. Rows are only sorted within their part.
    """
    part = F.floor(F.log2(order + 1) * PARTS_PER_DOUBLING).cast("int")
    rows = df.withColumn("__order", order).withColumn("__w", weight).withColumn("__part", part)
    inner = Window.partitionBy(*keys, "__part").orderBy("__order", *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("__cum", F.sum("__w").over(inner))
    parts = rows.groupBy(*keys, "__part").agg(F.sum("__w").alias("__w"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "__part", F.coalesce(F.sum("__w").over(before), F.lit(0.0)).alias("__offset"))
    out = local.join(offsets, [*keys, "__part"])
    return out.select(*df.columns, (F.col("__offset") + F.col("__cum")).alias(name))
