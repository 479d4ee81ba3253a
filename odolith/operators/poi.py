"""Counting points of interest by categories of tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Categories = Mapping[str, Sequence[tuple[str, float]]]


def _pair(pair: str) -> tuple[str, str]:
    key, colon, value = pair.partition(":")
    if not colon:
        raise ValueError(f"{pair!r} is not key:value")
    return key, value


def tag_query(spark, categories: Categories) -> DataFrame:
    """``(key, values)``: per tag key the distinct values any category asks for, sorted."""
    rows = [_pair(p) for pairs in categories.values() for p, _ in pairs]
    return spark.createDataFrame(rows, "key string, value string").groupBy("key").agg(F.sort_array(F.collect_set("value")).alias("values"))


def categorize(pois: DataFrame, categories: Categories, *, suffix: str = "_weight", drop_unmatched: bool = True) -> DataFrame:
    """Points with, per category, how many of its ``key:value`` pairs they match and the sum of their weights (``<category><suffix>``).

    A tag column that is absent or null matches nothing. A category named like a column is a ValueError.
    """
    new = [n for c in categories for n in (c, c + suffix)]
    taken = {c.lower() for c in pois.columns}
    clash = [n for n in new if n.lower() in taken]
    if clash or len(set(new)) < len(new):
        raise ValueError(f"column names taken: {clash or new}")
    out = {}
    for c, pairs in categories.items():
        match = [(F.coalesce(F.col(k) == v, F.lit(False)), w) for (k, v), w in ((_pair(p), w) for p, w in pairs) if k in pois.columns]
        out[c] = sum((m.cast("int") for m, _ in match), F.lit(0))
        out[c + suffix] = sum((F.when(m, F.lit(float(w))).otherwise(0.0) for m, w in match), F.lit(0.0))
    done = pois.withColumns(out)
    return done.filter(sum((F.col(c) for c in categories), F.lit(0)) > 0) if drop_unmatched and categories else done
