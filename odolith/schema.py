"""Tier names, sentinels and column helpers shared by all operators.

Conventions: one long table per thing, ``null`` for a failed match, ``+inf`` for an unreachable cost and ``NaN`` for an
undefined aggregate. Every helper is a plain Column expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS, MIDDLE, ZONES = TIERS = ("cells_to_cells", "cells_to_zones", "zones_to_zones")
INF = float("inf")
NAN = float("nan")


class DataError(ValueError):
    """Input rows break an operator's contract (a missing reference, a value out of its domain)."""


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def known(c: Column | str) -> Column:
    """The number itself, or null where it is NaN."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def require(df: DataFrame, *names: str) -> None:
    """Raise ValueError unless every column is there."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; there are {df.columns}")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def total(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, cols)


def fresh(base: str, *taken: list[str]) -> str:
    """A column name that none of the given lists has (compared without case, as Spark resolves names)."""
    used = {c.lower() for names in taken for c in names}
    while base.lower() in used:
        base = "_" + base
    return base
