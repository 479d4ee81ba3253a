"""Joins against a table with unique keys that stay balanced when one key holds much of the other side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import fresh

#: Rows of one key that one task takes before the key is split.
ROWS_PER_SPLIT = 500_000
#: Hot keys are kept by slots of their hash, so that the table of splits is broadcast at a bounded size however many keys
#: are hot. A key that shares the slot of a hot one is split as well, on both sides, which changes no result.
SLOTS = 1 << 17

_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def slot(df: DataFrame, keys: Sequence[str]) -> Column:
    """The slot of a row's keys; equal keys have the same, whichever whole-number type they are stored in."""
    types = dict(df.dtypes)
    return F.pmod(F.xxhash64(*[F.col(k).cast("bigint") if types[k] in _WHOLE else F.col(k) for k in keys]), F.lit(SLOTS)).cast("int")


def hot_slots(counts: DataFrame, keys: Sequence[str], n: str, rows: int | None = None) -> DataFrame:
    """``(slot, splits)`` of the slots with a key of more than ``rows`` rows: at most SLOTS rows, for every hot key there is."""
    rows = ROWS_PER_SPLIT if rows is None else rows
    hot = counts.filter(F.col(n) > rows).select(slot(counts, keys).alias("slot"), F.ceil(F.col(n) / rows).cast("int").alias("splits"))
    return hot.groupBy("slot").agg(F.max("splits").alias("splits"))


def salted(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str], hot: DataFrame, salt: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``salt``: rows of hot slots of the left one spread by a hash of ``by``, of the right one repeated."""
    at, splits = fresh("slot", left.columns, right.columns, [salt]), fresh("splits", left.columns, right.columns, [salt])
    hot = F.broadcast(hot.select(F.col("slot").alias(at), F.col("splits").alias(splits)))
    a = left.withColumn(at, slot(left, keys)).join(hot, at, "left").withColumn(salt, F.when(F.col(splits).isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col(splits)).cast("int"))).drop(at, splits)
    b = right.withColumn(at, slot(right, keys)).join(hot, at, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(splits), F.lit(1)) - 1))).drop(at, splits)
    return a, b


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str], *, counts: DataFrame | None = None, n: str = "n", how: str = "left", rows: int | None = None) -> DataFrame:
    """``left`` joined to ``right``, whose ``keys`` are unique, without loading a hot key onto one task.

    Rows of a hot key are spread over ``splits`` by a hash of the columns ``spread``; the one right row of that key is
    repeated as often. ``counts`` (keys and ``n``) saves counting ``left`` again. Null keys never match.
    """
    keys = list(keys)
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    salt = fresh("salt", left.columns, right.columns)
    a, b = salted(left, right, keys, spread, hot_slots(counts, keys, n, rows), salt)
    return a.join(b, [*keys, salt], how).drop(salt)
