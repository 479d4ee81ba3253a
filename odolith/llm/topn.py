"""The N best rows of every group by a mergeable bounded heap."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from ..schema import INF, finite, fresh

FLIPPABLE = {"tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz", "boolean"}


@dataclass(frozen=True)
class By:
    """One ordering field; ``None`` order values sort after all others."""

    column: Column
    descending: bool = False


def _ascending(df: DataFrame, by: By) -> Column:
    """A key that sorts ascending as ``by`` wants: nulls last, and NaN after every number in either direction."""
    kind = df.select(by.column.alias("k")).dtypes[0][1]
    c = by.column
    null = c.isNull()
    if kind in ("float", "double"):
        null = null | F.isnan(c)
        c = F.when(null, F.lit(0.0)).otherwise(-c.cast("double") if by.descending else c.cast("double"))
    elif by.descending:
        if kind.startswith("decimal"):
            c = -c
        elif kind in FLIPPABLE:
            whole = F.unix_micros(c.cast("timestamp")) if kind in ("date", "timestamp", "timestamp_ntz") else c.cast("long")
            c = F.bitwise_not(whole)  # falls as its argument rises, without overflow at either end
        else:
            raise ValueError(f"{kind} can only be ordered ascending")
    return F.struct(null.alias("last"), c.alias("key"))


def top_n(df: DataFrame, group: Sequence[str], by: Sequence[By], n: int, keep: Sequence[str] = ()) -> DataFrame:
    """The ``n`` first rows of each group in the order ``by``, all if it has fewer: ``group``, ``rank`` (1 is best), ``keep``.

    Each task keeps one heap of at most ``n`` entries per group it meets, heaps are merged after the shuffle, so a group
    of any size sends at most ``n`` rows per task and never gathers anywhere. ``by`` should end in a unique id; rows equal
    in all of it are ordered by their ``keep`` columns, so equal rows only ever stand for each other. Equal rows each
    take a place (deduplicate first if they should not). Null group values form a group of their own. Other columns of
    ``df`` are ignored whatever their names; an empty table gives an empty result.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    keys = [_ascending(df, b).alias(f"k{i}") for i, b in enumerate(by)]
    entry = F.struct(*keys, F.struct(*[F.col(c) for c in keep]).alias("row")) if keep else F.struct(*keys)
    heap = InternalFunction.collect_top_k(entry, n, True)
    name = fresh("best", list(group), list(keep))
    best = df.groupBy(*group).agg(heap.alias(name))
    at, one = fresh("at", list(group), list(keep), [name]), fresh("one", list(group), list(keep), [name])
    out = best.select(*group, F.posexplode(name).alias(at, one))
    return out.select(*group, (F.col(at) + 1).alias("rank"), *[F.col(f"{one}.row.{c}").alias(c) for c in keep])


def latest(df: DataFrame, key: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Per key the row delivered last: ``key`` and ``values``. Equal times are settled by the larger values, so the
    result does not depend on row order; a row without a time loses to any with one."""
    newest = F.max(F.struct(F.col(at).alias("at"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]))
    return df.groupBy(*key).agg(newest.alias("newest")).select(*key, *[F.col(f"newest.v{i}").alias(v) for i, v in enumerate(values)])


def top_destinations(od: DataFrame, n: int = 5, score: str = "pop", cost: str = "cost") -> DataFrame:
    """Of each (run_id, tier, origin) the ``n`` destinations with the highest score: adds ``rank``, ``dest`` and the values.

    Of a pair delivered more than once the latest ``loaded_at`` counts. Pairs whose score is then null or NaN are not
    ranked. Equal scores go by lower cost, where null, NaN and infinite costs are equal and come last, then lower dest.
    """
    group = ["run_id", "tier", "origin"]
    now = latest(od, [*group, "dest"], "loaded_at", [score, cost])
    ranked = now.filter(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("cost_key", F.when(finite(cost), F.col(cost)).otherwise(F.lit(INF)))
    return top_n(ranked, group, [By(F.col(score), descending=True), By(F.col("cost_key")), By(F.col("dest"))], n, keep=["dest", score, cost])
