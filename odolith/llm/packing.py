"""Filling containers of fixed capacity with items of varying length: large-item matching on the size histogram.

Items of one size are interchangeable, and there are at most ``capacity`` sizes, so the whole packing is planned on the
histogram of sizes, one task a kind of container: however many items there are, the plan has a number of steps that
depends on the capacity alone. Items then find their container by their rank among the items of their size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled, shipped, small
from .tokens import TOKENIZER, token_counts

#: Items of one size that one task ranks; a size with more is ranked in parts.
RANKED_PER_TASK = 50_000


class Placement(NamedTuple):
    """Items of ``size`` with ranks from ``first`` up to ``last`` (excluded) go to containers from ``container`` on, ``each`` to one."""

    size: int
    first: int
    last: int
    container: int
    each: int


def plan(histogram: Mapping[int, int], capacity: int) -> tuple[list[Placement], int]:
    """Placements for all items of a histogram ``{size: count}`` with sizes from 1 to ``capacity``, and the containers used.

    Items above a third of the capacity come first, largest to smallest: each is matched with the largest other such item
    that fits beside it, at most two to a container. Smaller items follow, largest first, each into the container with
    the smallest gap that takes it, or a new one. Containers with the same content are handled as one group.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("sizes must be from 1 to the capacity")
    steps: list[Placement] = []
    taken: dict[int, int] = defaultdict(int)
    used = 0
    gaps: list[int] = []  # gaps that have groups, ascending
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first container, containers)

    def place(size: int, container: int, containers: int, each: int) -> None:
        steps.append(Placement(size, taken[size], taken[size] + containers * each, container, each))
        taken[size] += containers * each

    def keep(gap: int, container: int, containers: int) -> None:
        if gap > 0 and containers > 0:
            if not groups[gap]:
                insort(gaps, gap)
            groups[gap].append((container, containers))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        n = left[size]
        at = bisect_left(large, capacity - size + 1) - 1
        mate = large[at] if at >= 0 else None
        if mate == size and n == 1:  # its mate is the next smaller size
            at -= 1
            mate = large[at] if at >= 0 else None
        if mate is None:
            place(size, used, n, 1)
            keep(capacity - size, used, n)
            used += n
            left[size] = 0
        else:
            pairs = n // 2 if mate == size else min(n, left[mate])
            place(size, used, pairs, 2 if mate == size else 1)
            left[size] -= pairs
            if mate != size:
                place(mate, used, pairs, 1)
            left[mate] -= pairs
            keep(capacity - size - mate, used, pairs)
            used += pairs
        if not left[size]:
            large.pop()
        if mate is not None and mate != size and not left[mate]:
            del large[at]
    for size in sorted((s for s in left if left[s]), reverse=True):
        n = left[size]
        while n:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                container, containers, gap = used, -(-n // (capacity // size)), capacity
                used += containers
            else:
                gap = gaps[at]
                container, containers = groups[gap].pop()
                if not groups[gap]:
                    gaps.pop(at)
            each = gap // size
            full = min(containers, n // each)
            if full:
                place(size, container, full, each)
                keep(gap - each * size, container, full)
                n -= full * each
            if full < containers:
                rest = containers - full
                if n and n < each:
                    place(size, container + full, 1, n)
                    keep(gap - n * size, container + full, 1)
                    n, full, rest = 0, full + 1, rest - 1
                keep(gap, container + full, rest)
    return steps, used


def pieces(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """Every item for every kind: ``(container_kind, capacity_tokens, doc_id, part, start, size)``.

    An item no longer than the capacity is one piece; a longer one is cut into full pieces and a rest.
    """
    c = F.col("capacity_tokens").cast("long")
    every = sizes.join(small(containers), F.lit(True))  # every item for every kind is what is asked
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / c).cast("long")))
    cut = every.filter(F.col("n_tokens") > 0).withColumn("part", part)
    return cut.select("container_kind", c.alias("capacity_tokens"), "doc_id", F.col("part").cast("int").alias("part"), (F.col("part") * c).alias("start"), F.least(c, F.col("n_tokens") - F.col("part") * c).alias("size"))


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """``(container_kind, capacity_tokens, container_id, doc_id, part, token_start, n_tokens)``: all items of ``sizes``
    (``doc_id`` unique, ``n_tokens``) assigned to containers of every kind in ``containers`` (``container_kind``,
    ``capacity_tokens``; repeated rows count once, ones without a positive capacity are left out).

    A piece is only cut from an item longer than the capacity. An item of no tokens, or of unknown length, takes no room:
    it comes out once per kind with a null ``container_id``. Container ids count from 0 within a kind. Equal items are told
    apart by ``doc_id``; the assignment is the same for the same input, in any row order. Other columns are ignored. Nothing
    reaches the driver; a task plans one kind on its histogram, at most ``capacity`` rows.
    """
    kinds = containers.select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).filter("container_kind is not null and capacity_tokens > 0").distinct()
    kinds = settled(kinds)
    shipped(sizes.sparkSession)
    sizes = sizes.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))
    items = pieces(sizes, kinds)
    key = ["container_kind", "capacity_tokens"]
    histogram = settled(items.groupBy(*key, "size").agg(F.count(F.lit(1)).alias("n")))

    def planned(part: pd.DataFrame) -> pd.DataFrame:
        kind, capacity = part.container_kind.iloc[0], int(part.capacity_tokens.iloc[0])
        steps, _ = plan(dict(zip(part["size"].tolist(), part["n"].tolist(), strict=True)), capacity)
        out = pd.DataFrame(steps, columns=Placement._fields)
        out.insert(0, "capacity_tokens", capacity)
        out.insert(0, "container_kind", kind)
        return out

    steps = settled(histogram.groupBy(*key).applyInPandas(planned, "container_kind string, capacity_tokens bigint, size bigint, first bigint, last bigint, container bigint, each bigint"))
    ranked = _ranked(items, [*key, "size"], histogram)
    there = ranked.join(small(steps), [*key, "size"]).filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    placed = there.select(*key, (F.col("container") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).alias("container_id"), "doc_id", "part", F.col("start").alias("token_start"), F.col("size").alias("n_tokens"))
    none = sizes.filter(F.coalesce(F.col("n_tokens"), F.lit(0)) <= 0).join(small(kinds), F.lit(True))
    nothing = none.select(*key, F.lit(None).cast("long").alias("container_id"), "doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("n_tokens"))
    return placed.unionByName(nothing)


def _ranked(items: DataFrame, keys: list[str], histogram: DataFrame) -> DataFrame:
    """``rank`` from 0 within ``keys`` by (doc_id, part) inside parts; a size with many items is ranked in parts, whose
    offsets are running sums of their counts. The histogram is a written table."""
    hot = small(histogram.filter(F.col("n") > RANKED_PER_TASK).select(*keys, F.ceil(F.col("n") / RANKED_PER_TASK).alias("splits")))
    items = items.join(hot, keys, "left").withColumn("split", F.when(F.col("splits").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "part"), F.col("splits"))))
    local = items.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "split").orderBy("doc_id", "part")).cast("long") - 1)
    counts = items.filter(F.col("splits").isNotNull()).groupBy(*keys, "split").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    if histogram.filter(F.col("n") > RANKED_PER_TASK).isEmpty():
        return local.drop("split", "splits")
    return local.join(small(settled(offsets)), [*keys, "split"], "left").withColumn("rank", F.col("rank") + F.coalesce("offset", F.lit(0))).drop("split", "splits", "offset")


def pack_documents(docs: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``pack`` for texts, measured in tokens. Texts are encoded once; the sizes are a written table."""
    return pack(settled(token_counts(docs, "doc_id", "text", tokenizer=tokenizer)), containers)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers, pieces, tokens, the least containers any packing needs, and the share of room used."""
    one = packed.filter(F.col("container_id").isNotNull()).groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    r = one.groupBy("container_kind", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return r.withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
