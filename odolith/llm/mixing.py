"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled, shipped, small
from .tokens import TOKENIZER, token_counts

#: Blocks the whole mix is apportioned in: shares are met to about one part in this many.
BLOCKS = 100_000
#: Documents of a source that one shard holds, and shards of a source at most.
DOCS_PER_SHARD, SHARDS = 20_000, 4_096


def apportion(weights: Sequence[float], caps: Sequence[int], seats: int) -> list[int]:
    """Seats by the highest quotients weight / (2k + 1), no more than ``caps``; a party at its cap leaves its seats to the
    next quotients. Equal quotients go to the earlier party. Fewer seats are given only if all caps are reached.

    Found by bisection for the lowest quotient that still gets a seat, so the cost does not grow with the seats.
    """
    caps = [c if w > 0 else 0 for w, c in zip(weights, caps, strict=True)]
    if sum(caps) <= seats:
        return caps
    give = lambda q: [min(c, math.floor(w / (2 * q) + 0.5)) if w > 0 else 0 for w, c in zip(weights, caps, strict=True)]
    low = high = max(weights)  # at ``low`` enough seats are given, above ``high`` too few
    while sum(give(low)) < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        low, high = (mid, high) if sum(give(mid)) >= seats else (low, mid)
    got = give(low)
    last = [(weights[i] / (2 * n - 1), -i) for i, n in enumerate(got) if n]
    heapq.heapify(last)
    for _ in range(sum(got) - seats):  # ties at the last quotient
        _, i = heapq.heappop(last)
        got[-i] -= 1
        if got[-i]:
            heapq.heappush(last, (weights[-i] / (2 * got[-i] - 1), i))
    return got


def source_name(c: Column | str) -> Column:
    """A source's name without differences of case, blanks and punctuation."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " ", "_")


def mix(sizes: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 11, blocks: int = BLOCKS) -> DataFrame:
    """``(source, doc_id, n_tokens, repeats)``: how often each document is used so that sources have their target shares.

    ``sizes`` (``doc_id`` unique, ``source``, ``n_tokens``) should be a written table; ``targets`` (``source``,
    ``target_share``, ``max_repeats``) has a row a source: of repeated names the largest share counts, rows without a
    positive share or repeat count as 0. ``total`` tokens (default: as many as the targeted sources hold)
    become ``blocks`` equal blocks, apportioned to sources by highest quotients and within a source to its shards. A
    source can give at most ``max_repeats`` times its tokens; what it cannot give goes to the others by their quotients.
    Within a shard documents come in a seeded order; a quota of r times the shard's tokens and some blocks more uses every
    document r times and those at the front once more, up to half a document from the quota, never above ``max_repeats``.

    Documents without tokens, of no source or of one without target, are not used and do not come out. The driver gets one
    row per target; shards get their quotas in a task per source. Same input and seed give the same selection in any row order.
    """
    spark = shipped(sizes.sparkSession)
    rows = _targets(targets).collect()
    share = {r.source: r.share for r in rows}
    most = {r.source: r.most for r in rows}
    names = small(settled(spark.createDataFrame([(s,) for s in sorted(share)], "source string")))
    docs = sizes.select("doc_id", source_name("source").alias("source"), F.col("n_tokens").cast("long").alias("n_tokens")).filter("n_tokens > 0").join(names, "source")
    have = {r.source: (r.docs, r.tokens) for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")).collect()}  # one row a target
    order = sorted(have)
    want = total if total is not None else sum(t for _, t in have.values())
    unit = max(1, -(-want // blocks))
    seats = apportion([share[s] for s in order], [-(-most[s] * have[s][1] // unit) for s in order], want // unit)
    plan = [(s, min(SHARDS, -(-have[s][0] // DOCS_PER_SHARD)), n, most[s]) for s, n in zip(order, seats, strict=True)]
    plan = small(settled(spark.createDataFrame(plan, "source string, shards int, seats bigint, most int")))
    docs = docs.join(plan.select("source", "shards"), "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards")).cast("int")).drop("shards")

    def quotas(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        tokens, most = part.tokens.tolist(), int(part.most.iloc[0])
        out = []
        for shard, held, n in zip(part.shard, tokens, apportion(tokens, [-(-most * t // unit) for t in tokens], int(part.seats.iloc[0])), strict=True):
            whole, rest = divmod(n * unit, held)
            out.append((part.source.iloc[0], shard, *((whole, rest) if whole < most else (most, 0))))
        return pd.DataFrame(out, columns=["source", "shard", "whole", "rest"])

    held = docs.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens")).join(plan.select("source", "seats", "most"), "source")
    table = settled(held.groupBy("source").applyInPandas(quotas, "source string, shard int, whole int, rest bigint"))  # at most SHARDS rows a source
    before = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = docs.withColumn("run", F.sum("n_tokens").over(before)).join(small(table), ["source", "shard"])
    more = (F.col("run") - F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    return run.withColumn("repeats", F.col("whole") + more.cast("int")).filter("repeats > 0").select("source", "doc_id", "n_tokens", "repeats")


def _targets(targets: DataFrame) -> DataFrame:
    """``(source, share, most)``, a row per source name: of repeated names the largest share and repeat count, 0 for undefined ones."""
    rows = targets.select(source_name("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most")).filter("source is not null and source <> ''")
    zero = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    return rows.groupBy("source").agg(zero(F.max(F.when(~F.isnan("share"), F.col("share")))).alias("share"), zero(F.max("most")).alias("most"))


def mix_report(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source, of either side: ``target_share``, ``max_repeats``, tokens available and used, and the share reached.

    ``exact_total`` is, on every row, the largest total at which every source that has documents and a target can hold its
    target's share among these: the least of repeats times tokens over that share. A mix of a larger total has sources at
    their cap.
    """
    t = _targets(targets).select("source", F.col("share").alias("target_share"), F.col("most").alias("max_repeats"))
    a = sizes.groupBy(F.coalesce(source_name("source"), F.lit("")).alias("source")).agg(F.sum("n_tokens").alias("available_tokens"))
    u = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.count(F.lit(1)).alias("used_documents"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = t.join(a, "source", "full").join(u, "source", "full").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), zero("max_repeats"), zero("available_tokens"), zero("used_tokens"), zero("used_documents"))
    # one row per source name: the sums are attached by a join, as a window over everything would be one task
    held = (F.col("target_share") > 0) & (F.col("available_tokens") > 0)
    room = F.col("max_repeats") * F.col("available_tokens") / F.col("target_share")
    whole = joined.agg(F.sum("used_tokens").alias("all"), (F.min(F.when(held, room)) * F.sum(F.when(held, F.col("target_share")))).alias("exact"))
    out = joined.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.when(F.col("all") > 0, F.col("used_tokens") / F.col("all")).otherwise(0.0))
    return out.withColumn("exact_total", F.floor(F.coalesce("exact", F.lit(0.0))).cast("long")).drop("all", "exact")


def document_sizes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens)`` as a written table."""
    return settled(token_counts(docs, "doc_id", "text", ["source"], tokenizer=tokenizer))


def mix_documents(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, **options: int) -> DataFrame:
    """The selection with, on every row, its source's target share and the share reached."""
    sizes = document_sizes(docs, tokenizer)
    chosen = settled(mix(sizes, targets, **options))
    shares = mix_report(chosen, sizes.filter("false"), targets).filter("used_tokens > 0").select("source", "target_share", "actual_share")
    return chosen.join(small(settled(shares)), "source")
