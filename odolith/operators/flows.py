"""Traffic flows: weighted samples of trips, their paths' edge flows, and the comparison with counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import INF, NAN, ZONES, finite
from ..session import settled
from .routing import betweenness
from .running import running_total


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the parts alone."""
    return (F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def weighted_draws(rows: DataFrame, keys: Sequence[str], item: str, score: str, draws: DataFrame, *, order: Column | None = None) -> DataFrame:
    """``(keys, draw, item)``: for each draw ``(keys, draw, r)`` the first item whose running score reaches ``r`` times the total.

    Items run in the order of a hash of their id within a key, or of ``order``, a number of at least 0, then of their id; undefined or non-positive scores cannot be drawn, a key without any
    gets no item. Inverse of the distribution by a range join on running totals, cut into blocks of the total so that
    draws meet only the items of their block.
    """
    keys = list(keys)
    ok = rows.filter(finite(score) & (F.col(score) > 0)).select(*keys, item, F.col(score).cast("double").alias("w"))
    # any fixed order will do: that of a hash spreads large groups evenly over the parts of the running total
    place = F.pmod(F.xxhash64(item), F.lit(1 << 30)).cast("double") if order is None else order
    run = settled(running_total(ok, keys, place, [item], F.col("w")))
    whole = run.groupBy(*keys).agg(F.max("cum").alias("total"))
    blocks = 256.0
    spans = run.join(whole, keys).withColumn("from", F.col("cum") - F.col("w"))
    lo, hi = F.floor(F.col("from") / F.col("total") * blocks), F.floor(F.least(F.col("cum") / F.col("total") * blocks, F.lit(blocks - 1)))
    spans = spans.withColumn("block", F.explode(F.sequence(F.least(lo, hi), hi)))
    ask = draws.join(whole, keys).withColumn("at", F.col("r") * F.col("total"))
    ask = ask.withColumn("block", F.least(F.floor(F.col("r") * blocks), F.lit(int(blocks) - 1)))
    met = ask.drop("total").join(spans.select(*keys, "block", item, "from", "cum"), [*keys, "block"])
    return met.filter((F.col("from") < F.col("at")) & (F.col("at") <= F.col("cum"))).groupBy(*keys, "draw").agg(F.min(item).alias(item))


def nested_sample(od: DataFrame, weight: str, cell_to_zone: DataFrame, origin_weights: DataFrame, cost_to_weight: Callable[[Column], Column], n_orig: int, n_dest: int, *, seed: int = 0, mask: Column | None = None) -> DataFrame:
    """``(origin, draw, dest)``: origins drawn ``n_orig`` times by ``origin_weights`` (``origin, w``), repeats dropped, each with ``n_dest``
    destinations drawn from its pooled tiers by ``weight * cost_to_weight(cost)``.

    Far destinations are scored once per zone and joined to the drawn origins only. Draws come from a hash of seed, origin
    and draw number, so a sample is reproducible whatever the partitioning. Masked pairs cannot be drawn.
    """
    spark = od.sparkSession
    picks = spark.range(n_orig).select(F.lit(1).alias("g"), F.col("id").alias("draw"), uniform(seed, F.col("id")).alias("r"))
    chosen = weighted_draws(origin_weights.filter("origin is not null").select(F.lit(1).alias("g"), "origin", "w"), ["g"], "origin", "w", picks)
    chosen = settled(chosen.select("origin").distinct())
    use = od if mask is None else od.filter(mask)
    scored = use.filter(finite("cost")).select("tier", "origin", "dest", (F.col(weight).cast("double") * cost_to_weight(F.col("cost"))).alias("score"))
    near = scored.filter(F.col("tier") != ZONES).join(chosen, "origin", "left_semi")
    far = scored.filter(F.col("tier") == ZONES).withColumnRenamed("origin", "zone_origin").join(chosen.join(cell_to_zone, "origin"), "zone_origin")
    pool = near.select("origin", "dest", "score").unionByName(far.select("origin", "dest", "score")).groupBy("origin", "dest").agg(F.sum("score").alias("score"))
    asks = chosen.select("origin", F.explode(F.sequence(F.lit(0), F.lit(n_dest - 1))).alias("draw")).withColumn("r", uniform(seed + 1, F.col("origin").cast("string"), F.col("draw")))
    return weighted_draws(pool, ["origin"], "dest", "score", asks)


def edge_flows(sample: DataFrame, graph: DataFrame, km: float | None = None, *, length: str = "length", cutoff: float = INF) -> DataFrame:
    """``(u, v, flow)`` of a sample, scaled so that flow times length (metres) sums to ``km`` kilometres; empty if no edge is used."""
    flow = betweenness(sample, graph, cutoff=cutoff)
    if km is None:
        return flow
    flow = settled(flow)
    run = flow.join(graph.select("u", "v", F.col(length).cast("double").alias("len")), ["u", "v"])
    whole = run.agg(F.sum(F.col("flow") * F.col("len") / 1000).alias("run"))
    return flow.crossJoin(F.broadcast(whole)).select("u", "v", (F.col("flow") * km / F.col("run")).alias("flow"))


def compare_counts(modeled: DataFrame, counters: DataFrame, *, observed: str = "observed", key: Sequence[str] = ("u", "v", "k"), value: str = "flow") -> DataFrame:
    """One row: ``n`` counters with a modeled and an observed value, squared correlation, slope through the origin, RMSE."""
    met = counters.join(modeled.select(*key, F.col(value).cast("double").alias("m")), list(key)).withColumn("o", F.col(observed).cast("double")).filter(finite("m") & finite("o"))
    m, o = F.col("m"), F.col("o")
    squares = F.sum(o * o)
    return met.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.pow(F.corr("m", "o"), 2), F.lit(NAN)).alias("r2"), F.when(squares > 0, F.sum(m * o) / squares).otherwise(NAN).alias("slope"), F.coalesce(F.sqrt(F.avg((m - o) * (m - o))), F.lit(NAN)).alias("rmse"))


def lognormal(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Maximum-likelihood lognormal fit of the positive values: ``n, mu, sigma``."""
    ok = df.filter(finite(value) & (F.col(value) > 0)).withColumn("__l", F.log(F.col(value)))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("__l").alias("mu"), F.stddev_pop("__l").alias("sigma")]
    return ok.groupBy(*by).agg(*aggs) if by else ok.agg(*aggs)


def lognormal_density(x: Column, mu: float, sigma: float, shift: float = 0.0) -> Column:
    z = x - shift
    return F.when(z > 0, F.exp(-F.pow((F.log(z) - mu) / sigma, 2) / 2) / (z * sigma * (2 * 3.141592653589793) ** 0.5)).otherwise(0.0)


