"""Chained-equation imputation of categorical and numeric fields.

Each incomplete field gets an equation that predicts it from the others. An equation has two levels. Where the row's
group (its street) has known values of the field, the prediction is the group's most frequent value. Elsewhere a model
fitted on all rows predicts it: a naive Bayes classifier, fitted by distributed counts, for a category, and a ridge
regression over hashed indicator columns, fitted by one distributed aggregation, for a number. The fields are visited
in turn, each refitted with the current fills of the others, for a fixed number of rounds. Masks are kept from the
start, so only missing entries are ever written, and the models' predictions are seeded draws (from the predicted
distribution, or with a residual drawn from those of the fit), so filled values keep the field's variation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, plan_bytes, release, settled
from .skew import lookup

#: Columns into which the regression's indicators are hashed.
HASHED = 256
#: Quantiles that stand for the distribution of the residuals.
QUANTILES = 200


@dataclass(frozen=True)
class Field:
    """An incomplete field: ``value`` is its known value or null; ``rank`` orders values where counts are equal."""

    name: str
    value: Column
    trusted: Column | None = None
    """Which known values may be learnt from and filled in; default all."""
    number: tuple[float, float] | None = None
    """Least and greatest value of a numeric field, predicted by a regression; a category otherwise."""


def _majority(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key the value with the highest ``n``, the smallest of equals, by a mergeable aggregate."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(value)))
    return counts.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col(f"best.{value}").alias("fill"))


def group_fill(df: DataFrame, key: str, group: str, fields: Sequence[Field]) -> DataFrame:
    """Level one: rows ``(key, <field>, <field>_missing, <field>_fill)`` where the fill is null without evidence.

    One pass over ``df`` per field counts values per group (combined before the shuffle), so a group with a third of all
    rows costs a task no more than its distinct values; the look-up splits such a group. Rows with a null group have no
    evidence. Equal rows count once.
    """
    cols = [F.col(key), F.col(group), *[f.value.alias(f.name) for f in fields], *[F.coalesce(f.trusted & f.value.isNotNull(), F.lit(False)).alias(f"{f.name}_trusted") if f.trusted is not None else f.value.isNotNull().alias(f"{f.name}_trusted") for f in fields]]
    rows = df.filter(F.col(key).isNotNull()).select(*cols).distinct()
    out = rows
    for f in fields:
        seen = rows.filter(F.col(f"{f.name}_trusted") & F.col(group).isNotNull()).groupBy(group, f.name).agg(F.count(F.lit(1)).alias("n"))
        fill = _majority(seen, [group], f.name).withColumnRenamed("fill", f"{f.name}_fill")
        out = lookup(out, fill, [group], [key])
    for f in fields:
        missing = F.col(f.name).isNull()
        out = out.withColumn(f"{f.name}_missing", missing).withColumn(f"{f.name}_fill", F.when(missing, F.col(f"{f.name}_fill")))
    return out


def chained(df: DataFrame, key: str, group: str, fields: Sequence[Field], predictors: Mapping[str, Column] | None = None, *, rounds: int = 3, draw: bool = True, seed: int = 7, smoothing: float = 1.0) -> DataFrame:
    """All rows with every field filled: ``key``, and per field ``<f>`` (completed), ``<f>_filled`` (was missing and got a
    value) and ``<f>_by`` (``group``, ``chain`` or null).

    ``predictors`` are further categorical columns that are never filled; null is a category of its own, and of a key with
    several rows the least values count. ``draw`` takes a seeded draw of the model's distribution (the same for the same
    key and seed) instead of its peak or mean; it applies only where the group tells nothing. A field without a single
    known value stays null; an empty table gives an empty result.

    The number of distinct values of fields and predictors must be small (classes of a tag, lanes, binned numbers). The
    fitted tables hold classes times categories; they are broadcast where measured to be small and joined otherwise. Only
    rows with an open entry are written again, once a field and round.
    """
    predictors = dict(predictors or {})
    state = group_fill(df, key, group, fields)
    if predictors:
        least = F.min(F.struct(*[c.cast("string").alias(f"__p_{n}") for n, c in predictors.items()]))
        extra = df.filter(F.col(key).isNotNull()).groupBy(key).agg(least.alias("__p"))
        state = state.join(extra, key, "left").select(*state.columns, *[F.col(f"__p.__p_{n}").alias(f"__p_{n}") for n in predictors])
    for f in fields:
        state = state.withColumn(f"{f.name}_by", F.when(F.col(f"{f.name}_missing"), F.when(F.col(f"{f.name}_fill").isNotNull(), "group").otherwise("open")))
    state = settled(state)
    is_open = F.lit(False)
    for f in fields:
        is_open = is_open | F.coalesce(F.col(f"{f.name}_by") == "open", F.lit(False))
    closed, todo = state.filter(~is_open), settled(state.filter(is_open))
    current = {f.name: F.coalesce(F.col(f.name), F.col(f"{f.name}_fill")) for f in fields}
    for _ in range(rounds):
        for f in fields:
            features = {n: F.coalesce(F.col(f"__p_{n}"), F.lit("␀")) for n in predictors}
            features |= {g.name: F.coalesce(current[g.name].cast("string"), F.lit("␀")) for g in fields if g.name != f.name}
            known = closed.unionByName(todo).filter(F.col(f"{f.name}_trusted")).select(F.col(f.name).alias("y"), *[c.alias(n) for n, c in features.items()])
            mine = todo.withColumns({f"__f_{n}": c for n, c in features.items()})
            model = _classified if f.number is None else _regressed
            guess = model(known, mine, key, list(features), f, draw, f"{seed}:{f.name}", smoothing)
            if guess is None:
                continue
            at_open = F.col(f"{f.name}_by") == "open"
            filled = guess.withColumn(f"{f.name}_fill", F.when(at_open, F.col("guess").cast(state.schema[f"{f.name}_fill"].dataType)).otherwise(F.col(f"{f.name}_fill"))).select(*state.columns)
            done = settled(filled)
            release(todo)
            todo = done
    out = [F.col(key)]
    for f in fields:
        by = F.when((F.col(f"{f.name}_by") != "open"), F.col(f"{f.name}_by")).when(F.col(f"{f.name}_fill").isNotNull(), "chain")
        out += [current[f.name].alias(f.name), (F.col(f"{f.name}_missing") & F.col(f"{f.name}_fill").isNotNull()).alias(f"{f.name}_filled"), by.alias(f"{f.name}_by")]
    return closed.unionByName(todo).select(*out)


def uniform(key: str, seed: str, *more: Column) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    return (F.pmod(F.xxhash64(F.col(key), F.lit(seed), *more), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _classified(known: DataFrame, rows: DataFrame, key: str, features: list[str], f: Field, draw: bool, seed: str, smoothing: float) -> DataFrame | None:
    """``rows`` (features as ``__f_<name>``) with ``guess``: the naive Bayes classifier's peak, or a draw by Gumbel noise.

    Scores are arrays over the sorted classes, one per category of a feature, so that a row meets one small table per
    feature and nothing is shuffled by class.
    """
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("category")) for n in features]))
    counted = settled(known.select("y", each).groupBy("feature", "category", "y").agg(F.count(F.lit(1)).alias("n"))) if features else None
    classes = known.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    one = classes.agg(F.sort_array(F.collect_list(F.struct("y", "n"))).alias("c"), F.sum("n").alias("all"))
    # log P(y), less what every feature's smoothed counts are divided by; a category never seen tells nothing
    lp = F.transform("c", lambda c: F.log((c["n"] + smoothing) / (F.col("all") + smoothing * F.size("c"))) - len(features) * F.log(c["n"] + smoothing))
    base = settled(one.filter(F.size("c") > 0).select(F.col("c.y").alias("__ys"), lp.alias("__score")))
    if base.isEmpty():
        return None
    out = rows.crossJoin(F.broadcast(base))  # one row
    bounded = counted is not None and plan_bytes(counted) <= BROADCAST_BYTES
    for n in features:
        gains = counted.filter(F.col("feature") == n).groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("y", (F.log(F.col("n") + smoothing) - F.log(F.lit(smoothing))).alias("gain")))).alias("gains"))
        gains = gains.select(F.col("category").alias(f"__f_{n}"), F.col("gains").alias("__gains"))
        gain = lambda y: F.coalesce(F.try_element_at("__gains", y), F.lit(0.0))
        out = out.join(F.broadcast(gains) if bounded else gains, f"__f_{n}", "left").withColumn("__score", F.when(F.col("__gains").isNull(), F.col("__score")).otherwise(F.zip_with("__score", F.transform("__ys", gain), lambda a, b: a + b))).drop("__gains")
    noise = (lambda y: -F.log(-F.log(uniform(key, seed, y.cast("string"))))) if draw else (lambda y: F.lit(0.0))
    best = F.array_min(F.zip_with("__score", "__ys", lambda s, y: F.struct((-F.round(s + noise(y), 9)).alias("neg"), y.alias("y"))))
    return out.withColumn("guess", best["y"])


def _regressed(known: DataFrame, rows: DataFrame, key: str, features: list[str], f: Field, draw: bool, seed: str, smoothing: float) -> DataFrame | None:
    """``rows`` with ``guess``: the ridge regression's mean, or with a residual drawn from the distribution of those of the fit,
    rounded and kept within the field's bounds. The driver gets coefficients and quantiles only."""
    from pyspark.ml.feature import FeatureHasher
    from pyspark.ml.regression import LinearRegression

    named = [f"__f_{n}" for n in features]
    hashed = FeatureHasher(inputCols=[*named, "__one"], categoricalCols=named, outputCol="__x", numFeatures=HASHED)
    learnt = known.select(F.col("y").cast("double").alias("__y"), *[F.col(n).alias(f"__f_{n}") for n in features], F.lit(1.0).alias("__one"))
    if learnt.isEmpty():
        return None
    fit = LinearRegression(featuresCol="__x", labelCol="__y", predictionCol="__mean", solver="normal", regParam=1e-6).fit(hashed.transform(learnt))
    rest = fit.transform(hashed.transform(learnt)).select((F.col("__y") - F.col("__mean")).alias("r"))
    steps = [(i + 0.5) / QUANTILES for i in range(QUANTILES)]
    quantiles = rest.agg(F.percentile_approx("r", steps, 10_000).alias("q")).first().q
    out = fit.transform(hashed.transform(rows.withColumn("__one", F.lit(1.0))))
    residual = F.get(F.array(*[F.lit(float(q)) for q in quantiles]), F.floor(uniform(key, seed) * len(quantiles)).cast("int")) if draw else F.lit(0.0)
    low, high = f.number
    return out.withColumn("guess", F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.round(F.col("__mean") + residual))))
