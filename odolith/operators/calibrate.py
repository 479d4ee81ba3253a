"""Calibrating edge weights against measured trips: snapping, routing and least squares in turns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import INF, DataError, finite, known, require, total
from ..session import release, settled
from .mapping import nearest
from .routing import collapse, trip_metrics


def baseline_duration(speed: str = "speed_kph", length: str = "length") -> Column:
    """Seconds to travel an edge at its speed; a speed that is not positive is an error."""
    ok = finite(speed) & (F.col(speed) > 0)
    return F.when(ok, F.col(length) / (F.col(speed) / 3.6)).otherwise(F.raise_error(F.lit("speed must be positive")).cast("double"))


def durations(base: Column, alpha: float, factors: dict[str, float], sums: dict[str, float], least: float = 0.01) -> Column:
    """``alpha * base + base * sum(c * factor) + sum(c * attribute)``, at least ``least``; an undefined attribute counts as 0."""
    zero = lambda n: F.coalesce(known(F.col(n).cast("double")), F.lit(0.0))
    out = F.lit(float(alpha)) * base
    for n, c in factors.items():
        out = out + base * F.lit(float(c)) * zero(n)
    for n, c in sums.items():
        out = out + F.lit(float(c)) * zero(n)
    return F.greatest(out, F.lit(float(least)))


def usable_legs(legs: DataFrame, nodes: DataFrame, *, min_line: float = 0.0, max_line: float = INF, max_ratio: float = INF, max_snap: float = INF, node: str = "node_id") -> DataFrame:
    """Legs with ``origin`` and ``dest`` nodes: those whose straight distance is in range, whose measured one is less than
    ``max_ratio`` times it, and whose ends both snap. Of a trip with several rows the least counts."""
    require(legs, "trip_id", "orig_x", "orig_y", "dest_x", "dest_y", "time_measured")
    line = F.sqrt(F.pow(F.col("orig_x") - F.col("dest_x"), 2) + F.pow(F.col("orig_y") - F.col("dest_y"), 2))
    rows = legs.filter(finite("orig_x") & finite("orig_y") & finite("dest_x") & finite("dest_y") & finite("time_measured") & F.col("trip_id").isNotNull()).withColumn("line", line)
    ok = (F.col("line") >= min_line) & (F.col("line") < max_line)
    if max_ratio < INF and "dist_measured" in legs.columns:
        ok = ok & finite("dist_measured") & (F.col("dist_measured") < max_ratio * F.col("line"))
    keep = ["trip_id", "orig_x", "orig_y", "dest_x", "dest_y", "time_measured", "line"]
    rows = rows.filter(ok).groupBy("trip_id").agg(F.min(F.struct(*keep[1:])).alias("r"))
    rows = settled(rows.select("trip_id", "r.*"))
    pts = settled(nodes.filter(finite("x") & finite("y")).select(F.col(node).alias("id"), "x", "y").distinct())
    for end, name in (("orig", "origin"), ("dest", "dest")):
        places = rows.select(F.col("trip_id").alias("id"), F.col(f"{end}_x").alias("x"), F.col(f"{end}_y").alias("y"))
        hit = nearest(places, pts, max_distance=max_snap).filter("right_id is not null")
        rows = rows.join(hit.select(F.col("left_id").alias("trip_id"), F.col("right_id").alias(name), F.col("distance").alias(f"{name}_snap")), "trip_id")
    return rows


@dataclass
class Fit:
    """Least squares: coefficients, their p-values, R² and the number of rows."""

    names: list[str]
    coefficients: np.ndarray
    p_values: np.ndarray
    r2: float
    n: int


def _beta_tail(t: float, dof: int) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else math.nan
    x, a, b = dof / (dof + t * t), dof / 2.0, 0.5
    if x >= 1.0:
        return 1.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1.0)) or tiny)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / ((1.0 + num * d) or tiny)
                c = (1.0 + num / c) or tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * fraction(a, b, x) / a
    return 1.0 - front * fraction(b, a, 1.0 - x) / b


def least_squares(df: DataFrame, y: str, xs: Sequence[str], *, strict: bool = True) -> Fit:
    """Ordinary least squares without a constant of its own: one aggregation of all products, solved on the driver, which gets
    one row whatever the data. Rows with an undefined value are left out; an ill-posed system is a DataError.

    Without ``strict`` an ill-posed system has NaN for its coefficients, p-values and R², and as many rows as coefficients are
    met exactly, which leaves the p-values NaN.
    """
    names = [*xs, y]
    ok = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    for i in range(len(names)):
        ok = ok.filter(finite(f"c{i}"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = ok.agg(F.count(F.lit(1)).alias("n"), F.avg(f"c{len(xs)}").alias("m"), (F.min(f"c{len(xs)}") == F.max(f"c{len(xs)}")).alias("level"), *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i, j in pairs]).first()
    k, n = len(xs), row.n
    undetermined = Fit(list(xs), np.full(k, np.nan), np.full(k, np.nan), math.nan, n)
    if n < k or strict and n == k:
        if strict:
            raise DataError(f"{n} rows for {k} coefficients")
        return undetermined
    full = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        full[i, j] = full[j, i] = row[f"s{i}_{j}"]
    a, b = full[:k, :k], full[:k, k]
    scale = np.sqrt(np.diag(a))
    if (scale == 0).any() or np.linalg.cond(a / np.outer(scale, scale)) > 1e12:
        if strict:
            raise DataError("the regressors are not independent")
        return undetermined
    inverse = np.linalg.inv(a / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inverse @ b
    rss = max(0.0, full[k, k] - beta @ b)
    tss = 0.0 if row.level else full[k, k] - n * row.m**2
    if n > k:
        se = np.sqrt(np.diag(inverse) * rss / (n - k))
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.array([_beta_tail(float(t), n - k) for t in beta / se])
    else:
        p = undetermined.p_values
    return Fit(list(xs), beta, p, 1 - rss / tss if tss > 0 else math.nan, n)


def with_endpoints(routed: DataFrame, legs: DataFrame, nodes: DataFrame, features: Sequence[str], *, node: str = "node_id") -> DataFrame:
    """``routed`` trips with ``<feature>_orig`` and ``<feature>_dest``, node columns at either end of the leg, null for an unknown
    node. ``snap_dist`` is the distance from the leg's end to its node, which the legs have."""
    at_node = [f for f in features if f != "snap_dist"]
    ends = legs.select("trip_id", "origin", "dest", *[F.col(c).alias(a) for c, a in (("origin_snap", "snap_dist_orig"), ("dest_snap", "snap_dist_dest")) if "snap_dist" in features])
    if at_node:
        table = nodes.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("__n")).agg(*[F.max(F.col(f).cast("double")).alias(f) for f in at_node])
        for end, tag in (("origin", "orig"), ("dest", "dest")):
            ends = ends.join(table.select(F.col("__n").alias(end), *[F.col(f).alias(f"{f}_{tag}") for f in at_node]), end, "left")
    return routed.join(ends.drop("origin", "dest"), "trip_id", "left")


def design(routed: DataFrame, factors: Sequence[str] = (), sums: Sequence[str] = (), endpoints: Sequence[str] = (), *, constant: bool = True, keep: Sequence[str] = ("trip_id",)) -> tuple[DataFrame, list[str]]:
    """The design matrix and its column names: ``const``, ``baseline_time`` (the trip's cost), ``<f>__mult`` (cost times the factor's
    mean along the path), the sums along the path, and for each endpoint feature ``<f>_orig`` and ``<f>_dest``."""
    columns = {"const": F.lit(1.0)} if constant else {}
    columns["baseline_time"] = F.col("cost").cast("double")
    columns |= {f"{f}__mult": (F.col("cost") * F.col(f)).cast("double") for f in factors}
    columns |= {f: F.col(f).cast("double") for f in sums}
    columns |= {f"{f}_{tag}": F.col(f"{f}_{tag}").cast("double") for f in endpoints for tag in ("orig", "dest")}
    return routed.select(*keep, *[c.alias(n) for n, c in columns.items()]), list(columns)


@dataclass
class Calibration:
    """Edge-weight coefficients with statistics, fitted edges, per-trip predictions and the log of the iterations.

    ``endpoints`` are the means of the coefficients of either end.
    """

    alpha: float
    factors: dict[str, float]
    sums: dict[str, float]
    endpoints: dict[str, float]
    constant: float
    fit: Fit
    edges: DataFrame
    predictions: DataFrame
    log: list[dict[str, float]]


def calibrate(edges: DataFrame, nodes: DataFrame, legs: DataFrame, *, factors: Sequence[str] | Mapping[str, float] = (), sums: Sequence[str] | Mapping[str, float] = (), endpoints: Sequence[str] = (), constant: bool = True, iterations: int = 3, speed: str = "speed_kph", cutoff: float = INF, oneway: str | None = None, directed: bool = True, node: str = "node_id", of: str = "cost", strict: bool = True, **snapping: float) -> Calibration:
    """Fit ``time = constant + alpha * cost + factors of the cost + sums + endpoint terms`` to measured trips, reroute with the
    new weights, and again.

    ``factors`` scale an edge's baseline duration and enter as cost times their length-weighted mean along the path, ``sums`` are
    added up along it, ``endpoints`` are node columns, or ``snap_dist``, at either end; mappings give first coefficients. ``of`` tells
    what ``baseline_time`` is after the first round: the trip's ``cost`` by the weights it was routed on, or its ``baseline`` duration,
    with which coefficients of different rounds mean the same. The driver holds coefficients only; the snapped legs are written once. No usable leg is a DataError,
    as is a round that is ill-posed; without ``strict`` such a round is the last, its fit is undetermined (``least_squares``) and the
    weights stay those it was routed on.
    """
    base = settled(edges.withColumn("__base", baseline_duration(speed)))
    trips = settled(usable_legs(legs, nodes, node=node, **snapping))
    if strict and trips.isEmpty():
        raise DataError("no usable leg")
    if of not in ("cost", "baseline"):
        raise ValueError("of must be cost or baseline")
    start = lambda x: dict(x) if isinstance(x, Mapping) else dict.fromkeys(x, 0.0)
    alpha, f, s, e, shift, fit, log, routed = 1.0, start(factors), start(sums), {}, 0.0, None, [], None
    attributes = list(dict.fromkeys((*f, *s)))
    for i in range(iterations):
        weighted = base.withColumn("__w", durations(F.col("__base"), alpha, f, s))
        graph = settled(collapse(weighted, "__w", list(dict.fromkeys(["length", "__base", *attributes])), oneway=oneway, directed=directed))
        found = trip_metrics(trips, graph, features={**dict.fromkeys(f, "length_weighted"), **dict.fromkeys(s, "sum"), "__base": "sum"}, cutoff=cutoff)
        if of == "baseline":
            found = found.withColumn("cost", F.col("__base"))
        found = with_endpoints(found, trips, nodes, endpoints, node=node).join(trips.select("trip_id", F.col("time_measured").alias("__y"), "line"), "trip_id")
        x, names = design(found, list(f), list(s), endpoints, constant=constant, keep=("trip_id", "line", "__y"))
        done = settled(x)
        release(routed, graph)
        routed = done
        fit = least_squares(routed, "__y", names, strict=strict)
        if np.isnan(fit.coefficients).any():
            break
        got = dict(zip(names, map(float, fit.coefficients), strict=True))
        alpha, shift = got["baseline_time"], got.get("const", 0.0)
        f, s = {n: got[f"{n}__mult"] for n in f}, {n: got[n] for n in s}
        e = {n: (got[f"{n}_orig"] + got[f"{n}_dest"]) / 2 for n in endpoints}
        log.append({"iteration": i, "r2": fit.r2, "n": fit.n, "alpha": alpha, "constant": shift, **f, **s, **e})
    predicted = total(F.lit(0.0), *[F.lit(float(c)) * F.col(n) for n, c in zip(fit.names, fit.coefficients, strict=True)])
    predictions = routed.select("trip_id", "line", F.col("__y").alias("measured"), predicted.alias("predicted"))
    out = base.withColumn("duration", durations(F.col("__base"), alpha, f, s)).drop("__base")
    return Calibration(alpha, f, s, e, shift, fit, out, predictions, log)


def rmse_by_distance(predictions: DataFrame) -> DataFrame:
    """``(band, n, rmse)`` for straight distances below 10 km, up to 25 km and beyond; null for an empty band."""
    spark = predictions.sparkSession
    bands = spark.createDataFrame([("<10 km",), ("10-25 km",), (">=25 km",)], "band string")
    band = F.when(F.col("line") < 10_000, "<10 km").when(F.col("line") < 25_000, "10-25 km").otherwise(">=25 km")
    per = predictions.withColumn("band", band).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(F.col("measured") - F.col("predicted"), 2))).alias("rmse"))
    return bands.join(per, "band", "left").withColumn("n", F.coalesce("n", F.lit(0)))
