"""Shortest paths: least costs, features along the paths, and the paths themselves.

A graph is a table of directed edges. Two engines give the same routes: where the collapsed graph was counted to fit in
a bounded broadcast, each task searches it from its origins, many at once (``kernel``), stopping once all destinations
are settled; a larger graph stays distributed and is relaxed by joins, frontier by frontier, and traced back by joins.

Among paths of equal cost the one with fewer edges wins, then the one whose last step comes from the smaller node, so
features along paths are defined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import INF, NAN, DataError, finite, known, require, total
from ..session import release, settled, shipped, table_path
from . import kernel

#: Collapsed edges up to which a graph is broadcast (about 50 bytes each as arrays).
BROADCAST_EDGES = 5_000_000


@dataclass(frozen=True)
class PathAggregation:
    """A reduction of an edge column, or of a Column over an edge's ``u``, ``v``, ``weight`` and attributes, along a path.

    ``how`` is ``sum``, ``mean``, ``min`` or ``max``, for which empty paths give 0 for a sum, else NaN; or a function of the
    values in travel order, a numpy array that may be empty, to a number. Undefined values are skipped.
    """

    name: str
    attribute: str | Column
    how: str | Callable[[np.ndarray], float] = "sum"


@dataclass(frozen=True)
class NodeAggregation:
    """A reduction of a node column, or of a Column over the node table, along a path, with or without its two end nodes."""

    name: str
    attribute: str | Column
    how: str | Callable[[np.ndarray], float] = "sum"
    include_endpoints: bool = True


def _named(df: DataFrame | None, aggregations: Sequence, tag: str) -> tuple[DataFrame | None, list]:
    """The table with a column for every attribute that is given as a Column, and the aggregations over names only."""
    out = []
    for i, a in enumerate(aggregations):
        if not isinstance(a.attribute, str):
            df = df.withColumn(f"__{tag}{i}", a.attribute)
            a = replace(a, attribute=f"__{tag}{i}")
        out.append(a)
    return df, out


def with_weight(edges: DataFrame, name: str, weight: Column | Callable[[pd.DataFrame], pd.Series], columns: Sequence[str] = ()) -> DataFrame:
    """Edges with a computed column: a Column, or for what no Column expresses a function of a pandas table of the ``columns``,
    applied to Arrow batches."""
    if isinstance(weight, Column):
        return edges.withColumn(name, weight)

    def run(part: pd.DataFrame) -> pd.Series:
        return weight(part).astype(float)

    run.__annotations__ = {"part": pd.DataFrame, "return": pd.Series}
    return edges.withColumn(name, F.pandas_udf(run, "double")(F.struct(*columns)))


def with_combined(edges: DataFrame, sources: Sequence[str], name: str) -> DataFrame:
    """Edges with the sum of columns."""
    return edges.withColumn(name, total(*[F.col(s) for s in sources]))


def edge_time(*, speed: Column, length: Column | str = "length", slowed: Mapping[str, float] | None = None, added: Mapping[str, float] | None = None, least_kph: float = 1.0, most_kph: float | None = None) -> Column:
    """Seconds to pass an edge: its length at ``speed * (1 + sum(c * column))`` of the ``slowed`` columns, no slower than ``least_kph``,
    plus ``c * column`` of the ``added`` ones (climb, descent, junctions), in all no faster than ``most_kph``. An undefined column counts as 0."""
    zero = lambda n: F.coalesce(known(F.col(n).cast("double")), F.lit(0.0))
    length = F.col(length) if isinstance(length, str) else length
    factor = total(F.lit(1.0), *[F.lit(float(c)) * zero(n) for n, c in (slowed or {}).items()])
    out = total(length / (F.greatest(speed * factor, F.lit(float(least_kph))) / 3.6), *[F.lit(float(c)) * zero(n) for n, c in (added or {}).items()])
    return out if most_kph is None else F.greatest(out, length / (most_kph / 3.6))


def collapse(edges: DataFrame, weight: str, attributes: Sequence[str] = (), *, directed: bool = True, oneway: str | None = None) -> DataFrame:
    """One edge ``(u, v, weight, k, attributes)`` per node pair and direction: of parallel ones the lightest, then the smallest ``k``.

    Without ``directed`` every edge runs both ways; with ``oneway`` those where that column is not true do. Edges with an
    undefined, infinite or negative weight are unusable and left out. Loops are dropped.
    """
    require(edges, "u", "v", weight, *attributes)
    k = F.col("k") if "k" in edges.columns else F.lit(0)
    one = edges.filter(finite(weight) & (F.col(weight) >= 0) & F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    back = F.lit(not directed) if oneway is None else ~F.coalesce(F.col(oneway), F.lit(False))
    ends = F.inline(F.filter(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(True).alias("on")), F.struct(F.col("v").alias("a"), F.col("u").alias("b"), back.alias("on"))), lambda s: s["on"]))
    both = one.select(F.col(weight).cast("double").alias("w"), k.cast("long").alias("k"), *attributes, ends)
    best = F.min(F.struct("w", "k", *attributes))
    return both.groupBy("a", "b").agg(best.alias("m")).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("m.w").alias("weight"), F.col("m.k").alias("k"), *[F.col(f"m.{a}").alias(a) for a in attributes])


def _arrays(graph: DataFrame, attributes: Sequence[str], nodes: DataFrame | None, node: str, node_attributes: Sequence[str]) -> kernel.Network:
    e = graph.select("u", "v", "weight", *[F.col(a).cast("double").alias(f"e{i}") for i, a in enumerate(attributes)]).toArrow()  # rows as Python objects take several times the memory
    n = None
    if nodes is not None:
        n = nodes.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.max(F.lit(1)).alias("one"), *[F.max(F.col(a).cast("double")).alias(f"n{i}") for i, a in enumerate(node_attributes)]).toArrow()
    net = kernel.network(e["u"].to_numpy(), e["v"].to_numpy(), e["weight"].to_numpy(), [e[f"e{i}"].to_numpy() for i in range(len(attributes))], None if n is None else n["id"].to_numpy())
    for i in range(len(node_attributes)):
        full = np.full(len(net.ids), np.nan)
        full[np.searchsorted(net.ids, n["id"].to_numpy())] = n[f"n{i}"].to_numpy().astype(float)
        net.node_values.append(full)
    return net


def fits(graph: DataFrame, nodes: DataFrame | None = None) -> bool:
    """Whether a collapsed graph, and the nodes that are sent along, are counted to be within the broadcast bound."""
    return graph.count() <= BROADCAST_EDGES and (nodes is None or nodes.count() <= BROADCAST_EDGES)


def _names(edge_aggregations: Sequence[PathAggregation], node_aggregations: Sequence[NodeAggregation]) -> list[str]:
    names = [a.name for a in (*edge_aggregations, *node_aggregations)]
    if len(set(names)) < len(names) or {"origin", "dest", "cost", "path"} & set(names):
        raise ValueError("aggregations need distinct names")
    return names


def search(requests: DataFrame, graph: DataFrame, *, cutoff: float = INF, nodes: DataFrame | None = None, node: str = "node_id", edge_aggregations: Sequence[PathAggregation] = (), node_aggregations: Sequence[NodeAggregation] = (), paths: bool = False, carry: str | None = None) -> DataFrame:
    """``(origin, dest, cost)`` of distinct requests ``(origin, dest)``, with a column per aggregation and, if asked, ``path``.

    With ``carry``, a column of few values such as the tier, the requests ``(carry, origin, dest)`` are distinct and come out with
    it, so that nothing has to be joined back to them.

    ``graph`` is a collapsed graph that fits. Unreachable or beyond the cutoff: cost ``+inf``, aggregations NaN, path empty. A
    node to itself costs 0 over an empty path, known to the graph or not. Undefined attribute values are skipped. Each
    origin is searched once for all its destinations; an origin has at most as many as the broadcast graph has nodes.
    """
    spark = shipped(requests.sparkSession)
    graph, edge_aggregations = _named(graph, edge_aggregations, "e")
    nodes, node_aggregations = _named(nodes, node_aggregations, "n")
    edge_attrs = list(dict.fromkeys(a.attribute for a in edge_aggregations))
    node_attrs = list(dict.fromkeys(a.attribute for a in node_aggregations))
    names = _names(edge_aggregations, node_aggregations)
    shared = spark.sparkContext.broadcast(_arrays(graph, edge_attrs, nodes if node_attrs else None, node, node_attrs))
    kind = requests.schema["origin"].dataType
    more = [T.StructField(carry, requests.schema[carry].dataType)] if carry else []
    schema = T.StructType([*more, T.StructField("origin", kind), T.StructField("dest", kind), T.StructField("cost", T.DoubleType()), *[T.StructField(n, T.DoubleType()) for n in names], *([T.StructField("path", T.ArrayType(kind))] if paths else [])])
    of_edges = [(edge_attrs.index(a.attribute), a.how) for a in edge_aggregations]
    of_nodes = [(node_attrs.index(a.attribute), a.how, a.include_endpoints) for a in node_aggregations]
    detailed = bool(names) or paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        finder = kernel.Search(net, cutoff, detailed)
        for batch in batches:
            asked, offsets = batch.column(1).flatten(), batch.column(1).offsets.to_numpy()
            every = asked.field(0) if carry else asked
            carried = asked.field(1) if carry else None
            origins = net.index(batch.column(0).to_numpy(zero_copy_only=False))
            dests = net.index(every.to_numpy(zero_copy_only=False))
            offsets = offsets - offsets[0]
            for lo in range(0, batch.num_rows, finder.size):
                hi = min(batch.num_rows, lo + finder.size)
                a, b = offsets[lo], offsets[hi]
                row = np.repeat(np.arange(lo, hi), np.diff(offsets[lo : hi + 1]))
                origin, dest = batch.column(0).take(pa.array(row)), every.slice(a, b - a)
                at, to = origins[row], dests[a:b]
                cost = np.full(b - a, INF)
                own = pc.equal(origin, dest).to_numpy(zero_copy_only=False).astype(bool)
                cost[own] = 0.0
                # of another part of the network: out of reach without a search
                ask = np.flatnonzero(~own & (at >= 0) & (to >= 0))
                ask = ask[net.part[at[ask]] == net.part[to[ask]]]
                cost[ask] = finder.run(np.maximum(origins[lo:hi], 0), row[ask] - lo, to[ask])
                columns = [*([carried.slice(a, b - a)] if carry else []), origin, dest, pa.array(cost)]
                if detailed:
                    known = np.flatnonzero((cost < INF) & (at >= 0) & (to >= 0))
                    values, stops = _along(finder, row - lo, to, known, of_edges, of_nodes, paths, own & (at < 0))
                    columns += [pa.array(v) for v in values]
                    if paths:
                        columns.append(_lists(net, stops, origin, own & (at < 0)))
                finder.reset()
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    here = requests.filter("origin is not null and dest is not null").groupBy("origin")
    grouped = here.agg(F.collect_list(F.struct("dest", carry)) if carry else F.collect_set("dest"))
    return grouped.mapInArrow(run, schema)


def _along(finder: kernel.Search, slot: np.ndarray, to: np.ndarray, known: np.ndarray, of_edges: list, of_nodes: list, paths: bool, alone: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Aggregations of all requests of a batch, NaN where there is no path, and the nodes of the paths. ``alone`` are nodes unknown
    to the graph asked for themselves: an empty path."""
    empty = lambda how: float(how(np.empty(0))) if callable(how) else 0.0 if how == "sum" else NAN
    hows = [*[h for _, h in of_edges], *[h for _, h, _ in of_nodes]]
    values = [np.where(alone, empty(h), NAN) for h in hows]
    stops = [np.empty(0, np.int64)] * len(slot) if paths else []
    for lo in range(0, len(known), kernel.TRACED):
        some = known[lo : lo + kernel.TRACED]
        got, chains = kernel.reduced(finder, slot[some], to[some], of_edges, of_nodes, paths)
        for v, g in zip(values, got, strict=True):
            v[some] = g
        for i, chain in zip(some, chains, strict=False):
            stops[i] = chain
    return values, stops


def _lists(net: kernel.Network, stops: list[np.ndarray], origin: pa.Array, alone: np.ndarray) -> pa.Array:
    """Paths as lists of node ids; a node unknown to the graph is its own path."""
    sizes = np.array([len(s) for s in stops], np.int64)
    flat = np.concatenate(stops).astype(np.int64) if sizes.sum() else np.empty(0, np.int64)
    ids = pa.array(net.ids[flat] if len(flat) else [], origin.type)
    if alone.any():
        own = np.flatnonzero(alone)
        ids = pa.concat_arrays([ids, origin.take(pa.array(own))])
        place = np.concatenate([np.repeat(np.arange(len(stops)), sizes), own])
        ids = ids.take(pa.array(np.argsort(place, kind="stable")))
        sizes[own] = 1
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), ids)


def relax(origins: DataFrame, graph: DataFrame, *, cutoff: float = INF, most_rounds: int = 100_000) -> DataFrame:
    """``(origin, node, cost)`` of all nodes reachable within the cutoff, by distributed relaxation.

    Each round extends the paths that got better in the last one by an edge, and keeps the best per node. Rounds end when
    nothing got better, after at most as many as a shortest path has edges; every round's tables are written, so lineage
    stays short. For graphs beyond a broadcast; hot nodes are met by the join's skew handling.
    """
    best = held = settled(origins.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost")).distinct())
    frontier = best
    for _ in range(most_rounds):
        steps = frontier.join(graph.select(F.col("u").alias("node"), "v", "weight"), "node")
        steps = steps.select("origin", F.col("v").alias("node"), (F.col("cost") + F.col("weight")).alias("new")).filter(F.col("new") <= cutoff)
        steps = steps.groupBy("origin", "node").agg(F.min("new").alias("new"))
        met = settled(best.join(steps, ["origin", "node"], "full"))
        release(held)
        better = F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))
        frontier = met.filter(better).select("origin", "node", F.col("new").alias("cost"))
        if frontier.isEmpty():
            return met.select("origin", "node", "cost")
        held, best = met, met.select("origin", "node", F.least("cost", "new").alias("cost"))
    raise DataError("no end of the relaxation")


def labels(origins: DataFrame, graph: DataFrame, *, cutoff: float = INF, most_rounds: int = 100_000) -> DataFrame:
    """``(origin, node, cost, hops, prev)`` of all nodes reachable within the cutoff: ``relax`` with each node's best last step
    (null at the origin), chosen as ``search`` chooses it."""
    best = held = settled(origins.select("origin", F.col("origin").alias("node"), F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast(graph.schema["u"].dataType).alias("prev")).alias("best")).distinct())
    frontier = best.select("origin", "node", "best.cost", "best.hops")
    for _ in range(most_rounds):
        steps = frontier.join(graph.select(F.col("u").alias("node"), "v", "weight"), "node")
        steps = steps.select("origin", F.col("v").alias("node"), F.struct((F.col("cost") + F.col("weight")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("node").alias("prev")).alias("new"))
        steps = steps.filter(F.col("new.cost") <= cutoff).groupBy("origin", "node").agg(F.min("new").alias("new"))
        met = settled(best.join(steps, ["origin", "node"], "full"))
        release(held)
        held = met
        better = F.col("new").isNotNull() & (F.col("best").isNull() | (F.col("new") < F.col("best")))
        best = met.select("origin", "node", F.when(better, F.col("new")).otherwise(F.col("best")).alias("best"))
        # another last step at the same cost and hops changes nothing further on
        further = F.col("best").isNull() | (F.col("new.cost") != F.col("best.cost")) | (F.col("new.hops") != F.col("best.hops"))
        frontier = met.filter(better & further).select("origin", "node", "new.cost", "new.hops")
        if frontier.isEmpty():
            return best.select("origin", "node", "best.cost", "best.hops", "best.prev")
    raise DataError("no end of the relaxation")


def _traced(asked: DataFrame, reached: DataFrame) -> DataFrame:
    """``(origin, dest, path)`` of the reached requests with two ends, back from the destination, a step a round; every
    round writes its steps once."""
    spark, folder, i = asked.sparkSession, table_path(asked.sparkSession), 0
    at = asked.filter(F.col("origin") != F.col("dest")).withColumn("node", F.col("dest"))
    while True:
        step = at.join(reached, ["origin", "node"]).filter("hops > 0").select("origin", "dest", "node", "hops", "prev")
        step.write.parquet(f"{folder}/round={i}")
        step = spark.read.schema(step.schema).parquet(f"{folder}/round={i}")
        if step.isEmpty():
            break
        at, i = step.select("origin", "dest", F.col("prev").alias("node")), i + 1
    every = spark.read.schema(step.schema).parquet(folder)
    stops = F.transform(F.sort_array(F.collect_list(F.struct("hops", "node"))), lambda s: s["node"])
    return every.groupBy("origin", "dest").agg(stops.alias("stops")).select("origin", "dest", F.concat(F.array("origin"), "stops").alias("path"))


def _relaxed(requests: DataFrame, graph: DataFrame, *, cutoff: float, nodes: DataFrame | None, node: str, edge_aggregations: Sequence[PathAggregation], node_aggregations: Sequence[NodeAggregation], paths: bool) -> DataFrame:
    """What ``search`` gives, by relaxation, tracing and joins."""
    names = _names(edge_aggregations, node_aggregations)
    graph, edge_aggregations = _named(graph, edge_aggregations, "e")
    nodes, node_aggregations = _named(nodes, node_aggregations, "n")
    asked = settled(requests.filter("origin is not null and dest is not null").select("origin", "dest").distinct())
    reached = settled(labels(asked.select("origin").distinct(), graph, cutoff=cutoff))
    own = F.col("origin") == F.col("dest")
    cost = F.when(own, 0.0).otherwise(F.coalesce("cost", F.lit(INF))).alias("cost")
    path = F.when(own, F.array("origin")).otherwise(F.coalesce("path", F.array().cast(T.ArrayType(asked.schema["origin"].dataType)))).alias("path")
    found = asked.join(reached.select("origin", F.col("node").alias("dest"), "cost"), ["origin", "dest"], "left").join(_traced(asked, reached), ["origin", "dest"], "left")
    found = settled(found.select(F.struct("origin", "dest").alias("id"), cost, path))
    out = found.select("id", "cost", *(["path"] if paths else []))
    if names:
        plain = [replace(a, name=f"__f{i}") for i, a in enumerate((*edge_aggregations, *node_aggregations))]
        at_edge, at_node = plain[: len(edge_aggregations)], plain[len(edge_aggregations) :]
        table = nodes.filter(F.col(node).isNotNull()).groupBy(node).agg(*[F.max(F.col(a).cast("double")).alias(a) for a in dict.fromkeys(a.attribute for a in at_node)]) if at_node else None
        out = out.join(along_paths(found, "id", graph, nodes=table, node=node, edge_aggregations=at_edge, node_aggregations=at_node).drop("cost"), "id")
    return out.select("id.origin", "id.dest", "cost", *[F.col(f"__f{i}").alias(n) for i, n in enumerate(names)], *(["path"] if paths else []))


def routes(requests: DataFrame, graph: DataFrame, *, cutoff: float = INF, nodes: DataFrame | None = None, node: str = "node_id", edge_aggregations: Sequence[PathAggregation] = (), node_aggregations: Sequence[NodeAggregation] = (), paths: bool = False) -> DataFrame:
    """``search`` by whichever engine the sizes of the graph, and of the nodes where they are asked for, allow."""
    engine = search if fits(graph, nodes if node_aggregations else None) else _relaxed
    return engine(requests, graph, cutoff=cutoff, nodes=nodes, node=node, edge_aggregations=edge_aggregations, node_aggregations=node_aggregations, paths=paths)


def distances_from(graph: DataFrame, origin, *, cutoff: float = INF) -> DataFrame:
    """``(node, cost)`` of the nodes reachable from one origin."""
    kind = graph.schema["u"].dataType
    one = graph.sparkSession.createDataFrame([(origin,)], T.StructType([T.StructField("origin", kind)]))
    if not fits(graph):
        return relax(one, graph, cutoff=cutoff).select("node", "cost")
    nodes = graph.select(F.col("v").alias("dest")).unionByName(graph.select(F.col("u").alias("dest"))).distinct()
    return search(nodes.crossJoin(F.broadcast(one)), graph, cutoff=cutoff).filter(finite("cost")).select(F.col("dest").alias("node"), "cost")


def costs(requests: DataFrame, graph: DataFrame, *, cutoff: float = INF) -> DataFrame:
    """``(origin, dest, cost)`` of distinct requests by whichever engine the graph's size allows."""
    if fits(graph):
        return search(requests, graph, cutoff=cutoff)
    reached = relax(requests.select("origin").distinct(), graph, cutoff=cutoff).withColumnRenamed("node", "dest")
    asked = requests.select("origin", "dest").distinct().join(reached, ["origin", "dest"], "left")
    return asked.select("origin", "dest", F.when(F.col("origin") == F.col("dest"), 0.0).otherwise(F.coalesce("cost", F.lit(INF))).alias("cost"))


def pairwise(graph: DataFrame, origins: DataFrame, destinations: DataFrame, *, cutoff: float = INF) -> DataFrame:
    """Costs of every origin to every destination: the stated matrix, searched origin by origin."""
    asked = origins.select("origin").distinct().join(F.broadcast(destinations.select("dest").distinct()) if destinations.count() <= 100_000 else destinations.select("dest").distinct(), F.lit(True))
    return costs(asked, graph, cutoff=cutoff)


def _straight(pairs: DataFrame, graph: DataFrame, nodes: DataFrame | None, mask: str | None) -> bool:
    """Whether pairs can go through the search with their tier and nothing else, one shuffle in all."""
    return mask is None and sorted(pairs.columns) == ["dest", "origin", "tier"] and fits(graph, nodes)


def tiered_costs(pairs: DataFrame, graph: DataFrame, *, mask: str | None = None, cutoff: float = INF) -> DataFrame:
    """``pairs`` (distinct ``tier``, ``origin``, ``dest``) with ``cost``: ``+inf`` where masked out, unreachable or beyond the
    cutoff. Each origin is searched once for all tiers; masked pairs are not searched."""
    if _straight(pairs, graph, None, mask):
        found = search(pairs, graph, cutoff=cutoff, carry="tier").select(*pairs.columns, "cost")
        return found.unionByName(pairs.filter("origin is null or dest is null").withColumn("cost", F.lit(INF)))
    ask = pairs.filter(F.col(mask)) if mask else pairs
    found = costs(ask.select("origin", "dest").distinct(), graph, cutoff=cutoff)
    out = pairs.join(found, ["origin", "dest"], "left")
    value = F.coalesce("cost", F.lit(INF))
    return out.select(*pairs.columns, (F.when(F.col(mask), value).otherwise(INF) if mask else value).alias("cost"))


def tiered_aggregate(pairs: DataFrame, graph: DataFrame, *, nodes: DataFrame | None = None, node: str = "node_id", edge_aggregations: Sequence[PathAggregation] = (), node_aggregations: Sequence[NodeAggregation] = (), mask: str | None = None, cutoff: float = INF) -> DataFrame:
    """``tiered_costs`` with the aggregations along each realised path; NaN where the cost is infinite."""
    if not edge_aggregations and not node_aggregations:
        raise ValueError("no aggregation given")
    names = [a.name for a in (*edge_aggregations, *node_aggregations)]
    if _straight(pairs, graph, nodes if node_aggregations else None, mask):
        found = search(pairs, graph, cutoff=cutoff, nodes=nodes, node=node, edge_aggregations=edge_aggregations, node_aggregations=node_aggregations, carry="tier")
        lost = pairs.filter("origin is null or dest is null").select("*", F.lit(INF).alias("cost"), *[F.lit(NAN).alias(n) for n in names])
        return found.select(*pairs.columns, "cost", *names).unionByName(lost)
    ask = pairs.filter(F.col(mask)) if mask else pairs
    found = routes(ask.select("origin", "dest").distinct(), graph, cutoff=cutoff, nodes=nodes, node=node, edge_aggregations=edge_aggregations, node_aggregations=node_aggregations)
    out = pairs.join(found, ["origin", "dest"], "left")
    on = F.coalesce(F.col(mask), F.lit(False)) if mask else F.lit(True)
    return out.select(*pairs.columns, F.when(on, F.coalesce("cost", F.lit(INF))).otherwise(INF).alias("cost"), *[F.when(on, F.coalesce(n, F.lit(NAN))).otherwise(NAN).alias(n) for n in names])


def steps_of(paths: DataFrame, ident: str, path: str = "path") -> DataFrame:
    """``(ident, seq, u, v)``: the edges of each path in order."""
    p = F.col(path)
    pairs = F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda v, i: F.struct(F.get(p, i).alias("u"), v.alias("v")))
    return paths.select(ident, F.posexplode(pairs).alias("seq", "e")).select(ident, "seq", "e.u", "e.v")


_SQL = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def _reducer(how: str | Callable[[np.ndarray], float]) -> Callable[[Column, Column], Column]:
    """An aggregate of a value in the order of ``seq``, undefined values skipped."""
    if isinstance(how, str):
        return lambda value, seq: _SQL[how](value)

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([float(how(np.asarray(v, float))) for v in values])

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(run, "double")
    return lambda value, seq: udf(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(seq.alias("seq"), value.alias("v"))))), lambda s: s["v"]))


def along_paths(paths: DataFrame, ident: str, graph: DataFrame, *, path: str = "path", nodes: DataFrame | None = None, node: str = "node_id", edge_aggregations: Sequence[PathAggregation] = (), node_aggregations: Sequence[NodeAggregation] = ()) -> DataFrame:
    """Cost and aggregations of given paths (``ident`` unique, ``path`` an array of nodes), as joins and one grouping.

    ``graph`` is collapsed (both directions of an undirected street are edges of it). A path over a missing edge, or an
    empty one, costs ``+inf`` with NaN aggregations; a path of one node costs 0.
    """
    shipped(paths.sparkSession)
    graph, edge_aggregations = _named(graph, edge_aggregations, "e")
    nodes, node_aggregations = _named(nodes, node_aggregations, "n")
    step = steps_of(paths, ident, path).join(graph.withColumn("there", F.lit(1)), ["u", "v"], "left")
    seq = F.col("seq")
    aggs = [F.sum("weight").alias("cost"), F.count_if(F.col("there").isNull()).alias("gaps"), *[_reducer(a.how)(known(F.col(a.attribute).cast("double")), seq).alias(a.name) for a in edge_aggregations]]
    per = step.groupBy(ident).agg(*aggs)
    out = paths.select(ident, F.size(path).alias("n")).join(per, ident, "left")
    if node_aggregations:
        at = nodes.select(F.col(node).alias("node"), *[F.col(a).cast("double").alias(a) for a in dict.fromkeys(a.attribute for a in node_aggregations)])
        stop = paths.select(ident, F.size(path).alias("size"), F.posexplode(path).alias("seq", "node")).join(at, "node", "left")
        inner = (F.col("seq") > 0) & (F.col("seq") < F.col("size") - 1)
        per = stop.groupBy(ident).agg(*[_reducer(a.how)(F.when(F.lit(a.include_endpoints) | inner, known(a.attribute)), seq).alias(a.name) for a in node_aggregations])
        out = out.join(per, ident, "left")
    bad = (F.col("n") < 1) | (F.coalesce("gaps", F.lit(0)) > 0)
    empty = lambda how: F.lit(float(how(np.empty(0)))) if callable(how) else F.lit(0.0 if how == "sum" else NAN)
    value = lambda a: F.when(bad, NAN).otherwise(F.coalesce(F.col(a.name), empty(a.how))).alias(a.name)
    return out.select(ident, F.when(bad, INF).otherwise(F.coalesce("cost", F.lit(0.0))).alias("cost"), *[value(a) for a in (*edge_aggregations, *node_aggregations)])


def trip_metrics(trips: DataFrame, graph: DataFrame, *, length: str = "length", features: dict[str, str] | None = None, cutoff: float = INF) -> DataFrame:
    """Per routable trip (``trip_id`` unique, ``origin``, ``dest``): ``cost``, ``distance`` and features along its path: ``sum`` of an
    edge column or its ``length_weighted`` mean. Undefined attribute values count as 0; unroutable trips do not come out."""
    features = dict(features or {})
    if {"trip_id", "cost", "distance"} & set(features):
        raise ValueError("a feature has a reserved name")
    zero = lambda c: F.coalesce(known(F.col(c).cast("double")), F.lit(0.0))
    g = graph.select("u", "v", "weight", zero(length).alias("length"), *[(zero(a) * (zero(length) if how == "length_weighted" else F.lit(1.0))).alias(a) for a, how in features.items()])
    found = routes(trips.select("origin", "dest").distinct(), g, cutoff=cutoff, edge_aggregations=[PathAggregation("distance", "length"), *[PathAggregation(a, a) for a in features]])
    out = trips.select("trip_id", "origin", "dest").join(found.filter(finite("cost")), ["origin", "dest"])
    named = [(F.when(F.col("distance") > 0, F.col(a) / F.col("distance")).otherwise(0.0) if how == "length_weighted" else F.col(a)).alias(a) for a, how in features.items()]
    return out.select("trip_id", "cost", "distance", *named)


def betweenness(sample: DataFrame, graph: DataFrame, *, cutoff: float = INF) -> DataFrame:
    """``(u, v, flow)``: how often the shortest paths of a sample ``(origin, dest[, times])`` use each edge, repeats counted."""
    times = F.sum("times") if "times" in sample.columns else F.count(F.lit(1))
    asked = sample.groupBy("origin", "dest").agg(times.cast("double").alias("times"))
    found = routes(asked.select("origin", "dest"), graph, cutoff=cutoff, paths=True).join(asked, ["origin", "dest"])
    step = found.select(F.monotonically_increasing_id().alias("id"), "path", "times")
    p = F.col("path")
    pairs = F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda v, i: F.struct(F.get(p, i).alias("u"), v.alias("v")))
    return step.select("times", F.inline(pairs)).groupBy("u", "v").agg(F.sum("times").alias("flow"))


def floor_within_zone(od: DataFrame, floors: float | DataFrame, *, by: Sequence[str] = (), tier: str = "cells_to_cells") -> DataFrame:
    """Costs of the cell tier raised to a floor, one for all or a table ``(origin, floor)``; origins without a floor, other
    tiers and costs that are not finite stay."""
    ok = (F.col("tier") == tier) & finite("cost")
    if isinstance(floors, (int, float)):
        return od.withColumn("cost", F.when(ok, F.greatest("cost", F.lit(float(floors)))).otherwise(F.col("cost")))
    out = od.join(floors.select("origin", F.col("floor").cast("double").alias("floor"), *by), ["origin", *by], "left")
    return out.withColumn("cost", F.when(ok & F.col("floor").isNotNull(), F.greatest("cost", "floor")).otherwise(F.col("cost"))).select(od.columns)
