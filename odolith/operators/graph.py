"""Preparing street networks: attributes between edges and nodes, junction flags, obstacles, consolidation of junctions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.tags import collapse_by_rank, highway_rank, lanes_per_direction, mean_numeric
from ..schema import DataError, finite, known, union_all
from ..session import release, settled
from .mapping import nearest
from .proximity import near_pairs

AGGREGATES: dict[str, Callable[[Column], Column]] = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum, "median": F.median}


def fill_attribute(edges: DataFrame, values: DataFrame, name: str, *, fill: float = 0.0, strict: bool = False, key: Sequence[str] = ("u", "v", "k")) -> DataFrame:
    """Edges with ``name`` from a table by edge key, ``fill`` where it has none; ``strict`` makes values for edges that do not
    exist a DataError."""
    if strict and not values.join(edges.select(*key), list(key), "left_anti").isEmpty():
        raise DataError(f"values of {name} for edges that do not exist")
    base = edges.drop(name) if name in edges.columns else edges
    return base.join(values.select(*key, name), list(key), "left").withColumn(name, F.coalesce(F.col(name), F.lit(fill)))


def edges_to_nodes(edges: DataFrame, attribute: str, how: str | Callable[[Column], Column] = "max") -> DataFrame:
    """``(node, value)`` of an edge attribute over all edges at a node, either end, undefined values skipped; nodes without a
    defined value are absent."""
    agg = AGGREGATES[how] if isinstance(how, str) else how
    v = known(F.col(attribute).cast("double"))
    ends = edges.select(F.explode(F.array_distinct(F.array("u", "v"))).alias("node"), v.alias("value")).filter("node is not null and value is not null")
    return ends.groupBy("node").agg(agg(F.col("value")).alias("value"))


def nodes_to_edges(edges: DataFrame, nodes: DataFrame, columns: Sequence[str], how: str = "sum", *, node: str = "node_id", relation: str | None = None) -> DataFrame:
    """Edges with node columns aggregated over their nodes: the two ends, or those named in the comma list ``relation``."""
    key = [c for c in ("u", "v", "k") if c in edges.columns]
    at = nodes.select(F.col(node).cast("string").alias("node"), *[known(F.col(c).cast("double")).alias(f"__{c}") for c in columns])
    of = F.split(F.col(relation), ",") if relation else F.array(F.col("u").cast("string"), F.col("v").cast("string"))
    long = edges.select(*key, F.explode(of).alias("node")).withColumn("node", F.trim("node"))
    per = long.join(at, "node").groupBy(*key).agg(*[AGGREGATES[how](f"__{c}").alias(c) for c in columns])
    return edges.join(per, key, "left")


def junctions(edges: DataFrame, highway: str = "highway", nodes: DataFrame | None = None, node: str = "node_id") -> DataFrame:
    """Per node its number of distinct neighbours (a node with a loop is one of its own), whether these are exactly three
    (``is_degree_3``) or more (``is_degree_4``), and the greatest and least rank of the streets that meet there (-1 for unranked,
    and for nodes without streets)."""
    r = highway_rank(highway)
    ends = F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other"))))
    long = edges.filter("u is not null and v is not null").select(r.alias("rank"), ends)
    # distinct (node, other) first, so the distinct count combines before its shuffle
    pairs = long.groupBy("node", "other").agg(F.max("rank").alias("hi"), F.min("rank").alias("lo"))
    per = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.max("hi").alias("max_highway_rank"), F.min("lo").alias("min_highway_rank"))
    if nodes is not None:
        per = nodes.select(F.col(node).alias("node")).distinct().join(per, "node", "left")
    degree = F.coalesce("degree", F.lit(0))
    return per.select("node", degree.alias("degree"), (degree == 3).cast("int").alias("is_degree_3"), (degree >= 4).cast("int").alias("is_degree_4"), F.coalesce("max_highway_rank", F.lit(-1)).alias("max_highway_rank"), F.coalesce("min_highway_rank", F.lit(-1)).alias("min_highway_rank"))


def obstacles(nodes: DataFrame, tags: dict[str, str], *, edges: DataFrame | None = None, roundabout: Column | None = None, node: str = "node_id") -> DataFrame:
    """``(kind, x, y)``: places of nodes whose tag equals, or as a list contains, a value, and middles of roundabout edges."""
    types = dict(nodes.dtypes)
    hit = lambda k, v: F.array_contains(k, v) if types[k].startswith("array") else F.col(k).cast("string") == v
    out = None
    for k, v in tags.items():
        one = nodes.filter(hit(k, v) & finite("x") & finite("y")).select(F.lit(f"{k}:{v}").alias("kind"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        out = one if out is None else out.unionByName(one)
    if edges is not None and roundabout is not None:
        at = nodes.select(F.col(node).alias("n"), "x", "y")
        a = at.select(F.col("n").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
        b = at.select(F.col("n").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
        mid = edges.filter(roundabout).join(a, "u").join(b, "v").select(F.lit("roundabout").alias("kind"), ((F.col("ux") + F.col("vx")) / 2).alias("x"), ((F.col("uy") + F.col("vy")) / 2).alias("y")).filter(finite("x") & finite("y"))
        out = mid if out is None else out.unionByName(mid)
    if out is None:
        raise ValueError("nothing is asked for")
    return out.distinct()


def elevation_change(edges: DataFrame, nodes: DataFrame, *, node: str = "node_id", elevation: str = "elevation") -> DataFrame:
    """Edges with ``elev_gain`` and ``elev_loss``, the climb and the descent from ``u`` to ``v``; null where an end's elevation is unknown."""
    at = nodes.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("n")).agg(F.max(F.when(finite(elevation), F.col(elevation).cast("double"))).alias("z"))
    out = edges.join(at.select(F.col("n").alias("u"), F.col("z").alias("__zu")), "u", "left").join(at.select(F.col("n").alias("v"), F.col("z").alias("__zv")), "v", "left")
    dz = F.col("__zv") - F.col("__zu")
    up = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    return out.select(*edges.columns, up(dz).alias("elev_gain"), up(-dz).alias("elev_loss"))


def flag_obstacles(nodes: DataFrame, places: DataFrame, buffer: float, name: str, *, node: str = "node_id") -> DataFrame:
    """Nodes with ``name`` 1 where an obstacle has its nearest node there within ``buffer``, else 0."""
    pts = nodes.filter(finite("x") & finite("y")).select(F.col(node).alias("id"), "x", "y").distinct()
    obs = places.select(F.xxhash64("x", "y").alias("id"), "x", "y").distinct()
    hit = nearest(obs, pts, max_distance=buffer).filter("right_id is not null").select(F.col("right_id").alias(node)).distinct()
    return nodes.join(hit.withColumn(name, F.lit(1)), node, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, component)``: connected components of undirected pairs ``(left_id, right_id)`` over ``nodes`` (``id``), named by their
    smallest id.

    Large-star and small-star rounds: each links a node's larger neighbours to its smallest neighbour, then its smaller ones,
    so paths halve and a hub never gathers its neighbours in one place beyond one aggregate. Every round is a written table.
    """
    both = lambda e: e.select(F.col("a"), F.col("b")).unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = settled(pairs.select(F.greatest("left_id", "right_id").alias("a"), F.least("left_id", "right_id").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        long = both(edges)
        low = long.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("m"))
        star = long.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        star = settled(star)
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        tied = star.join(low, "a")
        small = tied.select("a", F.col("m").alias("b")).unionByName(tied.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        small = settled(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
        # the same set of links: as many, with the same sums of their hashes
        now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        release(star)
        if now == before:
            release(small)
            break
        release(edges)
        edges, before = small, now
    root = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return nodes.select("id").distinct().join(root, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def consolidate(nodes: DataFrame, edges: DataFrame, tolerance: float, *, node: str = "node_id", node_max: Sequence[str] = (), edge_keep: Sequence[str] = (), node_aggregates: Mapping[str, str | Callable[[Column], Column]] | None = None, node_lists: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Junctions closer than twice the tolerance, directly or in a chain, merged into one.

    Merged nodes lie at the mean of their parts, carry the smallest id, the maximum of the ``node_max`` columns, the
    ``node_aggregates`` and the sorted distinct values of the ``node_lists``; edges are keyed to them, those within one are
    dropped, parallel ones numbered anew by length, and a missing ``length`` becomes the straight distance. Nodes without a
    place stand alone.
    """
    own = lambda c: F.max(F.when(finite(c), F.col(c).cast("double"))).alias(c)
    aggregates = {**dict.fromkeys(node_max, "max"), **(node_aggregates or {})}
    pts = settled(nodes.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(own("x"), own("y"), *[F.max(c).alias(c) for c in (*aggregates, *node_lists)]))
    placed = pts.filter("x is not null and y is not null")
    comp = settled(components(near_pairs(placed, 2 * tolerance), pts))
    how = lambda h: AGGREGATES[h] if isinstance(h, str) else h
    merged = pts.join(comp, "id").groupBy("component").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("parts"), *[how(h)(F.col(c)).alias(c) for c, h in aggregates.items()], *[F.sort_array(F.collect_set(c)).alias(c) for c in node_lists])
    merged = settled(merged.withColumnRenamed("component", node))
    a = comp.select(F.col("id").alias("u"), F.col("component").alias("cu"))
    b = comp.select(F.col("id").alias("v"), F.col("component").alias("cv"))
    pa_ = merged.select(F.col(node).alias("cu"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    pb = merged.select(F.col(node).alias("cv"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    keyed = edges.join(a, "u").join(b, "v").filter("cu <> cv").join(pa_, "cu").join(pb, "cv")
    straight = geo.distance(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy"))
    length = F.coalesce(F.when(finite("length"), F.col("length").cast("double")), straight)
    ident = ["edge_id"] if "edge_id" in edges.columns else []
    rows = keyed.select(F.col("cu").alias("u"), F.col("cv").alias("v"), *ident, length.alias("length"), *edge_keep).distinct()
    numbered = rows.groupBy("u", "v").agg(F.sort_array(F.collect_list(F.struct("length", *ident, *edge_keep))).alias("all"))  # parallel edges of one pair: a handful
    return merged, numbered.select("u", "v", F.posexplode("all").alias("k", "e")).select("u", "v", "k", "e.*")


def consolidated_network(
    nodes: DataFrame,
    edges: DataFrame,
    tolerance: float,
    *,
    buffer: float = 30.0,
    obstacle_tags: Mapping[str, tuple[str, str]] | None = None,
    places: DataFrame | None = None,
    roundabout: Column | None = None,
    node_aggregates: Mapping[str, str | Callable[[Column], Column]] | None = None,
    edge_aggregates: Mapping[str, Callable[[Column], Column]] | None = None,
    drop: Sequence[str] = ("name",),
    node: str = "node_id",
) -> tuple[DataFrame, DataFrame]:
    """``consolidate`` with everything a routable network needs, in one call.

    Obstacles are found before junctions merge: ``obstacle_tags`` names a flag per node tag and value, or ``places`` gives them as
    ``(kind, x, y)``; ``roundabout`` is a predicate on edges. Each is put back on the nearest merged node within ``buffer``: nodes
    get ``is_<name>`` and, with ``roundabout``, ``is_roundabout``. They also get the junction flags and ranks. Edges lose the ``drop``
    columns; list columns named in ``edge_aggregates`` become one value, a list of street classes that of highest rank;
    ``lanes_per_direction`` is added where there are ``lanes``. Node columns without an aggregate become lists.
    """
    tags = {"traffic_signal": ("highway", "traffic_signals")} if obstacle_tags is None else dict(obstacle_tags)
    tags = {n: kv for n, kv in tags.items() if kv[0] in nodes.columns}
    spots = []
    if places is not None:
        kinds = sorted(r[0] for r in places.select("kind").distinct().collect())  # one column of the result each
        spots.append(places.select("kind", "x", "y"))
    else:
        kinds = list(tags)
        for name, (k, v) in tags.items():
            spots.append(obstacles(nodes, {k: v}, node=node).withColumn("kind", F.lit(name)))
    if roundabout is not None:
        kinds.append("roundabout")
        spots.append(obstacles(nodes, {}, edges=edges, roundabout=roundabout, node=node))
    keep = [c for c in edges.columns if c not in ("u", "v", "k", "edge_id", "length", *drop)]
    aggregates = {c: h for c, h in (node_aggregates or {}).items() if c in nodes.columns}
    lists = [c for c in nodes.columns if c not in (node, "x", "y", *aggregates, *[f"is_{n}" for n in kinds])]
    merged, links = consolidate(nodes, edges, tolerance, node=node, edge_keep=keep, node_aggregates=aggregates, node_lists=lists)
    reduce_by = {"lanes": mean_numeric, "maxspeed": mean_numeric} if edge_aggregates is None else dict(edge_aggregates)
    types = dict(links.dtypes)
    for c, h in reduce_by.items():
        if types.get(c, "").startswith("array"):
            links = links.withColumn(c, h(F.col(c)))
    if types.get("highway", "").startswith("array"):
        links = links.withColumn("highway", collapse_by_rank("highway"))
    if "lanes" in types:
        links = links.withColumn("lanes_per_direction", lanes_per_direction("lanes", "oneway" if "oneway" in types else F.lit(False)))
    links = settled(links)
    if "highway" in types:
        merged = merged.join(junctions(links, nodes=merged, node=node).withColumnRenamed("node", node), node, "left")
    if spots:
        found = union_all(*[s.select("kind", "x", "y") for s in spots]).filter(finite("x") & finite("y")).distinct().withColumn("id", F.xxhash64("kind", "x", "y"))
        found = settled(found)
        there = merged.filter("x is not null and y is not null").select(F.col(node).alias("id"), "x", "y")
        hit = nearest(found, there, max_distance=buffer).filter("right_id is not null").join(found.select(F.col("id").alias("left_id"), "kind"), "left_id")
        flags = hit.groupBy(F.col("right_id").alias(node)).agg(*[F.max((F.col("kind") == n).cast("int")).alias(f"is_{n}") for n in kinds])
        merged = merged.join(flags, node, "left").na.fill(0, [f"is_{n}" for n in kinds])
    return merged, links
