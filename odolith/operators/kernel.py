"""Shortest paths from many origins at once, on arrays: the part of routing that runs inside a task.

Origins are searched in batches. One array holds the tentative cost of every (origin, node) of a batch, and each step
extends the paths of all origins by an edge in a few array operations. Steps go by a near and a far pile: entries whose
cost is within the current threshold are extended until none is left, then the threshold rises. An origin is through
once no entry is left that costs no more than its dearest destination asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Entries (origins of a batch times nodes) of the cost array: 8 bytes each, 24 where paths are traced.
ENTRIES = 1 << 22
#: Requests whose paths are traced at a time.
TRACED = 20_000
INF = float("inf")


@dataclass
class Network:
    """Arrays of a graph: nodes in sorted order, edges by start node, and the connected part each node is in."""

    ids: np.ndarray
    start: np.ndarray
    to: np.ndarray
    weight: np.ndarray
    edge_values: list[np.ndarray] = field(default_factory=list)
    node_values: list[np.ndarray] = field(default_factory=list)
    part: np.ndarray | None = None

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Positions of node ids, -1 for unknown ones."""
        if not len(self.ids) or not len(keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.ids, keys), len(self.ids) - 1)
        return np.where(self.ids[at] == keys, at, -1)


def network(u: np.ndarray, v: np.ndarray, weight: np.ndarray, values: list[np.ndarray], more: np.ndarray | None = None) -> Network:
    """Arrays from edge columns; ``more`` are further node ids."""
    ids = np.unique(np.concatenate([u, v, *([] if more is None else [more])])) if len(u) or (more is not None and len(more)) else np.empty(0, np.int64)
    a, b = np.searchsorted(ids, u), np.searchsorted(ids, v)
    order = np.lexsort((b, a))
    start = np.searchsorted(a[order], np.arange(len(ids) + 1))
    part = np.arange(len(ids), dtype=np.int32)
    while len(u):  # hooking and pointer jumping
        before = part.copy()
        np.minimum.at(part, b, part[a])
        np.minimum.at(part, a, part[b])
        part = part[part]
        if (before == part).all():
            break
    return Network(ids, start.astype(np.int64), b[order].astype(np.int32), weight.astype(float)[order], [x.astype(float)[order] for x in values], [], part)


class Search:
    """Searches batches of at most ``size`` origins; its arrays are made once and only the touched entries are reset."""

    def __init__(self, net: Network, cutoff: float = INF, traced: bool = False) -> None:
        self.net, self.cutoff, self.traced = net, cutoff, traced
        self.n = max(1, len(net.ids))
        self.size = int(max(1, min(512, ENTRIES // self.n)))
        self.cost = np.full(self.size * self.n, INF)
        self.mark = np.zeros(self.size * self.n, np.int32)
        if traced:
            self.prev = np.full(self.size * self.n, -1, np.int32)
            self.by = np.full(self.size * self.n, -1, np.int32)
        finite = net.weight[net.weight > 0]
        self.step = 2.0 * float(finite.mean()) if len(finite) else 1.0

    def _out(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges that leave the entries, and for each the place of its entry in ``keys``."""
        node = keys % self.n
        first, count = self.net.start[node], self.net.start[node + 1] - self.net.start[node]
        of = np.repeat(np.arange(len(keys)), count)
        ends = np.cumsum(count)
        edge = np.arange(len(of)) - np.repeat(ends - count, count) + np.repeat(first, count)
        return edge, of

    def _once(self, keys: np.ndarray) -> np.ndarray:
        """Each entry once."""
        place = np.arange(len(keys), dtype=np.int32)
        self.mark[keys] = place
        return keys[self.mark[keys] == place]

    def run(self, origins: np.ndarray, slot: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Costs of the requests ``(slot, node)``, sorted by slot; ``origins`` are the nodes of the slots 0, 1, ... Results of
        ``prev`` and ``by`` stay until ``reset``."""
        n, cost, weight, to = self.n, self.cost, self.net.weight, self.net.to
        asked = slot * n + node
        begins = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.empty(0, np.int64)
        bound = np.full(len(origins), -1.0)
        self.roots = np.arange(len(origins)) * n + origins
        near = self.roots[np.unique(slot)]
        cost[near] = 0.0
        self.touched = [near]
        far: list[np.ndarray] = []
        top = self.step

        def limits() -> None:
            if len(begins):
                bound[slot[begins]] = np.minimum(np.maximum.reduceat(cost[asked], begins), self.cutoff)

        limits()
        while True:
            while len(near):
                edge, of = self._out(near)
                new = cost[near][of] + weight[edge]
                row = (near // n)[of]
                target = row * n + to[edge]
                good = (new < cost[target]) & (new <= bound[row])
                target, new = target[good], new[good]
                np.minimum.at(cost, target, new)
                target = self._once(target)
                self.touched.append(target)
                is_near = cost[target] <= top
                near = target[is_near]
                far.append(target[~is_near])
            limits()
            wait = np.concatenate(far) if far else np.empty(0, np.int64)
            wait = wait[(cost[wait] > top) & (cost[wait] <= bound[wait // n])]
            if not len(wait):
                break
            wait = self._once(wait)
            top = max(top + self.step, float(cost[wait].min()))
            soon = cost[wait] <= top
            near, far = wait[soon], [wait[~soon]]
        found = cost[asked]
        found[found > bound[slot]] = INF
        if self.traced:
            self._trace(bound)
        return found

    def _trace(self, bound: np.ndarray) -> None:
        """The last step of every cheapest path with the fewest edges, from the smaller node of equals: breadth first over the
        edges that are on a cheapest path."""
        n, cost, prev, by = self.n, self.cost, self.prev, self.by
        level = self.roots[cost[self.roots] == 0.0]
        prev[level] = -2
        while len(level):
            edge, of = self._out(level)
            row, source = (level // n)[of], (level % n)[of]
            target = row * n + self.net.to[edge]
            good = (cost[level][of] + self.net.weight[edge] == cost[target]) & (cost[target] <= bound[row]) & (prev[target] == -1)
            target, source, edge = target[good], source[good].astype(np.int32), edge[good]
            prev[target] = np.iinfo(np.int32).max
            np.minimum.at(prev, target, source)
            wins = prev[target] == source
            by[target[wins]] = edge[wins]
            level = self._once(target)

    def reset(self) -> None:
        for keys in self.touched:
            self.cost[keys] = INF
            if self.traced:
                self.prev[keys] = -1
                self.by[keys] = -1

    def walk(self, slot: np.ndarray, node: np.ndarray):
        """Steps of the paths of reached requests, from the last node back: yields ``(request, node, edge)`` arrays, the edge
        being that into the node; the origin comes with edge -1."""
        request = np.arange(len(slot))
        while len(request):
            key = slot * self.n + node
            edge = self.by[key]
            yield request, node, edge
            on = edge >= 0
            request, slot, node = request[on], slot[on], self.prev[key][on].astype(np.int64)


def reduced(search: Search, slot: np.ndarray, node: np.ndarray, edge_aggs: list[tuple[int, str | Callable]], node_aggs: list[tuple[int, str | Callable, bool]], paths: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Aggregations of reached requests along their paths, and the node positions of each path in travel order if asked."""
    n = len(slot)
    what = [(search.net.edge_values[i], how, None) for i, how in edge_aggs] + [(search.net.node_values[i], how, ends) for i, how, ends in node_aggs]
    sums, counts = [np.zeros(n) for _ in what], [np.zeros(n, np.int64) for _ in what]
    for (_, how, _), s in zip(what, sums, strict=True):
        if how in ("min", "max"):
            s[:] = INF if how == "min" else -INF
    lists: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in what]
    stops: list[tuple[np.ndarray, np.ndarray]] = []
    last = True
    for request, at, edge in search.walk(slot, node):
        if paths:
            stops.append((request, at))
        inner = edge >= 0  # not the origin
        for j, (values, how, ends) in enumerate(what):
            if ends is None:
                use, v = request[inner], values[edge[inner]]
            elif ends:
                use, v = request, values[at]
            else:
                use, v = (request[:0], values[:0]) if last else (request[inner], values[at[inner]])
            ok = ~np.isnan(v)
            use, v = use[ok], v[ok]
            counts[j][use] += 1
            if how == "min":
                sums[j][use] = np.minimum(sums[j][use], v)
            elif how == "max":
                sums[j][use] = np.maximum(sums[j][use], v)
            elif isinstance(how, str):
                sums[j][use] += v
            else:
                lists[j].append((use, v))
        last = False
    out = []
    for j, (_, how, _) in enumerate(what):
        none = counts[j] == 0
        if how == "mean":
            out.append(np.where(none, np.nan, sums[j] / np.maximum(counts[j], 1)))
        elif isinstance(how, str):
            out.append(sums[j] if how == "sum" else np.where(none, np.nan, sums[j]))
        else:
            out.append(np.array([float(how(v)) for v in _split(lists[j], n)]))
    return out, _split(stops, n) if paths else []


def _split(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[np.ndarray]:
    """Values gathered from the end of each path backwards, by request in travel order."""
    if not parts:
        return [np.empty(0)] * n
    request = np.concatenate([r for r, _ in parts])
    values = np.concatenate([v for _, v in parts])
    step = np.repeat(np.arange(len(parts)), [len(r) for r, _ in parts])
    order = np.lexsort((-step, request))
    return np.split(values[order], np.searchsorted(request[order], np.arange(1, n)))
