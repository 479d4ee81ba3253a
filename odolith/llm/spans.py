"""Long exact spans shared between texts: a sparse de Bruijn graph over code points.

Tokens are code points, since spans are measured in them. Of all k-mers (runs of K code points) each text keeps those
that are the least, by hash, of some window of neighbouring k-mers, so any stretch of MIN_SPAN code points keeps at
least one, the same one in every text that has the stretch. Kept k-mers of two or more texts are the nodes of the graph;
an edge leads from a node to the next kept k-mer of a text, a fixed number of code points on. Where every occurrence of
a node goes on to the same next node and every occurrence of that comes from it, the path does not branch and is
compacted. Texts are read a second time only where they have nodes, to verify spans at their source coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, plan_bytes, settled, shipped
from .tokens import texts

#: Length in code points from which a shared stretch counts.
MIN_SPAN = 300
#: The list of texts to read again is broadcast up to this size; beyond it, these texts are shuffled to it.
LIST_BYTES = BROADCAST_BYTES // 4
#: Texts of one class that one task pairs with as many others.
TEXTS_PER_PART = 2_000
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words without structure (the finalizer of splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE, _INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        p = np.full(max(n, 1 << 17), base, _U)
        p[0] = 1
        _powers[name] = np.cumprod(p)
    return _powers[name][:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` code points: differences of a running polynomial modulo 2^64, then mixed."""
    n = len(codes)
    with np.errstate(over="ignore"):
        terms = _mixed(codes.astype(_U) + _U(0x632BE59BD9B4E019)) * _power("up", _BASE, n)
        run = np.zeros(n + 1, _U)
        np.cumsum(terms, out=run[1:])
        return _mixed((run[k:] - run[:-k]) * _power("down", _INVERSE, n)[: n - k + 1])


def _sliding(a: np.ndarray, w: int, least) -> np.ndarray:
    """Least (or greatest) of every ``w`` neighbours, by doubling."""
    size, out = 1, a
    while 2 * size <= w:
        out = least(out[:-size], out[size:])
        size *= 2
    return least(out[: len(out) - (w - size)], out[w - size :]) if size < w else out


def kept(codes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-mers that are least in some window of ``w`` neighbours; all of equal ones."""
    h = kmer_hashes(codes, k)
    lows = _sliding(h, w, np.minimum)  # of windows
    pad = np.zeros(w - 1, _U)
    highest = _sliding(np.concatenate([pad, lows, pad]), w, np.maximum)  # of the lows of all windows around a position
    at = np.flatnonzero(h == highest)
    return at, h[at]


def occurrences(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """``(doc_id, seq, pos, kmer)`` of all kept k-mers: about ``4 / min_span`` a code point. One Arrow pass, no shuffle."""
    shipped(docs.sparkSession)
    k = min_span // 2
    w = min_span - k  # no gap between kept k-mers is longer than a k-mer, so they cover the text between them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seqs, at, hashes = [], [], [], []
            for ident, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                if ident is None or text is None or len(text) < min_span:
                    continue
                pos, h = kept(code_points(text), k, w)
                ids.append(np.full(len(pos), ident, np.int64))
                seqs.append(np.arange(len(pos), dtype=np.int32))
                at.append(pos.astype(np.int32))
                hashes.append(h.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, seqs, at, hashes)], names=["doc_id", "seq", "pos", "kmer"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, seq int, pos int, kmer bigint")


def nodes(occ: DataFrame) -> DataFrame:
    """Occurrences of the k-mers that two or more texts have, with ``n``, their number. ``occ`` is a written table."""
    stats = occ.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    return occ.join(stats.filter("lo < hi").select("kmer", "n"), "kmer")


def compacted(node: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """Nonbranching paths at their places: ``(doc_id, path, first, last)``, the positions of a path's first and last node.

    ``node`` is a written table. An edge is nonbranching if it has as many occurrences as the node before and the node
    after it. Occurrences of one path start with the same k-mer, ``path``, and go through all of it.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    step = node.select("doc_id", "seq", "pos", "kmer", "n", F.lead("seq").over(order).alias("seq2"), F.lead("pos").over(order).alias("pos2"), F.lead("kmer").over(order).alias("kmer2"), F.lead("n").over(order).alias("n2"))
    step = step.withColumn("gap", F.when(F.col("seq2") == F.col("seq") + 1, F.col("pos2") - F.col("pos")))
    # edges that could be compacted are counted; the rest branch anyway
    maybe = step.filter((F.col("gap") > 0) & (F.col("n") == F.col("n2")))
    edges = maybe.groupBy("kmer", "kmer2", "gap", "n").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") == F.col("n"))
    goes = edges.select("kmer2", F.lit(True).alias("goes_on")).distinct()
    joined = node.join(goes.withColumnRenamed("kmer2", "kmer"), "kmer", "left")  # a node that only ever continues a path
    order = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = joined.withColumn("run", F.count_if(F.col("goes_on").isNull()).over(order))
    return numbered.groupBy("doc_id", "run").agg(F.min_by("kmer", "seq").alias("path"), F.min("pos").alias("first"), F.max("pos").alias("last")).drop("run")


def _requests(paths: DataFrame) -> DataFrame:
    return paths.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("paths"))


def _grid(min_span: int) -> tuple[int, int, int]:
    """Length of a k-mer, step between the cores around a node, length of a core: every stretch of ``min_span`` that holds
    the node contains a core that starts a multiple of ``step`` before the node."""
    k = min_span // 2
    step = max(1, min_span // 12)
    return k, step, min_span - step


def cores(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """Source coordinates of all stretches that may be shared: ``(doc_id, start, length, content, left, right)``, a written table.

    A path of at least ``min_span`` code points is one row (``left`` and ``right`` null). Around the ends of every path there
    are cores, somewhat shorter than ``min_span``, with the code points just before and after them: a stretch of ``min_span``
    that holds the node is a core with some of these. ``content`` is a 128-bit digest of the text at the coordinates.
    """
    occ = settled(occurrences(docs, min_span))
    node = settled(nodes(occ))
    paths = settled(compacted(node, min_span))
    k, step, core = _grid(min_span)
    names = ["doc_id", "start", "length", "content", "left", "right"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        rows: list[tuple] = []
        for batch in batches:
            for ident, text, wanted in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-32-le", "surrogatepass")
                digest = lambda s, length, raw=raw: xxhash.xxh3_128_digest(raw[4 * s : 4 * (s + length)])
                places = set()
                for p in wanted:
                    first, last = p["first"], p["last"]
                    if last + k - first >= min_span:
                        rows.append((ident, first, last + k - first, digest(first, last + k - first), None, None))
                    for at in {first, last}:
                        places.update(s for s in range(at, at - (min_span - k) - 1, -step) if 0 <= s <= len(text) - core)
                rows.extend((ident, s, core, digest(s, core), text[max(0, s - step) : s], text[s + core : s + core + step]) for s in sorted(places))
                if len(rows) > 100_000:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    wanted = settled(_requests(paths))
    # only texts with nodes are read on; a shuffle of all texts is avoided where the list of them is measured to be short
    few = plan_bytes(wanted) <= LIST_BYTES
    source = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    met = source.join(F.broadcast(wanted) if few else wanted, "doc_id").select("doc_id", "text", "paths")
    return settled(met.mapInArrow(run, "doc_id bigint, start int, length int, content binary, left string, right string"))


def _classes(rows: DataFrame, key: list[str], *more) -> DataFrame:
    """Per key that two or more texts have, the digest ``class`` of the set of these texts."""
    one = rows.groupBy(*key, "doc_id").agg(*[f(c).alias(n) for n, f, c in more], F.count(F.lit(1)).alias("rows")) if more else rows.select(*key, "doc_id").distinct()
    over = {"min": F.min, "max": F.max}
    group = one.groupBy(*key).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("texts"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"), *[over[n[:3]](n).alias(n) for n, _, _ in more])
    return group.filter("lo < hi").withColumn("class", F.struct("lo", "hi", "texts", "x", "y")).drop("lo", "hi", "texts", "x", "y")


def shared(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """``(doc_id, start, end, class)``: stretches of at least ``min_span`` code points that all texts of a set have in common,
    a written table. Together they cover every stretch of ``min_span`` that any two texts share.

    A path, and a core whose occurrences all have the same code points before and after it, lies inside a shared stretch
    and is one row. Other cores are at an end of one: there each way to complete the core to ``min_span`` is looked up.
    ``doc_id`` must be unique; a null one, null texts and ones shorter than ``min_span`` have no rows; very long texts are
    processed whole; repetition inside one text is no sharing.
    """
    found = cores(docs, min_span)
    _, step, core = _grid(min_span)
    key = ["length", "content"]
    sides = [(f"{m}_{c}", {"min": F.min, "max": F.max}[m], F.xxhash64(c)) for m in ("min", "max") for c in ("left", "right")]
    full = [("min_full_left", F.min, F.length("left")), ("min_full_right", F.min, F.length("right"))]
    group = _classes(found, key, *sides, *full)
    same = (F.col("min_left") == F.col("max_left")) & (F.col("min_right") == F.col("max_right")) & (F.col("min_full_left") == step) & (F.col("min_full_right") == step)
    met = settled(found.join(group.withColumn("inner", F.coalesce(same, F.lit(False))).select(*key, "inner", "class"), key))
    path = F.col("left").isNull()
    inner = met.filter(path | F.col("inner")).select("doc_id", F.when(path, F.col("start")).otherwise(F.col("start") - step).alias("start"), F.when(path, F.col("start") + F.col("length")).otherwise(F.col("start") + core + step).alias("end"), "class")
    ways = met.filter(~path & ~F.col("inner")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(step))))
    fit = (F.col("s") <= F.length("left")) & (step - F.col("s") <= F.length("right"))
    before, after = F.expr("right(left, s)"), F.expr(f"left(right, {step} - s)")
    edge = ways.filter(fit).select("doc_id", (F.col("start") - F.col("s")).alias("start"), F.xxhash64("content", "s", before, after).alias("k1"), F.xxhash64(F.lit(1), after, before, "content").alias("k2"))
    edge = edge.join(_classes(edge, ["k1", "k2"]), ["k1", "k2"]).select("doc_id", "start", (F.col("start") + min_span).alias("end"), "class")
    return settled(inner.unionByName(edge))


def shared_pairs(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """Distinct ``(doc_id_a, doc_id_b)``, smaller first, of texts with a stretch of at least ``min_span`` code points in common.

    Stretches that the same set of texts shares are one class, and pairs are formed once per class, so a passage costs its
    pairs once, not once per position. All pairs of a class are true pairs: the work is that of the result. A class of many
    texts is cut into parts, and each pair of parts is a task's work of its own. ``classes`` gives the same links in a row
    per text.
    """
    member = settled(shared(docs, min_span).select("class", "doc_id").distinct())
    parts = F.ceil(F.col("class.texts") / TEXTS_PER_PART).cast("int")
    cut = member.select("class", "doc_id", parts.alias("parts"), F.pmod(F.xxhash64("doc_id", F.lit(3)), parts).cast("int").alias("part"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = cut.select("class", F.col("doc_id").alias("doc_id_a"), F.col("part").alias("pa"), every.alias("pb"))
    b = cut.select("class", F.col("doc_id").alias("doc_id_b"), every.alias("pa"), F.col("part").alias("pb"))
    return a.join(b, ["class", "pa", "pb"]).filter("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()


def classes(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """``(doc_id, class_id, links, spans, chars)``: per text and class its links, the number of other texts of the class, and how
    many stretches and code points of it (overlaps counted once a stretch) belong to the class.

    Two texts are linked exactly if they have a class in common, so no link is lost and no pair is written. ``class_id`` names the
    class by its least and greatest text, its number of texts and a digest of their ids.
    """
    hit = shared(docs, min_span).select("doc_id", "class", "start", "end").distinct()
    ident = F.concat_ws("-", "class.lo", "class.hi", "class.texts", F.lower(F.hex("class.x")))
    per = hit.groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("chars"))
    return per.select("doc_id", ident.alias("class_id"), (F.col("class.texts") - 1).alias("links"), "spans", F.col("chars").cast("long").alias("chars"))


def coverage(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """Per document how much of it is found elsewhere: ``(doc_id, n_chars, shared_chars, shared_share, spans, longest)``.

    Overlapping shared stretches are merged to ``spans``; ``longest`` is the longest merged one. Documents that share
    nothing, also null, empty and short ones, come out with zeros (``n_chars`` null with the text).
    """
    hit = shared(docs, min_span).select("doc_id", "start", "end").distinct()
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = hit.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = islands.groupBy("doc_id", "island").agg((F.max("end") - F.min("start")).cast("long").alias("chars"))
    sums = merged.groupBy("doc_id").agg(F.sum("chars").alias("shared_chars"), F.count(F.lit(1)).alias("spans"), F.max("chars").alias("longest"))
    out = docs.select("doc_id", F.length("text").cast("long").alias("n_chars")).join(sums, "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_chars", zero("shared_chars"), F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(0.0).alias("shared_share"), zero("spans"), zero("longest"))
