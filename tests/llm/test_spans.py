import random

import numpy as np
import pytest

from odolith.llm import spans

SPAN = 60


def truth(docs, span):
    where = {}
    for i, t in docs.items():
        for s in range(len(t or "") - span + 1):
            where.setdefault(t[s : s + span], set()).add(i)
    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    cover = {}
    for i, t in docs.items():
        mark = np.zeros(len(t or ""), bool)
        for s in range(len(t or "") - span + 1):
            if len(where[t[s : s + span]]) > 1:
                mark[s : s + span] = True
        cover[i] = int(mark.sum())
    return pairs, cover


def corpus(seed):
    r = random.Random(seed)
    text = lambda n, letters="abcdefgh é漢🙂\n": "".join(r.choices(letters, k=n))
    shared = [text(n) for n in (59, 60, 61, 75, 200, 400, 1000)]
    docs = {i: text(r.randint(0, 300)) for i in range(40)}
    for i in range(40, 120):
        parts = [text(r.randint(0, 120))]
        for _ in range(r.randint(1, 3)):
            s = r.choice(shared)
            cut = r.randint(0, max(0, len(s) - 55))
            parts += [s[cut : cut + r.choice([58, 60, 64, 130, 2000])], text(r.randint(0, 120))]
        docs[i] = "".join(parts)
    docs |= {200: "", 201: None, 202: "x" * 500, 203: "x" * 400, 204: "ab" * 300, 205: "ba" * 100, 206: docs[50], 207: docs[50], 208: "short", 209: ("q" + text(70)) * 5}
    docs[210] = text(3) + docs[209][71:200]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "c") for i, t in docs.items()], "doc_id long, text string, start int, content string")


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_coverage_against_brute_force(spark, seed):
    docs = corpus(seed)
    pairs, cover = truth(docs, SPAN)
    df = frame(spark, docs)
    assert {tuple(r) for r in spans.shared_pairs(df, SPAN).collect()} == pairs
    got = {r.doc_id: r for r in spans.coverage(df, SPAN).collect()}
    assert {i: r.shared_chars for i, r in got.items()} == cover
    assert got[201].n_chars is None and got[206].shared_share == 1 and got[206].spans == 1


def test_shuffled_list_of_texts_and_parts_of_classes(spark, monkeypatch):
    """The plans for long lists and large classes give the same result."""
    docs = corpus(3)
    pairs, cover = truth(docs, SPAN)
    monkeypatch.setattr(spans, "LIST_BYTES", -1)
    monkeypatch.setattr(spans, "TEXTS_PER_PART", 3)
    df = frame(spark, docs)
    got = spans.shared_pairs(df, SPAN)
    assert {tuple(r) for r in got.collect()} == pairs and got.count() == len(pairs)
    assert {r.doc_id: r.shared_chars for r in spans.coverage(df, SPAN).collect()} == cover


def test_classes_hold_every_link(spark):
    docs = corpus(1)
    pairs, _ = truth(docs, SPAN)
    rows = spans.classes(frame(spark, docs), SPAN).collect()
    member = {}
    for r in rows:
        member.setdefault(r.class_id, []).append(r.doc_id)
        assert r.links >= 1 and r.spans >= 1 and r.chars >= SPAN
    assert {(a, b) for m in member.values() for a in m for b in m if a < b} == pairs
    assert all(len(m) == len(set(m)) for m in member.values()) and all(r.links == len(member[r.class_id]) - 1 for r in rows)


def test_an_edit_between_two_nodes_of_a_path_is_seen(spark):
    """Texts that differ in one code point only: whatever lies between the kept k-mers, coverage is exact."""
    r = random.Random(11)
    base = "".join(r.choices("abcdefgh", k=700))
    docs = {i: base[:at] + "#" + base[at + 1 :] for i, at in enumerate(range(100, 600, 25))}
    pairs, cover = truth(docs, SPAN)
    assert {tuple(x) for x in spans.shared_pairs(frame(spark, docs), SPAN).collect()} == pairs
    assert {x.doc_id: x.shared_chars for x in spans.coverage(frame(spark, docs), SPAN).collect()} == cover


def test_empty_tables_and_null_ids(spark):
    df = frame(spark, {})
    assert spans.shared_pairs(df, SPAN).count() == 0 and spans.coverage(df, SPAN).count() == 0
    df = spark.createDataFrame([(None, "a" * 100), (1, "a" * 100)], "doc_id long, text string")
    assert spans.shared_pairs(df, SPAN).count() == 0


def test_very_long_texts(spark):
    r = random.Random(9)
    a, b = "".join(r.choices("abcd ", k=400_000)), "".join(r.choices("abcd ", k=300_000))
    docs = {1: a, 2: b[:150_000] + a[200_000:200_300] + b[150_000:], 3: b[:1000] + a[100:399]}
    assert {tuple(x) for x in spans.shared_pairs(frame(spark, docs)).collect()} == {(1, 2), (2, 3)}


def test_every_stretch_keeps_a_kmer():
    r = np.random.default_rng(1)
    codes = r.integers(0, 3, 5_000).astype(np.uint32)
    k, w = 30, 31
    at, h = spans.kept(codes, k, w)
    assert len(at) < 5_000 * 3 / w and max(np.diff(at)) <= w and at[0] < w and at[-1] >= len(codes) - k + 1 - w
    for s in range(0, 4_900, 97):  # the same stretch elsewhere keeps the same ones
        inner = spans.kept(codes[s : s + k + w - 1], k, w)[1]
        here = set(h[(at >= s) & (at < s + w)].tolist())
        assert set(inner.tolist()) <= here and len(inner)


def test_paths_are_compacted(spark):
    r = random.Random(4)
    common = "".join(r.choices("abcdefghij", k=3_000))
    docs = {i: "".join(r.choices("klmnop", k=200)) + common + "".join(r.choices("qrstuv", k=200)) for i in range(3)}
    occ = spans.occurrences(frame(spark, docs), SPAN)
    paths = spans.compacted(spans.nodes(occ), SPAN)
    # at the ends of the passage a text may keep a k-mer of its own choice, in between all keep the same
    long = paths.filter("last - first > 2500").collect()
    assert {p.doc_id for p in long} == {0, 1, 2} and len({p.path for p in long}) == 1 and paths.count() <= 9
