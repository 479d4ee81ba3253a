import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from odolith.llm import packing
from odolith.llm.tokens import TOKENIZER, encoder, token_counts

KINDS = "container_kind string, capacity_tokens int, n_tokens int"


def replay(histogram, capacity):
    """Container contents from the placements, checking that every rank is placed once."""
    steps, used = packing.plan(histogram, capacity)
    content, seen = defaultdict(list), defaultdict(list)
    for s in steps:
        for rank in range(s.first, s.last):
            content[s.container + (rank - s.first) // s.each].append(s.size)
            seen[s.size].append(rank)
    assert {s: sorted(r) for s, r in seen.items()} == {s: list(range(n)) for s, n in histogram.items() if n}
    assert set(content) == set(range(used)) and all(sum(c) <= capacity for c in content.values())
    return content


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=20))
def test_plan_places_everything(histogram):
    content = replay(histogram, 40)
    assert all(sum(3 * s > 40 for s in c) <= 2 for c in content.values())


def test_plan_is_tight():
    assert len(replay({60: 10, 40: 10}, 100)) == 10 and len(replay({34: 7}, 100)) == 4 and len(replay({10: 95}, 100)) == 10
    r = random.Random(1)
    h = defaultdict(int)
    for _ in range(5_000):
        h[min(512, int(r.lognormvariate(4.5, 1)) + 1)] += 1
    n = len(replay(h, 512))
    assert n <= 1.01 * (sum(s * c for s, c in h.items()) / 512) + 1


def check(got, sizes, capacity):
    room, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        if r.container_id is None:
            assert not sizes[r.doc_id]
        else:
            room[r.container_id] += r.n_tokens
            pieces[r.doc_id].append((r.token_start, r.n_tokens))
    assert max(room.values(), default=0) <= capacity
    for d, n in sizes.items():
        if n:
            at = 0
            for start, length in sorted(pieces[d]):
                assert start == at
                at += length
            assert at == n and len(pieces[d]) == -(-n // capacity)


@pytest.mark.parametrize("per_task", [50_000, 3])
def test_pack(spark, monkeypatch, per_task):
    monkeypatch.setattr(packing, "RANKED_PER_TASK", per_task)
    r = random.Random(3)
    sizes = {i: r.choice([0, 5, 5, 5, 17, 60, 64, 100, 101, 999]) for i in range(300)}
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in sizes.items()], "doc_id long, n_tokens long, container_kind string, part int")
    kinds = spark.createDataFrame([("s", 64, 0), ("s", 64, 0), ("l", 500, 0), ("bad", 0, 0), (None, 5, 0)], KINDS)
    got = packing.pack(df, kinds).collect()
    assert {g.container_kind for g in got} == {"s", "l"}
    for kind, c in (("s", 64), ("l", 500)):
        check([g for g in got if g.container_kind == kind], sizes, c)
    again = packing.pack(df.repartition(5), kinds).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_empty_tables(spark):
    kinds = spark.createDataFrame([("s", 64, 0)], KINDS)
    docs = spark.createDataFrame([(1, None)], "doc_id long, n_tokens long")
    assert packing.pack(docs.filter("false"), kinds).count() == 0 and packing.pack(docs, kinds.filter("false")).count() == 0
    assert [r.container_id for r in packing.pack(docs, kinds).collect()] == [None]


def test_documents_and_report(spark):
    texts = ["", None, "a", "word " * 700, "<|endoftext|> stays text", "z" * 20_000, "é漢字🙂"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    with open(TOKENIZER, "rb") as file:
        enc = encoder(file.read())
    want = {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, "doc_id", "text").collect()} == want
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)
    got = packing.pack_documents(docs, spark.createDataFrame([("s", 64, 0)], KINDS))
    check(got.collect(), want, 64)
    r = packing.fill_report(got).first()
    assert r.tokens == sum(want.values()) and r.containers >= r.least_containers and 0.9 < r.fill <= 1


def test_more_kinds_than_a_thousand_and_a_capacity_beyond_all_items(spark):
    items = spark.createDataFrame([(1, 3), (2, 4)], "doc_id long, n_tokens long")
    kinds = spark.range(1_001).selectExpr("concat('k', id) as container_kind", "7 as capacity_tokens", "0 as n_tokens")
    kinds = kinds.unionByName(spark.createDataFrame([("huge", 2_000_000_000, 0)], KINDS))
    got = packing.pack(items, kinds)
    assert got.count() == 2 * 1_002 and got.filter("container_id = 0").count() == 2 * 1_002
