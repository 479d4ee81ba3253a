import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from odolith.llm import mixing

TARGETS = "source string, target_share double, max_repeats int, n_tokens int"


def by_quotients(weights, caps, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        can = [(-w / (2 * n + 1), i) for i, (w, n, c) in enumerate(zip(weights, got, caps)) if n < c and w > 0]
        if not can:
            break
        got[min(can)[1]] += 1
    return got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), min_size=1, max_size=6), st.integers(0, 80))
def test_apportionment_is_that_of_highest_quotients(parties, seats):
    w, c = [float(a) for a, _ in parties], [b for _, b in parties]
    assert mixing.apportion(w, c, seats) == by_quotients(w, c, seats)


def sizes(spark, n=600, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choices(["big", "Big ", "mid", "small", "other", None], [50, 5, 30, 4, 8, 3])[0], r.choice([0, 10, 50, 200]), 1, "x") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, repeats int, shard string"), rows


def test_shares_and_caps(spark):
    df, rows = sizes(spark)
    targets = spark.createDataFrame([("big", 0.3, 1, 0), ("mid", 0.5, 3, 0), ("small", 0.2, 2, 0), ("gone", 0.1, 5, 0), ("none", None, 2, 0)], TARGETS)
    got = mixing.mix(df, targets).collect()
    used = {}
    for r in got:
        used[r.source] = used.get(r.source, 0) + r.n_tokens * r.repeats
        assert 1 <= r.repeats <= {"big": 1, "mid": 3, "small": 2}[r.source] and r.n_tokens > 0
    have = sum(n for _, s, n, *_ in rows if s == "small")
    assert used["small"] == 2 * have  # at its cap
    rest = used["big"] + used["mid"]
    assert used["mid"] / rest == pytest.approx(0.5 / 0.8, abs=0.01)
    report = {r.source: r for r in mixing.mix_report(mixing.mix(df, targets), df, targets).collect()}
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1) and report["gone"].used_tokens == 0 and report["other"].target_share == 0
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(7), targets).collect()))
    assert sorted(map(repr, got)) != sorted(map(repr, mixing.mix(df, targets, seed=5).collect()))


def test_sharded_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_PER_SHARD", 40)
    df, _ = sizes(spark, 2000)
    targets = spark.createDataFrame([("big", 0.3, 1, 0), ("mid", 0.7, 4, 0)], TARGETS)
    report = {r.source: r.actual_share for r in mixing.mix_report(mixing.mix(df, targets, total=60_000), df, targets).collect()}
    assert report["big"] == pytest.approx(0.3, abs=0.02) and report["mid"] == pytest.approx(0.7, abs=0.02)


def test_ten_thousand_and_one_sources(spark):
    df = spark.range(20_002).selectExpr("id as doc_id", "concat('s', id % 10001) as source", "10L as n_tokens")
    targets = spark.range(10_001).selectExpr("concat('s', id) as source", "1.0 / 10001 as target_share", "1 as max_repeats", "0 as n_tokens")
    assert mixing.mix(df, targets).select("source").distinct().count() == 10_001


def test_largest_total_with_exact_shares(spark):
    df = spark.createDataFrame([(i, "a" if i < 10 else "b", 10) for i in range(110)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2, 0), ("b", 0.3, 1, 0), ("gone", 0.2, 1, 0)], TARGETS)
    report = mixing.mix_report(mixing.mix(df, targets), df, targets).collect()
    assert {r.exact_total for r in report} == {int(min(200 / 0.5, 1000 / 0.3) * 0.8)}


def test_empty_and_odd_inputs(spark):
    df, _ = sizes(spark, 20)
    targets = spark.createDataFrame([("big", 1.0, 1, 0), ("BIG", 0.5, 1, 0), ("", 0.5, 1, 0), (None, 0.5, 1, 0), ("mid", math.nan, 1, 0)], TARGETS)
    assert mixing.mix(df.filter("false"), targets).count() == 0 and mixing.mix(df, targets.filter("false")).count() == 0
    assert {r.source for r in mixing.mix(df, targets).collect()} <= {"big"}
    assert mixing.mix(df, targets, total=0).count() == 0


def test_documents(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 9), "ab"[i % 2], 3) for i in range(60)] + [(99, None, "a", 1)], "doc_id long, text string, source string, actual_share int")
    targets = spark.createDataFrame([("a", 0.5, 1, 0), ("b", 0.5, 1, 0)], TARGETS)
    got = mixing.mix_documents(docs, targets).collect()
    assert {round(r.actual_share, 1) for r in got} == {0.5} and {r.target_share for r in got} == {0.5}
