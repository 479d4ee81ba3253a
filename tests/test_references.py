from datetime import datetime

from pyspark.sql import functions as F

from odolith.operators import references, skew

T = [datetime(2024, m, 1) for m in range(1, 13)]


def parents(spark, kind, rows):
    return spark.createDataFrame(rows, f"key {kind}, loaded_at timestamp, removed_at timestamp, kind string")


def refs(spark, kind, rows):
    return spark.createDataFrame(rows, f"rec string, ref {kind}, at timestamp, kind string, there int, n int")


def verdicts(df):
    return {(r.rec, r.ref): r.kind for r in df.collect()}


def find(r, p):
    return references.orphans(r, p, ref="ref", at="at", spread="rec", key="key")


def test_integer_keys(spark):
    p = parents(spark, "long", [(1, T[0], None, "x"), (2, T[0], T[3], "x"), (3, T[6], None, "x"), (3, T[6], None, "x"), (10, T[0], None, "x"), (None, T[0], None, "x"), (-5, T[0], None, "x"), (4095, T[0], None, "x"), (4096, T[0], None, "x"), (9, None, None, "x")])
    asked = [("a", 1, T[5]), ("b", 2, T[5]), ("c", 2, T[3]), ("d", 2, T[2]), ("e", 3, T[5]), ("f", 3, T[6]), ("g", 4, T[5]), ("h", 11, T[5]), ("i", None, T[5]), ("j", -5, T[5]), ("k", -4, T[5]), ("l", 4096, T[5]), ("m", 4097, T[5]), ("n", 2, None), ("o", 777, None), ("p", 9, T[0]), ("q", 2**40, T[0])]
    got = verdicts(find(refs(spark, "long", [(*a, "own", 7, 8) for a in asked]), p))
    assert got == {("b", 2): "deleted", ("c", 2): "deleted", ("e", 3): "late", ("g", 4): "missing", ("h", 11): "missing", ("k", -4): "missing", ("m", 4097): "missing", ("o", 777): "missing", ("q", 2**40): "missing"}


def test_text_keys_must_match_exactly(spark):
    p = parents(spark, "string", [("88aa", T[0], None, "x"), ("88ab", T[0], T[1], "x"), ("Zürich", T[0], None, "x"), ("0088", T[0], None, "x"), ("", T[0], None, "x")])
    asked = ["88aa", "88AA", "88aa ", "88ab", "Zürich", "Zurich", "88ac", "88", "0088", "088", "", None]
    got = verdicts(find(refs(spark, "string", [(str(i), a, T[5], "own", 1, 1) for i, a in enumerate(asked)]), p))
    assert {k[1]: v for k, v in got.items()} == {"88AA": "missing", "88aa ": "missing", "88ab": "deleted", "Zurich": "missing", "88ac": "missing", "88": "missing", "088": "missing"}


def test_empty_tables_and_columns_of_clashing_names(spark):
    p = parents(spark, "long", [(1, T[0], None, "x")])
    r = refs(spark, "long", [("a", 1, T[5], "own", 7, 8), ("b", 2, T[5], "own", 7, 8)])
    assert find(r.filter("false"), p).count() == 0
    out = find(r, p.filter("false"))
    assert out.count() == 2 and {x.there for x in out.collect()} == {7} and {x.kind for x in out.collect()} == {"missing"}


def test_runs_are_compressed(spark):
    p = spark.range(0, 5000).select((F.col("id") + F.when(F.col("id") >= 100, 7).otherwise(0)).alias("key"), F.lit(T[0]).alias("loaded_at"), F.lit(None).cast("timestamp").alias("removed_at"))
    runs = references.parent_runs(p.select("key"))
    assert sorted((r.start, r.end) for r in runs.collect()) == [(0, 99), (107, 5006)]
    text = spark.createDataFrame([(f"zone-{i:04d}",) for i in range(40)] + [(f"{i:04x}",) for i in range(16, 300)] + [("zone-0041",), ("no number",)], "key string")
    assert sorted((r.family, r.end - r.start + 1) for r in references.parent_runs(text).collect()) == [("d4:zone-", 1), ("d4:zone-", 40), ("h", 1), ("x4", 284)]


def test_more_hot_keys_than_any_list_could_hold(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SPLIT", 2)
    left = spark.range(12_000).select((F.col("id") % 3_000).alias("k"), F.col("id").alias("rec"))
    right = spark.range(0, 3_000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).cast("string").alias("v"))
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    hot = skew.hot_slots(counts, ["k"], "n")
    assert hot.count() > 2_900 and hot.filter("splits <> 2").isEmpty()
    got = skew.lookup(left, right, ["k"], ["rec"])
    want = left.join(right, "k", "left")
    assert got.count() == 12_000 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    monkeypatch.setattr(skew, "SLOTS", 64)  # keys that are not hot share slots with hot ones
    got = skew.lookup(left.filter("k < 100 or rec < 3000"), right, ["k"], ["rec"])
    assert got.exceptAll(want).isEmpty() and got.count() == 3_000 + 300


def test_hot_keys_are_split_without_loss(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("rec"))
    right = spark.createDataFrame([(1, "one"), (950, "x")], "k long, v string")
    got = skew.lookup(left, right, ["k"], ["rec"], rows=50)
    assert got.count() == 1000 and got.filter("v = 'one'").count() == 900 and got.filter("v is null").count() == 99


def test_references_against_brute_force(spark):
    import random

    r = random.Random(5)
    keys = sorted(r.sample(range(0, 20_000), 3_000))
    life = {k: (r.choice(T), r.choice([None, *T])) for k in keys}
    p = parents(spark, "long", [(k, a, b, "x") for k, (a, b) in life.items()])
    asked = [(str(i), r.randrange(-10, 20_010), r.choice(T), "", 0, 0) for i in range(2_000)]
    want = {}
    for rec, k, t, *_ in asked:
        kind = "missing" if k not in life else "deleted" if life[k][1] and life[k][1] <= t else "late" if life[k][0] > t else None
        if kind:
            want[rec, k] = kind
    assert verdicts(find(refs(spark, "long", asked), p)) == want
