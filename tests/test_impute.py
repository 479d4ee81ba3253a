import random

from pyspark.sql import functions as F

from odolith.functions.tags import collapse_by_rank, first_whole, highway_rank, is_missing, lanes_per_direction, mean_numeric
from odolith.operators import impute


def fields():
    return [impute.Field("cls", F.when(~is_missing("cls"), F.col("cls")), F.col("cls").isin("a", "b", "c")), impute.Field("lanes", first_whole("lanes", 1, 12))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, way long, cls string, lanes string, n int, fill string")


def test_group_majority_ties_and_marks(spark):
    df = frame(spark, [(1, 1, "b", "2", 0, "z"), (2, 1, "a", "3", 0, "z"), (3, 1, None, "n/a", 0, "z"), (3, 1, None, "n/a", 0, "z"), (4, 2, "typo", "x", 0, "z"), (5, 2, "?", "0", 0, "z"), (6, None, "", "1.5", 0, "z"), (7, 3, "c", "13", 0, "z"), (8, 3, "c", " 04 ", 0, "z"), (9, 3, "unknown", "['7', '1']", 0, "z"), (10, 3, "-", "99", 0, "z"), (None, 3, None, None, 0, "z")])
    got = {r.id: r for r in impute.group_fill(df, "id", "way", fields()).collect()}
    assert (got[3].cls_fill, got[3].lanes_fill, got[3].cls_missing) == ("a", 2, True)
    assert got[4].cls_fill is None and not got[4].cls_missing and got[4].lanes_fill is None and got[4].lanes_missing
    assert got[5].cls_fill is None and got[6].cls_fill is None and got[6].lanes_missing
    assert (got[9].cls_fill, got[9].lanes_fill, got[10].lanes_fill, got[7].lanes_fill) == ("c", None, 4, 4)
    assert len(got) == 10


def test_empty_table(spark):
    df = frame(spark, []).filter("false")
    assert impute.group_fill(df, "id", "way", fields()).count() == 0
    assert impute.chained(df, "id", "way", fields(), {"n": F.col("n")}, rounds=1).count() == 0


def test_chain_recovers_what_other_fields_tell(spark):
    r = random.Random(2)
    rows, truth = [], {}
    for i in range(600):
        c = r.choice("abc")
        lanes = {"a": 1, "b": 3, "c": 6}[c]
        truth[i] = c
        rows.append((i, 10_000 + i, None if i % 5 == 0 else c, None if i % 7 == 3 else str(lanes), {"a": 30, "b": 50, "c": 100}[c], ""))
    got = {x.id: x for x in impute.chained(frame(spark, rows), "id", "way", fields(), {"n": F.col("n")}, rounds=2, draw=False).collect()}
    filled = [i for i in got if got[i].cls_filled]
    assert len(filled) == 120 and all(got[i].cls_by == "chain" for i in filled)
    assert sum(got[i].cls == truth[i] for i in filled) / len(filled) > 0.98
    assert all(got[i].cls == truth[i] for i in got if not got[i].cls_filled) and all(got[i].lanes is not None for i in got)


def test_draws_keep_variation_and_repeat(spark):
    rows = [(i, 10_000 + i, None if i % 2 else "a" if i % 10 else "b", "1", 0, "") for i in range(2000)]
    df = frame(spark, rows)
    peak = impute.chained(df, "id", "way", fields(), rounds=1, draw=False).filter("cls_filled").groupBy("cls").count().collect()
    assert {r.cls for r in peak} == {"a"}
    drawn = impute.chained(df, "id", "way", fields(), rounds=1, draw=True, seed=3).filter("cls_filled").select("id", "cls")
    share = drawn.filter("cls = 'b'").count() / drawn.count()
    assert 0.1 < share < 0.3
    assert drawn.exceptAll(impute.chained(df, "id", "way", fields(), rounds=1, draw=True, seed=3).filter("cls_filled").select("id", "cls")).isEmpty()


def test_regression_keeps_mean_and_spread(spark):
    r = random.Random(8)
    rows = []
    for i in range(3000):
        lanes = {"a": 2, "b": 6}[c := r.choice("ab")] + r.choice((-1, 0, 0, 1))
        rows.append((i, 10_000 + i, c, None if i % 3 == 0 else str(lanes), 0, ""))
    f = [fields()[0], impute.Field("lanes", first_whole("lanes", 1, 12), number=(1, 12))]
    got = impute.chained(frame(spark, rows), "id", "way", f, rounds=1)
    stats = {(x.cls, x.lanes_filled): (x.m, x.s, x.n) for x in got.groupBy("cls", "lanes_filled").agg(F.avg("lanes").alias("m"), F.stddev("lanes").alias("s"), F.count("*").alias("n")).collect()}
    for c in "ab":
        assert abs(stats[c, True][0] - stats[c, False][0]) < 0.15 and abs(stats[c, True][1] - stats[c, False][1]) < 0.12 and stats[c, True][2] > 400
    assert got.filter("lanes_filled and lanes_by = 'chain'").count() == 1000 and got.filter("lanes not between 1 and 12 or lanes is null").isEmpty()
    flat = impute.chained(frame(spark, rows), "id", "way", f, rounds=1, draw=False).filter("lanes_filled").groupBy("cls").agg(F.count_distinct("lanes").alias("k")).collect()
    assert all(x.k == 1 for x in flat)


def test_no_known_value_at_all(spark):
    f = [fields()[0], impute.Field("lanes", first_whole("lanes", 1, 12), number=(1, 12))]
    got = impute.chained(frame(spark, [(1, 1, None, None, 0, ""), (2, 1, "?", None, 0, "")]), "id", "way", f, rounds=1).collect()
    assert all(r.cls is None and not r.cls_filled and r.lanes is None for r in got)


def test_missing_forms_and_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (None, "", "  ", "?", "-", "--", "n/a", "N/A", "NULL", "nan", "none", "Not known", "​", "['']")], "v string")
    assert df.filter(~is_missing("v")).count() == 0
    df = spark.createDataFrame([(x,) for x in ("x", "cafe", "0", "é")], "v string")
    assert df.filter(is_missing("v")).count() == 0
    got = spark.createDataFrame([(x,) for x in ("2", "2.0", "02", "lanes=3", "2;3", "['5', '4']", "-1", "0", "99", "1.5", "x", None, "2-3", "12 lanes")], "v string").select(first_whole("v", 1, 12)).collect()
    assert [r[0] for r in got] == [2, 2, 2, 3, 2, 5, None, None, None, None, None, None, 2, 12]


def test_tag_functions(spark):
    df = spark.createDataFrame([(["residential", "primary", "primary_link"], ["3", "x", "5"], "4", False), ([], ["x"], None, None), (["odd"], [], "1", True)], "h array<string>, v array<string>, l string, o boolean")
    got = df.select(collapse_by_rank("h").alias("h"), mean_numeric("v").alias("v"), lanes_per_direction("l", "o").alias("l"), highway_rank(F.lit("odd")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("primary", "4.0", 2.0, -1), (None, "x", 1.0, -1), ("odd", None, 1.0, -1)]
