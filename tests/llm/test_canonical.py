import random

import pytest
from pyspark.sql import functions as F

from odolith.llm import canonical

TAGS = [("shop", "bakery", "bread shop"), ("shop", "greengrocer", "fruit and vegetables"), ("shop", "toys", "playthings"), ("shop", "car_repair", "garage workshop"), ("amenity", "atm", "cash machine"), ("amenity", "post_office", "mail counter"), ("amenity", "police", "police post"), ("amenity", None, None)]


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame(TAGS, "tag_key string, tag_value string, label string")


def mapped(spark, tags, entries, field="shop"):
    rows = spark.createDataFrame([(i, e, "x", "y") for i, e in enumerate(entries)], f"osm_id long, {field} string, canonical string, entry string")
    got = canonical.map_entries(canonical.unlisted(rows, "pois", "osm_id", field, tags), tags)
    out = {r.rec_key: r.canonical for r in got.collect()}
    return [out.get(i) for i in range(len(entries))]


def test_spellings(spark, tags):
    entries = ["Bakery", " bakery", "shop=bakery", "shop:BAKERY", "['bakery']", "bakrey", "báckéry", "bаkеry", "bakery​", "Bread-Shop", "shop, bread", "fruit and veg", "Fruit  And  Vegetables!", "greengr.", "garage_workshop (old)", "CarRepair", "tous", "playthings *"]
    assert mapped(spark, tags, entries) == ["bakery"] * 11 + ["greengrocer"] * 3 + ["car_repair"] * 2 + ["toys"] * 2


def test_not_to_be_mapped(spark, tags):
    long = "z" * 30_000
    assert mapped(spark, tags, ["bakery", None, "", "?", "n/a", "near Zapato 33", "frozen walnut", "31162-zz7", "Maloradevo", long, "police"]) == [None] * 5 + [""] * 6


def test_short_names_allow_one_edit(spark, tags):
    assert mapped(spark, tags, ["atb", "aym", "ATMS", "amt", "tam", "xyz", "policepost", "mail counter"], "amenity") == ["atm"] * 5 + ["", "police", "post_office"]


def test_repeats_and_empty_tables(spark, tags):
    assert mapped(spark, tags, ["Bakery"] * 50) == ["bakery"] * 50
    rows = spark.createDataFrame([], "osm_id long, shop string")
    assert canonical.map_entries(canonical.unlisted(rows, "pois", "osm_id", "shop", tags), tags).count() == 0
    rows = spark.createDataFrame([(1, "bakery")], "osm_id long, shop string")
    none = tags.filter("false")
    assert [r.canonical for r in canonical.map_entries(canonical.unlisted(rows, "pois", "osm_id", "shop", none), none).collect()] == [""]


@pytest.mark.parametrize(("threshold", "common"), [(0.2, 1), (0.2, 2), (0.5, 2), (0.8, 1), (0.8, 2), (1.0, None)])
def test_join_loses_no_pair(spark, threshold, common, monkeypatch):
    monkeypatch.setattr(canonical, "ROWS_PER_TOKEN", 10)
    r = random.Random(2)
    sets = [sorted(set(r.choices("abcdefghij", weights=range(1, 11), k=r.randint(1, 7)))) for _ in range(80)] + [[]]
    df = spark.createDataFrame([("p", str(i), s) for i, s in enumerate(sets)], "part string, id string, tokens array<string>")
    got = {(x.left_id, x.right_id): x.jaccard for x in canonical.similarity_join(df, df, threshold, common=common).collect()}
    assert canonical.similarity_join(df, df, threshold, common=common).count() == len(got)
    want = {}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= threshold - 1e-12:
                want[str(i), str(j)] = len(set(a) & set(b)) / len(set(a) | set(b))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_more_than_a_thousand_fields(spark):
    reference = spark.range(1_001).select(F.format_string("field%04d", "id").alias("tag_key"), F.lit("bakery").alias("tag_value"), F.lit(None).cast("string").alias("label"))
    values = reference.select(F.col("tag_key").alias("field"), F.concat("tag_key", F.lit("=bakrey")).alias("entry"))
    got = canonical.canonicalize(values, reference)
    assert got.filter("canonical = 'bakery'").count() == 1_001


def test_folding(spark):
    got = spark.createDataFrame([("  Ünïcode—ТЕST ",), (None,), ("highway = Primary (old)",), ("(old)",)], "v string").select(canonical.plain(F.col("v"), "highway")).collect()
    assert [r[0] for r in got] == ["unicode test", None, "primary", "old"]
