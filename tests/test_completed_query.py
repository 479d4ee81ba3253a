"""The registered query over the imputation chain keeps the variation of what it fills."""

from odolith.plans.data_quality import p5_completed


def test_rare_classes_are_filled_in_too_and_the_same_each_time(spark, tmp_path):
    known = lambda i: "residential" if i % 10 else "primary"
    edges = [(i, 10_000 + i, None if i % 2 else known(i), "2", 50.0, False, 0) for i in range(1000)]
    spark.createDataFrame(edges, "edge_id long, way_id long, highway string, lanes string, speed_kph double, oneway boolean, k int").write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame([("highway", "residential"), ("highway", "primary")], "tag_key string, tag_value string").write.parquet(f"{tmp_path}/tag_values.parquet")
    first, again = ({r.edge_id: r.highway for r in p5_completed(spark, str(tmp_path)).filter("highway_by = 'chain'").collect()} for _ in range(2))
    assert len(first) == 500 and first == again
    assert 0.1 < sum(v == "primary" for v in first.values()) / 500 < 0.3
