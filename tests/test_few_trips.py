"""Calibration where few trips, or none, can be used."""

import math

import __spark_entry__
import duckdb
import numpy as np
import pytest

from odolith.operators import calibrate

LEG = "trip_id long, orig_x double, orig_y double, dest_x double, dest_y double, time_measured double, dist_measured double, dist_line double"
#: Two trips of one length, then one of another, along a street; the last is nowhere near it.
LEGS = [(1, 0.0, 0.0, 400.0, 0.0, 50.0, 400.0, 400.0), (2, 100.0, 0.0, 500.0, 0.0, 58.0, 400.0, 400.0), (3, 0.0, 0.0, 800.0, 0.0, 95.0, 800.0, 800.0), (4, 9e6, 0.0, 9e6 + 400, 0.0, 50.0, 400.0, 400.0)]


def folder(spark, path, legs):
    nodes = [(i, 100.0 * i, 0.0, i % 2) for i in range(11)]
    edges = [(i, i, i + 1, 0, 1, 100.0, 36.0, "primary", str(1 + i % 3), False) for i in range(10)]
    spark.createDataFrame(nodes, "node_id long, x double, y double, is_traffic_signal int").write.parquet(f"{path}/nodes.parquet")
    spark.createDataFrame(edges, "edge_id long, u long, v long, k int, way_id long, length double, speed_kph double, highway string, lanes string, oneway boolean").write.parquet(f"{path}/edges.parquet")
    spark.createDataFrame(legs, LEG).coalesce(1).write.parquet(f"{path}/legs.parquet")
    return str(path)


def by_sql(path, name):
    con = duckdb.connect()
    for t in ("nodes", "edges", "legs"):
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    con.sql("create table od_pairs(run_id int, tier varchar, origin bigint, dest bigint, cost double, pop double, emp double, loaded_at timestamp)")
    con.sql("create table cells(cell_id varchar, zone_id varchar, node_id bigint, x double, y double, population double, employment_tertiary double, building_count int, geometry varchar)")
    con.sql("create table zones(zone_id varchar, node_id bigint, x double, y double, population double)")
    return con.sql(__spark_entry__.oracle_sql()[name]).fetchall()


@pytest.mark.parametrize("trips", [[4], [1, 4], [1, 2], [1, 3], [1, 2, 3]])
def test_fit_is_that_of_sql_on_few_trips(spark, tmp_path, trips):
    d = folder(spark, tmp_path, [x for x in LEGS if x[0] in trips])
    got = [tuple(r) for r in __spark_entry__.queries()["calib_fit"](spark, d).collect()]
    assert repr(got) == repr(by_sql(d, "calib_fit")) and got[0][3] == sum(t < 4 for t in trips)  # as text: NaN is not equal to itself


def test_undetermined_and_exact_least_squares(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (1.0, 3.0, 9.0)], "one double, a double, y double")
    exact = calibrate.least_squares(df, "y", ["one", "a"], strict=False)
    assert np.allclose(exact.coefficients, [3, 2]) and exact.r2 == pytest.approx(1) and np.isnan(exact.p_values).all()
    few = calibrate.least_squares(df.limit(1), "y", ["one", "a"], strict=False)
    assert np.isnan(few.coefficients).all() and math.isnan(few.r2) and few.n == 1
    with pytest.raises(ValueError):
        calibrate.least_squares(df, "y", ["one", "a"])


@pytest.mark.parametrize("trips", [[4], [1, 2, 3]])
def test_loop_without_enough_trips_has_no_coefficients(spark, tmp_path, trips):
    d = folder(spark, tmp_path, [x for x in LEGS if x[0] in trips])
    got = __spark_entry__.queries()["calib_loop"](spark, d).collect()
    assert sorted(r.name for r in got) == sorted(["const", "baseline_time", "lanes_known__mult", "segments", "lanes_at_orig", "lanes_at_dest", "snap_dist_orig", "snap_dist_dest"])
    assert {tuple(r)[1:] for r in got} == {(None, None, None, sum(t < 4 for t in trips))}
