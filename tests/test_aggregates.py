"""Aggregations A1, A3, A5, A8, multi-hot R7-R9."""
import datetime as dt

from pyspark.sql import functions as F

from cohortkit.operators.aggregates import bin_aggregate, categorical_wide, first_non_null_per_column, numeric_wide
from cohortkit.operators.reshape import category_labels, multi_hot_dense, multi_hot_transform, multi_hot_vocabulary

T = dt.datetime(2024, 1, 1)


def test_numeric_wide(spark):
    df = spark.createDataFrame([(1, T, "HR", "5"), (1, T + dt.timedelta(hours=1), "HR", "7"), (2, T, "HR", "3"),
                                (2, T, "HR", "x")], "PID long, TIMESTAMP timestamp_ntz, FEATURE string, VALUE string")
    wide, names = numeric_wide(df, "V")
    r = {x.PID: x for x in wide.collect()}
    assert (r[1].HR_V_first, r[1].HR_V_last, r[1].HR_V_min, r[1].HR_V_max, r[1].HR_V_mean) == (5, 7, 5, 7, 6)
    assert abs(r[1].HR_V_std - 1.414214) < 1e-6 and r[2].HR_V_std == 0.0 and r[2].HR_V_count == 1.0
    assert r[1].HR_V_median == 6.0


def test_categorical_wide(spark):
    df = spark.createDataFrame([(1, "a/b"), (1, "a/b"), (1, "c d")], "PID long, VALUE string")
    wide, given, count = categorical_wide(df, "M")
    r = wide.first()
    assert (r.a_b_M_count, r.a_b_M_given, r.c_d_M_count, r.c_d_M_given) == (2, 1, 1, 1)


def test_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([(1, 1, "f", "b", T), (1, 1, "f", "a", T), (1, 1, "f", "b", T), (1, 1, "f", "a", T)],
                               "PID long, bin_counter long, FEATURE string, VALUE string, TIMESTAMP timestamp_ntz")
    assert bin_aggregate(df, "mode", is_categorical=True).first().VALUE == "a"


def test_first_non_null(spark):
    df = spark.createDataFrame([(1, 1, None, "x"), (1, 2, "b", None), (1, 3, "c", "z")], "k long, o long, a string, b string")
    r = first_non_null_per_column(df, ["k"], ["o"], ["a", "b"]).first()
    assert (r.a, r.b) == ("b", "x")


def test_multi_hot(spark):
    df = spark.createDataFrame([(1, "f", ["a"], ["a", "b"], None), (2, "f", ["c", "a"], None, ["c"])],
                               "s long, FEATURE string, t0 array<string>, t1 array<string>, t2 array<string>")
    voc = multi_hot_vocabulary(df, ["t0", "t1", "t2"])
    assert sorted((r.value, r.idx) for r in voc.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    ones = multi_hot_transform(df, voc, "s", ["t0", "t1", "t2"])
    got = sorted((r.s, r.idx, r.timestep) for r in ones.collect())
    assert got == [(1, 0, 0), (1, 0, 1), (1, 1, 1), (2, 0, 0), (2, 2, 0), (2, 2, 2)]
    dense = {r.s: r.multi_hot for r in multi_hot_dense(ones, "s", 3, 3).collect()}
    assert dense[1] == [[1.0, 1.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0]]
    assert category_labels(voc).first().labels == ["a", "b", "c"]
