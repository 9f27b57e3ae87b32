"""Ordered operators: W1, W2/K4, A7, W4, W5 and the bucketed scan."""
import datetime as dt
import random

from pyspark.sql import functions as F

from cohortkit.operators.ordered import dense_rank_global, ordered_scan, time_bucket
from cohortkit.operators.trajectories import (admission_counter, build_trajectories, collapse_admissions,
                                              fill_missing_end, overlap_with_next)

T0 = dt.datetime(2024, 1, 1)


def h(x):
    return T0 + dt.timedelta(hours=x)


def test_collapse_fixture(spark):
    stays = [(0, 2), (2.5, 5), (6, 7), (10, 20), (11, 12), (13.5, 14)]
    df = spark.createDataFrame([("p", h(a), h(b), None) for a, b in stays],
                               "CPR_hash string, start timestamp_ntz, end timestamp_ntz, trajectory long")
    for bucket in ("range", 86400, 3600, None):
        out = collapse_admissions(df, gap_hours=1, bucket_seconds=bucket).orderBy("start").collect()
        assert [(r.start, r.end) for r in out] == [(h(0), h(5)), (h(6), h(7)), (h(10), h(20)), (h(13.5), h(14))]


def test_labels_string_sorted(spark):
    df = spark.createDataFrame([("p", h(i), h(i + 0.5), t) for i, t in enumerate([1, 10, 2, 2, None])],
                               "CPR_hash string, start timestamp_ntz, end timestamp_ntz, trajectory long")
    out = collapse_admissions(df, gap_hours=1).collect()
    assert [r.trajectory for r in out] == ["1,10,2"]


def test_admission_counter_per_patient(spark):
    rows = [("a", "Flyt Ind", h(0)), ("a", "Indlæggelse", h(1)), ("a", "Flyt Ind", h(2)),
            ("a", "Indlæggelse", h(30)), ("b", "Flyt Ind", h(0.5))]
    df = spark.createDataFrame(rows, "CPR_hash string, ADT_haendelse string, Flyt_ind timestamp_ntz")
    got = {(r.CPR_hash, r.Flyt_ind): r.trajectory for r in admission_counter(df).collect()}
    assert got == {("a", h(0)): None, ("a", h(1)): 1, ("a", h(2)): 1, ("a", h(30)): 2, ("b", h(0.5)): None}


def test_build_trajectories_fused(spark):
    rows = [("a", "Indlæggelse", h(0), h(1)), ("a", "Flyt Ind", h(1.5), h(3)),
            ("a", "Indlæggelse", h(48), h(50)), ("a", "Flyt Ind", h(50), h(51))]
    df = spark.createDataFrame(rows, "CPR_hash string, ADT_haendelse string, Flyt_ind timestamp_ntz, Flyt_ud timestamp_ntz")
    out = build_trajectories(df).orderBy("start").collect()
    assert [(r.start, r.end, r.trajectory) for r in out] == [(h(0), h(3), "1"), (h(48), h(51), "2")]


def test_overlap_flag(spark):
    df = spark.createDataFrame([("p", h(1), h(4), h(1)), ("p", h(3), h(6), h(3)), ("p", h(6), h(8), h(6))],
                               "CPR_hash string, start timestamp_ntz, end timestamp_ntz, ServiceDate timestamp_ntz")
    out = overlap_with_next(df).orderBy("start").collect()
    assert [r.overlap for r in out] == [True, False, False]


def test_fill_missing_end(spark):
    df = spark.createDataFrame([(1, h(1), None, h(9)), (1, h(5), None, h(9))],
                               "PID long, Flyt_ind timestamp_ntz, Flyt_ud timestamp_ntz, end timestamp_ntz")
    out = fill_missing_end(df).orderBy("Flyt_ind").collect()
    assert [r.Flyt_ud for r in out] == [h(5), h(9)]


def test_bucketed_scan_equals_plain_window(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 3), T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 20)), i, rnd.randint(0, 5))
            for i in range(600)]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, i long, v long").withColumn("b", time_bucket("t", 3 * 3600))
    spec = dict(lag={"pv": "v"}, lead={"nv": "v"}, cumsum={"cv": "v"})
    a = {r.i: (r.pv, r.nv, r.cv) for r in ordered_scan(df, ["k"], ["t", "i"], "b", **spec).collect()}
    b = {r.i: (r.pv, r.nv, r.cv) for r in ordered_scan(df, ["k"], ["t", "i"], None, **spec).collect()}
    assert a == b


def test_dense_rank_global(spark):
    rows = [("b", 2), ("a", 1), ("b", 2), ("a", 3), ("c", 0)] * 3
    df = spark.createDataFrame(rows, "s string, d long")
    got = {(r.s, r.d): r.PID for r in dense_rank_global(df, ["s", "d"], n_buckets=3).collect()}
    assert got == {("a", 1): 1, ("a", 3): 2, ("b", 2): 3, ("c", 0): 4}
