"""Joins J2-J7, J11, J12 (FIXTURES §4)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortkit.operators.reshape import flatten_numbered
from cohortkit.operators.joins import (anti_reappend, filter_by_time_window, left_join_unique, lookback_join,
                                       nearest_in_time, pair_start_end)
from cohortkit.plans.cohort import match_population_to_trajectories


def d(*a):
    return dt.datetime(*a)


def test_window_inclusive(spark):
    base = spark.createDataFrame([(1, "p", d(2024, 1, 2), d(2024, 1, 3))],
                                 "PID long, CPR_hash string, start timestamp_ntz, end timestamp_ntz")
    ev = spark.createDataFrame([("p", d(2024, 1, 1)), ("p", d(2023, 12, 31, 23, 59)), ("p", d(2024, 1, 4))],
                               "CPR_hash string, t timestamp_ntz")
    got = sorted(r.t for r in filter_by_time_window(base, ev, "t", offset_days=1).collect())
    assert got == [d(2024, 1, 1), d(2024, 1, 4)]


def test_lookback_month_end(spark):
    base = spark.createDataFrame([(1, "p", d(2024, 8, 31, 13), d(2024, 9, 2))],
                                 "PID long, CPR_hash string, start timestamp_ntz, end timestamp_ntz")
    ev = spark.createDataFrame([("p", d(2024, 2, 29, 13)), ("p", d(2024, 2, 29, 12, 59))], "CPR_hash string, t timestamp_ntz")
    assert [r.t for r in lookback_join(base, ev, "t").collect()] == [d(2024, 2, 29, 13)]


def test_nearest(spark):
    left = spark.createDataFrame([("p", d(2024, 1, 1)), ("q", d(2024, 1, 1))], "CPR_hash string, ServiceDate timestamp_ntz")
    right = spark.createDataFrame([("p", "c1", d(2023, 12, 31, 20)), ("p", "c2", d(2024, 1, 1, 8)), ("q", "c3", d(2024, 1, 3))],
                                  "CPR_hash string, Case_ID string, knife_time timestamp_ntz")
    got = {r.CPR_hash: r.knife_time for r in nearest_in_time(left, right, "CPR_hash", "ServiceDate", "knife_time",
                                                             ["CPR_hash", "ServiceDate"]).collect()}
    assert got == {"p": d(2023, 12, 31, 20), "q": None}


def test_match_and_reappend(spark):
    of = spark.createDataFrame([("p", d(2024, 1, 1), d(2024, 1, 5), "1")],
                               "CPR_hash string, start timestamp_ntz, end timestamp_ntz, trajectory string") \
        .withColumn("duration", F.col("end") - F.col("start"))
    pop = spark.createDataFrame([("p", "KJJA96", d(2024, 1, 2), d(2024, 1, 2, 9)), ("p", "KJJB00", d(2024, 1, 3), d(2024, 1, 3, 9))],
                                "CPR_hash string, ProcedureCode string, ServiceDate timestamp_ntz, ServiceDatetime timestamp_ntz")
    matched = match_population_to_trajectories(of, pop).drop("ProcedureCode_1", "ServiceDatetime_1")
    rows = flatten_numbered(matched, 2, "procedures").orderBy("ServiceDate").collect()  # wide at the sink, as wide as it says
    assert len(rows) == 2
    assert (rows[0].ServiceDate, rows[0].ProcedureCode_1, rows[0].ProcedureCode_2, rows[0].trajectory) == \
        (d(2024, 1, 2), "KJJA96", "KJJB00", "1")
    assert (rows[1].ServiceDate, rows[1].ProcedureCode_1, rows[1].trajectory) == (d(2024, 1, 3), "KJJB00", None)


def test_anti_reappend_null_safe(spark):
    pop = spark.createDataFrame([("p", None), ("q", d(2024, 1, 1))], "CPR_hash string, ServiceDate timestamp_ntz")
    matched = spark.createDataFrame([("p", None, "x")], "CPR_hash string, ServiceDate timestamp_ntz, extra string")
    out = anti_reappend(pop, matched, ["CPR_hash", "ServiceDate"])
    assert sorted(r.CPR_hash for r in out.collect()) == ["p", "q"]


def test_unique_guard(spark):
    left = spark.createDataFrame([(1,)], "PID long")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "PID long, x string")
    with pytest.raises(ValueError):
        left_join_unique(left, right, "PID")


def test_knife_pairing(spark):
    rows = [("p", "c", "Knivtid/procedure start", d(2024, 1, 1, 8), "Fuldført"),
            ("p", "c", "Sidste sutur/procedure slut", d(2024, 1, 1, 9, 30), None),
            ("p", "x", "Knivtid/procedure start", d(2024, 1, 1, 8), "Aflyst")]
    cases = spark.createDataFrame(rows, "CPR_hash string, Case_ID string, `Operationshændelse` string, "
                                        "`Operationshændelses_Tidspunkt` timestamp_ntz, Status string")
    out = pair_start_end(cases).collect()
    assert len(out) == 1 and out[0].elapsed_knife_time_minutes == 90.0
