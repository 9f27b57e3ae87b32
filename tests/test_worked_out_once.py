"""Costly columns are worked out once per row, not once per mention in a filter that was pushed down."""

import datetime as dt
import re

from pyspark.sql import functions as F

from cohortkit.config import default_config
from cohortkit.functions import codes
from cohortkit.operators.grid import assign_points
from cohortkit.operators.joins import guarded_left_join, window_join
from cohortkit.operators.trajectories import build_trajectories
from cohortkit.plans import driver_tables
from cohortkit.plans.comorbidity import CHARLSON, ELIXHAUSER, comorbidity_scores
from cohortkit.plans.concepts import filter_labs, filter_medicin
from cohortkit.plans.features import cutoff_runs
from cohortkit.session import worked_out_once

T = dt.datetime(2024, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _events(spark):
    rows = [(i, T + dt.timedelta(hours=i), 1, "view", 1.5 * i, '{"k": %d}' % i) for i in range(40)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def _filters(df, what):
    lines = [line for line in _plan(df).split("\n") if re.match(r"[\s:+|-]*(Filter|Join)\b", line)]
    return sum(line.count(what) for line in lines)


def test_rows_and_columns_stay(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "b", None)], "a int, `b.c` string, d string")
    out = worked_out_once(df, "b.c", "a")
    assert out.columns == df.columns and sorted(out.collect()) == sorted(df.collect())


def test_bins_are_not_worked_out_in_the_window_join(spark):
    base = spark.createDataFrame([(1, "p", T, T + dt.timedelta(days=2))], "PID long, CPR_hash string, start timestamp_ntz, end timestamp_ntz")
    ev = _events(spark).select(F.lit("p").alias("CPR_hash"), F.col("ts").alias("TIMESTAMP"), F.col("value").alias("VALUE"))
    j = window_join(ev, base, "CPR_hash", "TIMESTAMP", F.col("start"), F.col("end"), carry=["PID", "start", "end"])
    placed = assign_points(j, base, default_config()["bin_intervals"])
    assert "3600000000" in _plan(placed) and _filters(placed, "3600000000") == 0  # the factor of the hours of a time difference
    assert placed.count() == 40
    runs = cutoff_runs(j.withColumn("FEATURE", F.lit("f")), base, [60, 600, 1440], ["count"])
    assert _filters(runs, "3600000000") == 0
    assert [r["count"] for r in runs.orderBy("__s").collect()] == [2.0, 11.0, 25.0]


def test_lab_texts_are_not_worked_out_in_filters(spark):
    labs = filter_labs(driver_tables.labs_raw(_events(spark)).withColumn("PID", F.lit(1)))
    assert _filters(labs, "format_string") == 0 and _filters(labs, "regexp_replace") == 0
    got = labs.collect()
    assert got and all(r.VALUE is not None for r in got)


def test_lab_rows_that_stay(spark):
    rows = [("<0,5",), ("3.2*",), ("> 12",), ("neg",), (None,), ("1.2.3",), ("4 5",)]
    lab = spark.createDataFrame(rows, "`Resultatværdi` string").withColumn("BestOrd", F.lit(sorted(codes.LABS_REVERSE_MAP)[0])) \
        .withColumn("PID", F.lit(1)).withColumn("Prøvetagningstidspunkt", F.lit(T))
    assert sorted(r.VALUE for r in filter_labs(lab).collect()) == [0.5, 3.2, 12.0]


def test_medication_is_read_once(spark):
    med = driver_tables.medication(_events(spark))
    out = filter_medicin(med.unionByName(med))
    assert _plan(out).count("LogicalRDD") + _plan(out).count("LocalRelation") == 2  # the two sides of the union
    assert out.count() == out.distinct().count() > 0


def test_labels_of_a_trajectory(spark):
    rows = [("p", T + dt.timedelta(minutes=i), T + dt.timedelta(minutes=i + 1), "Indlæggelse" if i else "Flyt Ind", i) for i in range(12)]
    rows.append(("q", T, T, "Flyt Ind", 0))
    df = spark.createDataFrame(rows, "CPR_hash string, Flyt_ind timestamp_ntz, Flyt_ud timestamp_ntz, ADT_haendelse string, id int")
    out = build_trajectories(df, tie_cols=["id"])
    assert {r.CPR_hash: r.trajectory for r in out.collect()} == {"p": "1,10,11,2,3,4,5,6,7,8,9", "q": ""}
    assert "collect_set" not in _plan(out)


def test_scores_in_one_aggregate(spark):
    flags = spark.createDataFrame([(1, "ANY"), (1, "ELIX_chf"), (1, "CHAR_mld"), (1, "CHAR_msld"), (2, "ANY"), (3, "ELIX_chf"),
                                   (None, "ANY"), (None, "ELIX_chf")], "PID long, flag string")
    out = comorbidity_scores(flags)
    assert "Join" not in _plan(out)
    got = {r.PID: r for r in out.collect()}
    assert set(got) == {None, 1, 2} and (got[1].ELIX_chf, got[1].CHAR_mld, got[1].CHAR_msld) == (1, 0, 1)
    assert got[1].ASMT_ELIX == 7.0 and got[1].ASMT_CHARLSON == 4.0 and got[2].ASMT_ELIX == got[None].ASMT_ELIX == 0.0
    assert len(out.columns) == 1 + len(ELIXHAUSER) + len(CHARLSON) + 2


def test_wide_join_has_one_aggregate(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = left.where("k = 1").select("k", *[F.lit(i).alias(f"c{i}") for i in range(60)])
    out = guarded_left_join(left, right, "k")
    assert _plan(out).count("first(") == 1
    assert [(r.c0, r.c59) for r in out.orderBy("k").collect()] == [(0, 59), (None, None)]
    assert guarded_left_join(left, right.select("k"), "k").count() == 2
