"""Pivot names, registry, null classes, ties and weights."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortkit.config import default_config
from cohortkit.operators.aggregates import categorical_wide, numeric_wide
from cohortkit.operators.reshape import multi_hot_dense, numbered_pivot, numbered_rows
from cohortkit.operators.trajectories import build_trajectories
from cohortkit.plans.binning import map_concepts
from cohortkit.plans.concepts import collect_filter
from cohortkit.plans.metrics import poisson_draw
from cohortkit.plans.split import stratified_folds, stratified_split

LONG = "PID long, TIMESTAMP timestamp_ntz, FEATURE string, VALUE string"


def test_pivots_with_any_name(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, "A.B", "2"), (1, t, "c`d", "3")], LONG)
    out, names = numeric_wide(df, "x", ["mean", "count"])
    row = out.collect()[0].asDict()
    assert row["A.B_x_mean"] == 2.0 and row["c`d_x_count"] == 1.0 and set(names) == set(row) - {"PID"}
    df = spark.createDataFrame([(1, t, "f", "a b"), (1, t, "f", "a-b")], LONG)
    with pytest.raises(ValueError):
        categorical_wide(df, "x")
    out, given, _ = categorical_wide(df, "x", ["a b"])
    assert out.collect()[0][given[0]] == 1


def test_numbered_rows_of_a_large_group(spark):
    df = spark.range(500).select(F.lit("p").alias("k"), (F.col("id") * 7 % 500).alias("o"), "id")
    got = numbered_rows(df, ["k"], ["o"], "n").collect()
    assert all(r.n == r.o + 1 for r in got) and len(got) == 500
    wide = numbered_pivot(df.where("id < 30"), ["k"], ["o"], ["id"])
    assert len(wide.columns) == 31


def test_registry_entries_all_apply(spark):
    proc = spark.createDataFrame([("K1", dt.datetime(2024, 1, 1), 1)], "ProcedureCode string, ServiceDatetime timestamp_ntz, PID long")
    with pytest.raises(ValueError):
        collect_filter("Procedurer")
    got = proc.transform(collect_filter("Procedurer", procedure_map={"major": ["K1"]})).collect()
    assert [r.VALUE for r in got] == ["major"]


def test_raw_table_to_bins_in_one_call(spark):
    base = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 1))],
                                 "PID long, start timestamp_ntz, end timestamp_ntz")
    raw = spark.createDataFrame([(1, "K1", dt.datetime(2024, 1, 1, 0, 7))], "PID long, ProcedureCode string, ServiceDatetime timestamp_ntz")
    cfg = default_config(agg_func={"Procedurer": ["last", "count"]}, normaliser_settings={"Procedurer": {"procedure_map": {"m": ["K1"]}}})
    cfg["dataset"] = {**cfg["dataset"], "ts_cat_names": ["Procedurer"]}
    got = map_concepts({"Procedurer": raw}, base, cfg)[("Procedurer", "last")].where("FEATURE is not null").collect()
    assert [(r.FEATURE, r.VALUE) for r in got] == [("procedures", "m")]


def test_null_classes_raise(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "PID long, y int")
    for f in (stratified_split, stratified_folds):
        with pytest.raises(ValueError):
            f(df, "y")


def test_ties_have_one_order(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("p", t(1), t(2), "Indlæggelse", "A"), ("p", t(1), t(5), "Flyt Ind", "B"), ("p", t(5), t(6), "Flyt Ind", "C")]
    schema = "CPR_hash string, Flyt_ind timestamp_ntz, Flyt_ud timestamp_ntz, ADT_haendelse string, Afsnit string"
    seen = {tuple(sorted((r.start, r.end) for r in build_trajectories(
        spark.createDataFrame(order, schema).repartition(3), tie_cols=["Flyt_ud", "ADT_haendelse", "Afsnit"]).collect()))
        for order in (rows, rows[::-1])}
    assert len(seen) == 1


def test_poisson_weights_are_exact(spark):
    df = spark.createDataFrame([(0.0,), (0.36,), (0.37,), (0.99,), (0.9999999,), (1 - 2 ** -52,)], "u double")
    assert [r[0] for r in df.select(poisson_draw(F.col("u"))).collect()][:5] == [0, 0, 1, 4, 10]


def test_dense_matrix_of_absent_samples(spark):
    ones = spark.createDataFrame([(1, 0, 1)], "s long, idx int, timestep int")
    samples = spark.createDataFrame([(1,), (2,)], "s long")
    got = {r.s: r.multi_hot for r in multi_hot_dense(ones, "s", 2, 2, samples).collect()}
    assert got == {1: [[0.0, 1.0], [0.0, 0.0]], 2: [[0.0, 0.0], [0.0, 0.0]]}
