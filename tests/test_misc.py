"""Remaining small operators: U1/U3, R3, P16, P17/K18, sinks S10/S11/S13,
J6 edge cases."""
import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from cohortkit.config import DEFAULT_CONFIG
from cohortkit.operators.filters import fill_window_from_date, missing_keys, union_by_name
from cohortkit.operators.grid import expand_intervals
from cohortkit.operators.reshape import feature_pivot
from cohortkit.plans.windowing import filter_subsets_preoperative
from cohortkit.sources import schemas
from cohortkit.sources.sinks import write_features, write_predictions, write_summary

T0 = dt.datetime(2024, 1, 1)


def test_union_and_missing(spark):
    a = spark.createDataFrame([(1, "x")], "PID long, a string")
    b = spark.createDataFrame([(2, 1.0), (1, 2.0)], "PID long, b double")
    u = union_by_name(a, b)
    assert set(u.columns) == {"PID", "a", "b"} and u.count() == 3
    assert union_by_name(a, a, distinct=True).count() == 1
    assert [r.PID for r in missing_keys(b, a, ["PID"]).collect()] == [2]


def test_feature_pivot_and_window_fill(spark):
    df = spark.createDataFrame([(1, "HEIGHT", 180.0), (1, "WEIGHT", 80.0), (2, "WEIGHT", 60.0)],
                               "PID long, FEATURE string, VALUE double")
    got = {r.PID: (r.HEIGHT, r.WEIGHT) for r in feature_pivot(df, "PID", ["HEIGHT", "WEIGHT"]).collect()}
    assert got == {1: (180.0, 80.0), 2: (None, 60.0)}
    w = spark.createDataFrame([(T0, None, None)], "ServiceDate timestamp_ntz, start timestamp_ntz, end timestamp_ntz")
    r = fill_window_from_date(w).first()
    assert r.start == r.end == T0


def test_preoperative_windowing(spark):
    root, out = tempfile.mkdtemp(prefix="ck-raw-"), tempfile.mkdtemp(prefix="ck-pre-")
    spark.createDataFrame([("p", "LAKTAT;P(AB)", "1", "2024-01-01 09:00:00"),
                           ("p", "LAKTAT;P(AB)", "2", "2024-01-01 11:00:00")], schemas.LABS) \
         .write.parquet(f"{root}/Labsvar.parquet")
    base = spark.createDataFrame([(1, "p", T0, T0 + dt.timedelta(days=2), T0 + dt.timedelta(hours=10), None)],
                                 "PID long, CPR_hash string, start timestamp_ntz, end timestamp_ntz, "
                                 "knife_time timestamp_ntz, ServiceDate timestamp_ntz")
    assert filter_subsets_preoperative(spark, base, root, out, names=["Labsvar"]) == ["Labsvar"]
    assert [r["Resultatværdi"] for r in spark.read.parquet(f"{out}/Labsvar.parquet").collect()] == ["1"]


def test_sinks(spark):
    d = tempfile.mkdtemp(prefix="ck-sink-")
    feats = spark.createDataFrame([(1, 0.5)], "PID long, f double")
    write_features(feats, os.path.join(d, "features"))
    write_features(feats, os.path.join(d, "features_csv"), fmt="csv")
    assert spark.read.parquet(os.path.join(d, "features")).count() == 1
    preds = spark.createDataFrame([(1, 1, 0.9, "24h", 1440.0, 24.0, 1.0)], schemas.PREDICTIONS)
    write_predictions(preds, os.path.join(d, "preds"))
    assert os.path.isdir(os.path.join(d, "preds", "masking_point=24h"))
    s = write_summary(spark, [{"model_name": "m", "cv_auroc": 0.7}], os.path.join(d, "summary"))
    assert s.count() == 1


def test_interval_before_grid_and_open_end(spark):
    base = spark.createDataFrame([(1, T0, T0 + dt.timedelta(minutes=20))], "PID long, start timestamp_ntz, end timestamp_ntz")
    ev = spark.createDataFrame([(1, T0 - dt.timedelta(hours=1), T0 + dt.timedelta(minutes=7), "ADT", "BED"),
                                (1, T0 + dt.timedelta(minutes=12), None, "ADT", "ICU"),
                                (1, T0 - dt.timedelta(hours=2), T0 - dt.timedelta(hours=1), "ADT", "OR")],
                               "PID long, TIMESTAMP timestamp_ntz, END_TIMESTAMP timestamp_ntz, FEATURE string, VALUE string")
    got = sorted((r.VALUE, r.TIMESTAMP) for r in expand_intervals(ev, base, DEFAULT_CONFIG["bin_intervals"]).collect())
    assert got == [("BED", T0), ("BED", T0 + dt.timedelta(minutes=5))]
