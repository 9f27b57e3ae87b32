"""Sources/sinks (S3, S6-S9, S12), windowing jobs (K17/K18), incremental
population filter (streaming) and the model pieces (M1, M4, M5, M10)."""
import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortkit.config import default_config
from cohortkit.operators.filters import align_frames, keyword_flags, parse_masking_point, split_xy
from cohortkit.plans.binning import map_concepts
from cohortkit.plans.models import MODEL_CONFIGS, evaluate_at, fit_preprocessor, run_cv_and_final_train
from cohortkit.plans.windowing import filter_subsets_inhospital
from cohortkit.sources import schemas
from cohortkit.sources.readers import (collect_subsets, get_concept, load_catalogue, sampled_fetch)
from cohortkit.streaming.incremental import population_filter_stream


def test_catalogue(spark):
    cat = load_catalogue(spark, configured=["Labsvar", "Medicin", "Notater"])
    assert cat.count() == 19
    with pytest.raises(AssertionError):
        load_catalogue(spark, configured=["NotATable"])


def test_sampled_fetch(spark):
    df = spark.range(100)
    assert sampled_fetch(df, 10, lambda d: d.where("id >= 0")).count() == 10


def test_subsets_and_windowing(spark):
    root = tempfile.mkdtemp(prefix="ck-raw-")
    out = tempfile.mkdtemp(prefix="ck-out-")
    labs = spark.createDataFrame([("p", "LAKTAT;P(AB)", "2,1", "2024-01-01 10:00:00"),
                                  ("p", "LAKTAT;P(AB)", "3", "2024-03-01 10:00:00"),
                                  ("z", "LAKTAT;P(AB)", "3", "2024-01-01 10:00:00")], schemas.LABS)
    labs.write.parquet(f"{root}/Labsvar.parquet")
    base = spark.createDataFrame([(1, "p", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))],
                                 "PID long, CPR_hash string, start timestamp_ntz, end timestamp_ntz")
    assert collect_subsets(spark, ["Labsvar", "Labsvar"], root, base, out) == ["Labsvar"]
    assert collect_subsets(spark, ["Labsvar"], root, base, out) == []  # skip if present
    assert spark.read.parquet(f"{out}/Labsvar.parquet").count() == 2
    win = tempfile.mkdtemp(prefix="ck-win-")
    assert filter_subsets_inhospital(spark, base, root, win, names=["Labsvar"]) == ["Labsvar"]
    assert spark.read.parquet(f"{win}/Labsvar.parquet").select("PID").collect()[0].PID == 1


def test_binned_store_roundtrip(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="ck-bin-"), "binned")
    base = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 1))],
                                 "PID long, start timestamp_ntz, end timestamp_ntz")
    lm = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 7), "HR", "80"), (1, dt.datetime(2024, 1, 1, 0, 8), "HR", "90")],
                               "PID long, TIMESTAMP timestamp_ntz, FEATURE string, VALUE string")
    cfg = default_config(agg_func={"Vitals": ["mean", "max"]})
    res = map_concepts({"Vitals": lm}, base, cfg, out_root=root)
    assert set(res) == {("Vitals", "mean"), ("Vitals", "max")}
    again = map_concepts({"Vitals": lm.limit(0)}, base, cfg, out_root=root)  # read back, not computed
    assert set(again) == set(res)
    assert [r.VALUE for r in again[("Vitals", "mean")].where("FEATURE is not null").collect()] == ["85.0"]
    stored = spark.read.parquet(root)
    got = get_concept(stored, "Vitals", ["mean", "max"])
    assert [r.VALUE for r in got["mean"].collect()] == [85.0]
    assert [r.VALUE for r in got["max"].collect()] == [90.0]


def test_stream_population_filter(spark):
    raw = tempfile.mkdtemp(prefix="ck-stream-")
    spark.createDataFrame([("p", "a"), ("q", "b")], "CPR_hash string, x string").write.mode("append").parquet(raw)
    ids = spark.createDataFrame([("p",)], "CPR_hash string")
    out, ck = tempfile.mkdtemp(prefix="ck-sout-"), tempfile.mkdtemp(prefix="ck-sck-")
    q = population_filter_stream(spark, raw, spark.read.parquet(raw).schema, ids, out, ck)
    q.awaitTermination()
    assert [r.x for r in spark.read.parquet(out).collect()] == ["a"]
    spark.createDataFrame([("p", "c")], "CPR_hash string, x string").write.mode("append").parquet(raw)
    population_filter_stream(spark, raw, spark.read.parquet(raw).schema, ids, out, ck).awaitTermination()
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == ["a", "c"]


def test_small_filters(spark):
    a = spark.createDataFrame([(1, 2.0)], "PID long, `10` double")
    b = spark.createDataFrame([(2, 3.0)], "PID long, `2` double")
    a2, b2 = align_frames(a, b)
    assert a2.columns == ["PID", "2", "10"] and b2.first()["10"] == 0.0
    x, y = split_xy(spark.createDataFrame([(1, 0.5, 1)], "PID long, f double, t int"), "t")
    assert x.columns == ["f"] and y.columns == ["t"]
    with pytest.raises(ValueError):
        parse_masking_point("soon")
    docs = spark.createDataFrame([("A License here", dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 1)), (None, None, None)],
                                 "text string, t timestamp_ntz, b timestamp_ntz")
    got = keyword_flags(docs, "text", ["license"], "kw", "t", "b", hours=4).collect()
    assert [(r.kw, r.kw_within) for r in got] == [(True, False), (False, False)]


def test_models_small(spark):
    rows = [(i, float(i % 10), "A" if i % 3 else "B", int(i % 10 > 6)) for i in range(200)]
    df = spark.createDataFrame(rows, "PID long, x double, c string, y int")
    pre = fit_preprocessor(df, ["c"], ["x"], scale=True)
    out = pre.transform(spark.createDataFrame([(999, None, "Z", 0)], "PID long, x double, c string, y int")).first()
    assert out["__ord_c"] == -1.0 and abs(out["__num_x"]) < 1e-9
    train, hold = df.where("PID % 3 != 0"), df.where("PID % 3 = 0")
    cfg = dict(MODEL_CONFIGS[2], n_iter=1)
    res = run_cv_and_final_train(train, hold, "y", "PID", ["c"], ["x"], cfg, n_folds=2, parallelism=1)
    assert res["holdout_auroc"] > 0.9
    m, preds = evaluate_at(res["pipeline"], hold, "y", "PID", "24h", 1440.0)
    assert m["masking_point"] == "24h" and preds.count() == hold.count()
    one_class = hold.withColumn("y", F.lit(0))
    assert evaluate_at(res["pipeline"], one_class, "y", "PID", "24h", 1440.0)[0] is None
