"""Metrics M2/M3, splits K23/M4, comorbidity K14."""
import datetime as dt

from pyspark.sql import functions as F

from cohortkit.plans.comorbidity import add_comorbidity, expand
from cohortkit.plans.metrics import auroc_ap, bootstrap_ap_ci
from cohortkit.plans.split import stratified_folds, stratified_split, temporal_split


def test_auroc_ap_fixture(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, p double")
    m = auroc_ap(df, "y", "p").first()
    assert abs(m.auroc - 0.75) < 1e-9 and abs(m.auroc_var - 0.0589286) < 1e-6
    assert abs(m.auroc_ci_low - 0.274215) < 1e-5 and m.auroc_ci_high == 1.0
    assert abs(m.ap - 0.833333) < 1e-5


def test_auroc_symmetry_and_ties(spark):
    rows = [(i % 2, float((i * 7) % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "y int, p double")
    a = auroc_ap(df, "y", "p").first().auroc
    b = auroc_ap(df.withColumn("p", 1 - F.col("p")), "y", "p").first().auroc
    assert abs(a + b - 1) < 1e-9
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    brute = sum((x > z) + 0.5 * (x == z) for x in pos for z in neg) / (len(pos) * len(neg))
    assert abs(a - brute) < 1e-9


def test_bootstrap_ci(spark):
    df = spark.createDataFrame([(i, i % 3 == 0, float(i % 7)) for i in range(60)], "id long, y boolean, p double") \
        .withColumn("y", F.col("y").cast("int"))
    lo, hi = bootstrap_ap_ci(df, "y", "p", n_bootstraps=50)
    ap = auroc_ap(df, "y", "p").first().ap
    assert 0 <= lo <= hi <= 1 and lo - 0.2 <= ap <= hi + 0.2


def test_temporal_split(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, 1),), (dt.datetime(2023, 1, 2),), (None,)], "ServiceDate timestamp_ntz")
    tr, ho = temporal_split(df, "2023-01-01")
    assert tr.count() == 1 and ho.count() == 1


def test_stratified_sizes_and_folds(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(103)], "PID long, y int")
    tr, ho = stratified_split(df, "y", "PID", 0.2, 1)
    counts = {r.y: r["count"] for r in ho.groupBy("y").count().collect()}
    assert counts == {0: 16, 1: 6} and tr.count() + ho.count() == 103
    f = stratified_folds(df, "y", "PID", 5, 42)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes[-1] - sizes[0] <= 2


def test_comorbidity(spark):
    assert expand("I425-I427 E10/E11x[01]") == ["I425", "I426", "I427", "E100", "E101", "E110", "E111"]
    start = dt.datetime(2024, 1, 10)
    base = spark.createDataFrame([(1, "p", start), (2, "q", start)], "PID long, CPR_hash string, start timestamp_ntz")
    diag = spark.createDataFrame([("p", "DI219", "2024-01-08 00:00:00", None), ("p", "DE1190", "2024-01-01 00:00:00", None),
                                  ("p", "DE119", "2024-01-01 00:00:00", None),
                                  ("q", "DC780", "2024-01-09 12:00:00", None)],
                                 "CPR_hash string, Diagnosekode string, Noteret_dato string, `Løst_dato` string")
    r = {x.PID: x for x in add_comorbidity(base, diag).collect()}
    assert r[1].CHAR_mi == 1 and r[1].CHAR_diab == 1 and r[1].ELIX_diabunc == 1
    assert r[1].ASMT_CHARLSON == 0.0
    assert r[2].ASMT_ELIX is None  # noted within a day of start: not pre-index


def test_models_are_trained_at_the_same_time(spark, monkeypatch):
    from threading import Barrier

    from cohortkit.plans import models

    together = Barrier(3, timeout=30)  # breaks if one model waits for the other to end

    def slow(train, holdout, target, id_col, categorical, continuous, config, **kw):
        together.wait()
        return {"model_name": config["name"], "n_train": train.count(), "pipeline": config["name"]}

    monkeypatch.setattr(models, "run_cv_and_final_train", slow)
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "PID long, y int")
    cfg = {"target": "y", "holdout_type": "random", "holdout_fraction": 0.2, "dataset": {"id_col": "PID"}}
    rows, pipes = models.train_models(df, cfg, [], [], configs=[{"name": n} for n in "abc"], return_pipelines=True)
    assert rows == [{"model_name": n, "n_train": 16} for n in "abc"] and pipes == {n: n for n in "abc"}
