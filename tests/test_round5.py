"""The whole interval of every cutoff and the whole search of every model."""
import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortkit.plans import catalog_cohort, catalog_jobs
from cohortkit.plans.evaluation import metrics_by_cutoff, predictions, store_predictions
from cohortkit.plans.metrics import _poisson_cdf, bootstrap_ap
from cohortkit.plans.models import MODEL_CONFIGS, run_cv_and_final_train, sample_grid


def _drawn(n, name):
    """Poisson(n) for n below 256 from the hashes of a name, one threshold after another."""
    out = 0
    for j in range(8):
        if n >> j & 1:
            u = int(md5(f"{name}|{j}".encode()).hexdigest()[:13], 16) / 2 ** 52
            out += sum(c <= u for c in _poisson_cdf(1 << j))
    return out


def _aps(counts, prefix, resamples, seed=42):
    out = {}
    for b in range(resamples):
        tp = k = ap = 0
        for score, (pos, neg) in sorted(counts.items(), key=lambda x: -float("inf") if x[0] is None else -x[0]):
            p, q = (_drawn(n, f"{prefix}{'' if score is None else f'{score}|'}{b}|{seed}|{y}") for n, y in ((pos, 1), (neg, 0)))
            tp, k = tp + p, k + p + q
            ap += p * tp / k if p and score is not None else 0.0
        if 0 < tp < k:
            out[b] = ap / tp
    return out


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_resamples_are_those_of_the_hashes(spark, batch):
    counts = {"a": {0.0: (3, 40), 0.5: (1, 7), 2.0: (0, 2), 3.25: (9, 1)}, "b": {1.0: (2, 1)}, None: {1.0: (1, 1), -1.0: (2, 5)}}
    rows = [(g, s, y) for g, c in counts.items() for s, n in c.items() for y, m in zip((1, 0), n) for _ in range(m)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # groups go on over batches
    try:
        got = {(r.g, r.b): r.ap for r in bootstrap_ap(df, "y", "p", 70, keys=["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = {(g, b): ap for g, c in counts.items() for b, ap in _aps(c, f"{g}|" if g else "", 70).items()}
    assert got == pytest.approx(want) and len(want) > 150


def test_scores_and_labels_that_are_missing(spark):
    counts = {None: (2, 3), 1.0: (1, 4), 0.0: (5, 2)}
    rows = [(s, y) for s, n in counts.items() for y, m in zip((1, 0), n) for _ in range(m)] + [(7.0, None), (None, None)]
    got = {r.b: r.ap for r in bootstrap_ap(spark.createDataFrame(rows, "p double, y int"), "y", "p", 90).collect()}
    assert got == pytest.approx(_aps(counts, "", 90)) and len(got) > 80
    none = spark.createDataFrame([(None, 1), (None, 0)] * 9, "p double, y int")
    assert {r.ap for r in bootstrap_ap(none, "y", "p", 20).collect()} == {None}
    assert bootstrap_ap(none.where("y is null"), "y", "p", 20).count() == 0
    nan = spark.createDataFrame([(float("nan"), 1), (1.0, 0)] * 9, "p double, y int")  # the last of all
    assert abs(np.mean([r.ap for r in bootstrap_ap(nan, "y", "p", 200).collect()]) - 0.5) < 0.05


def test_large_counts_keep_mean_and_spread(spark):
    df = spark.createDataFrame([(1.0, 1, 400), (2.0, 0, 900)], "p double, y int, n int").select("p", "y", F.explode(F.sequence(F.lit(1), "n")))
    aps = np.array([r.ap for r in bootstrap_ap(df, "y", "p", 1000).collect()])  # positives / all of them, the positives last
    assert len(aps) == 1000 and abs(aps.mean() - 4 / 13) < 0.002 and 0.011 < aps.std() < 0.015


def test_every_cutoff_has_the_whole_interval(spark, tmp_path):
    rows = [(c, p, p % 2, float((p * 7 + c) % 5)) for c in (60, 1440) for p in range(40)]
    df = spark.createDataFrame(rows, "masking_point int, PID long, y int, s double")
    stored = store_predictions(predictions(df, "y", score="s"), str(tmp_path / "p"))
    assert [r.n_resamples for r in metrics_by_cutoff(stored).collect()] == [1000, 1000]
    assert "n_resamples" not in metrics_by_cutoff(stored, n_bootstraps=0).columns


def test_m10_draws_as_many_resamples_as_the_interval_alone(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(catalog_cohort, "metrics_by_cutoff",
                        lambda stored, n_bootstraps=1000: asked.append(n_bootstraps) or metrics_by_cutoff(stored, n_bootstraps))
    got = catalog_cohort.m10_metrics_all_cutoffs(spark, "/root/testdata/sf0.001")
    assert asked == [1000] == [catalog_cohort.RESAMPLES] and got.count() == 99
    assert "range(0, 1000)" in entry.oracle_sql()["m10_metrics_all_cutoffs"]


def test_m9_asks_for_the_whole_search(spark, monkeypatch):
    class Asked(Exception):
        pass

    def train_models(data, cfg, cat, cont, configs, n_folds, **kw):
        raise Asked({c["name"]: len(sample_grid(c["estimator"](), c["grid"], c["n_iter"], 42)) for c in configs}, n_folds)

    monkeypatch.setattr(catalog_jobs, "train_models", train_models)
    with pytest.raises(Asked) as asked:
        entry.queries()["m9_train_evaluate"](spark, "/root/testdata/sf0.001")
    assert asked.value.args == ({"additive_boosting": 18, "random_forest": 30, "svm": 5}, 5)


def test_m9_gives_every_cutoff_its_interval(spark):
    svm = dict(MODEL_CONFIGS[2], grid={"regParam": [0.1, 10.0], "maxIter": [2]})
    got = catalog_jobs.m9_train_evaluate(spark, "/root/testdata/sf0.001", configs=[svm], n_folds=2).collect()
    assert len(got) == 99 and {r.n_candidates for r in got} == {2}
    assert all(950 <= r.n_resamples <= 1000 and r.ap_ci_low <= r.ap <= r.ap_ci_high for r in got)


def test_forests_keep_the_nodes_of_rows_and_their_trees(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.random(), rnd.random(), float(rnd.random() < 0.4)) for i in range(400)]
    df = spark.createDataFrame(rows, "PID long, x double, z double, y double").coalesce(1)
    forest = dict(MODEL_CONFIGS[1], grid={"numTrees": [6], "maxDepth": [14]})
    got = run_cv_and_final_train(df, df, "y", "PID", [], ["x", "z"], forest, n_folds=2)["pipeline"]
    assert got.stages[-1].getOrDefault("cacheNodeIds")
    ready = got.stages[-2].transform(got.stages[0].transform(df)).persist()  # the same rows in the same order
    kept, plain = (forest["estimator"](featuresCol="features", labelCol="y", seed=42, numTrees=6, maxDepth=14, **p).fit(ready)
                   for p in (forest["params"], {}))
    assert not plain.getOrDefault("cacheNodeIds") and kept.totalNumNodes > 300
    assert [t.toDebugString.split("\n", 1)[1] for t in kept.trees] == [t.toDebugString.split("\n", 1)[1] for t in plain.trees]
