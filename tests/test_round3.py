"""Selection by counting, nested collections, guarded joins, the binned store, cutoffs, keyed metrics, search."""
import datetime as dt
import json
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cohortkit.operators.aggregates import attach_all_to_bins, attach_to_bins, bin_aggregate, bin_aggregates
from cohortkit.operators.joins import left_join_unique
from cohortkit.operators.reshape import flatten_numbered, multi_hot_dense, numbered_collection
from cohortkit.operators.selection import exact_median
from cohortkit.plans.binning import map_concepts
from cohortkit.plans.evaluation import metrics_by_cutoff, predictions, store_predictions
from cohortkit.plans.features import AggregatedDataset, cutoff_features, first_cutoff
from cohortkit.plans.metrics import _poisson_cdf, ap_interval, auroc_ap, bootstrap_ap, poisson_weight
from cohortkit.plans.search import best_candidates, results, search
from cohortkit.plans.windowing import filter_tables, split_stream
from cohortkit.session import cut_lineage
from cohortkit.sources.schemas import CATALOGUE_ROWS

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("hot", [1 << 20, 50, 0])
def test_median_of_large_groups(spark, hot):
    rnd = random.Random(1)
    rows = [("big", rnd.choice([1.5, 2.5, rnd.random() * 100])) for _ in range(4001)] + [("even", float(i)) for i in range(1000)]
    rows += [("one", 3.0), ("two", 1.0), ("two", 2.0), (None, 5.0), (None, 7.0), ("none", None)] + [("same", 4.0)] * 500
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: r.median for r in exact_median(df, ["k"], "v", hot).collect()}
    want = {k: statistics.median([v for x, v in rows if x == k and v is not None]) for k in {"big", "even", "one", "two", None, "same"}}
    assert got == want


def test_nested_collection_and_its_sink(spark):
    df = spark.createDataFrame([(1, 3, "c", None), (1, 1, "a", 1.0), (1, 2, "b", 2.0), (2, 9, None, 5.0)], "k int, o int, x string, y double")
    nested = numbered_collection(df, ["k"], ["o"], ["x", "y"])
    assert nested.schema["items"].dataType.simpleString() == "array<struct<x:string,y:double>>"
    wide = {r.k: r for r in flatten_numbered(nested, 3).collect()}
    assert wide[1].asDict() == {"k": 1, "x_1": "a", "x_2": "b", "x_3": "c", "y_1": 1.0, "y_2": 2.0, "y_3": None}
    assert wide[2].x_1 is None and wide[2].y_1 == 5.0 and wide[2].x_3 is None
    with pytest.raises(Exception, match="over the 2 columns"):
        flatten_numbered(nested, 2).collect()


def test_joins_raise_on_repeated_keys_in_the_write(spark):
    left = spark.createDataFrame([(1,), (2,), (2,)], "PID long")
    ok = left_join_unique(left, spark.createDataFrame([(1, "a"), (3, "c")], "PID long, x string"), "PID")
    assert sorted((r.PID, r.x) for r in ok.collect() if r.x) == [(1, "a")] and ok.count() == 3
    with pytest.raises(ValueError, match="duplicate key"):
        left_join_unique(left, spark.createDataFrame([(2, "a"), (2, "b")], "PID long, x string"), "PID")


def _dataset(spark, twice=False, **kw):
    base = spark.createDataFrame([(p, f"c{p}", at(0), at(9000), p % 2) for p in range(1, 9)],
                                 "PID long, CPR_hash string, start timestamp_ntz, end timestamp_ntz, y int")
    rnd = random.Random(4)
    rows = [(p, at(rnd.randint(-30, 500)), rnd.choice(["a", "b"]), f"{1e6 + rnd.random():.4f}") for p in range(1, 8) for _ in range(25)]
    rows += [(1, at(60), "a", "3.5"), (1, at(60), "a", "bad"), (8, at(600), "a", "1")]
    labs = spark.createDataFrame(rows, "PID long, TIMESTAMP timestamp_ntz, FEATURE string, VALUE string")
    meds = spark.createDataFrame([(p, at(rnd.randint(0, 500)), "med", rnd.choice(["x y", "z"])) for p in range(1, 8) for _ in range(6)],
                                 "PID long, TIMESTAMP timestamp_ntz, FEATURE string, VALUE string")
    if twice:
        base = base.unionAll(base.where("PID = 1"))
    cfg = {"target": "y", "dataset": {"id_col": "PID", "ts_cat_names": ["M"]}}
    return AggregatedDataset(cfg, base, {"L": labs, "M": meds}, agg_funcs=["first", "last", "min", "max", "mean", "std", "count"],
                             pivot_values={"L": ["a", "b"], "M": ["x y", "z"]}, **kw)


def test_all_cutoffs_at_once_equal_each_alone(spark):
    cuts = [30, 60, 90, 200, 480]
    many = {(r.masking_point, r.PID): r.asDict() for r in _dataset(spark).build_at(cuts).collect()}
    assert len(many) == 40
    for c in cuts:
        ds = _dataset(spark, masking_point=f"{c}min")
        for r in ds.build().collect():
            one, other = r.asDict(), many[c, r.PID]
            assert set(other) == {*one, "masking_point"}
            for k, v in one.items():
                assert other[k] == pytest.approx(v, rel=1e-9, abs=1e-6), (c, k)


def test_dataset_join_is_guarded(spark):
    ds = _dataset(spark)
    ds.concept_frame = lambda name, df: spark.createDataFrame([(1, 1.0), (1, 2.0)], f"PID long, {name}_x double")
    with pytest.raises(Exception, match="duplicate key"):
        ds.build().collect()
    ds.concept_frame = lambda name, df: spark.createDataFrame([(99, 1.0), (99, 2.0)], f"PID long, {name}_x double")
    assert ds.build().count() == 8  # a repeated key that no row meets repeats none


def test_first_cutoff_is_the_first_at_or_after(spark):
    cuts = [1, 2, 3, 10, 20, 30, 31, 100]
    offs = [-5, 0, 1, 59_999_999, 60_000_000, 60_000_001, 180_000_000, 180_000_001, 599_999_999, 600_000_001, 1_860_000_000, 1_860_000_001,
            6_000_000_000, 6_000_000_001]
    got = spark.createDataFrame([(o,) for o in offs], "o long").select("o", first_cutoff("o", cuts).alias("s")).collect()
    assert all(r.s == sum(c * 60_000_000 < r.o for c in cuts) for r in got)


def test_median_is_refused_over_cutoffs(spark):
    with pytest.raises(ValueError, match="median"):
        cutoff_features(spark.createDataFrame([], "PID long, TIMESTAMP timestamp_ntz, FEATURE string, VALUE double, start timestamp_ntz"),
                        None, [1], "x", ["median"])


def _ap(pairs):
    pairs = [(s, y, w) for s, y, w in pairs if w]
    total, ap = sum(w for _, y, w in pairs if y), 0.0
    for s in {s for s, _, _ in pairs}:
        tp, k = (sum(w for t, y, w in pairs if t >= s and (y or not only)) for only in (True, False))
        ap += sum(w for t, y, w in pairs if t == s and y) * tp / k
    return ap / total


def test_keyed_metrics_equal_those_of_each_key(spark):
    rnd = random.Random(2)
    rows = [(f"k{i % 7}", int(rnd.random() < .3), float(rnd.randint(0, 9))) for i in range(600)] + [("one class", 1, 2.0)] * 5
    df = spark.createDataFrame(rows, "k string, y int, p double")
    by = {r.k: r for r in auroc_ap(df, "y", "p", keys=["k"]).collect()}
    assert by["one class"].auroc is None and by["one class"].n == 5
    for i in range(7):
        one = auroc_ap(df.where(F.col("k") == f"k{i}"), "y", "p").first()
        assert all(by[f"k{i}"][c] == pytest.approx(one[c], abs=1e-12) for c in one.asDict())


def test_resample_draws_are_poisson(spark):
    """Mean and variance of the drawn weights are their count, exact and approximate draws alike."""
    for n in (1, 3, 200, 5000):
        d = spark.range(20_000).select(poisson_weight(F.lit(n), F.concat(F.col("id").cast("string"), F.lit(f"|{n}"))).alias("w"))
        m, v = d.agg(F.avg("w"), F.var_samp("w")).first()
        assert abs(m - n) < 5 * (n / 20_000) ** .5 and abs(v / n - 1) < 0.06
    assert _poisson_cdf(1)[0] == pytest.approx(0.36787944117144233) and _poisson_cdf(128)[-1] < 1


def test_interval_by_counts(spark):
    rnd = random.Random(3)
    rows = [(int(rnd.random() < .4), float(rnd.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame(rows, "y int, p double")
    aps = bootstrap_ap(df, "y", "p", 200)
    assert aps.count() == 200
    point = _ap([(p, y, 1) for y, p in rows])
    ci = ap_interval(df, "y", "p", n_bootstraps=200).first()
    assert ci.n_resamples == 200 and ci.ap_ci_low < point < ci.ap_ci_high and ci.ap_ci_high - ci.ap_ci_low < 0.25
    spread = aps.agg(F.stddev("ap")).first()[0]
    plain = [_ap([(p, y, sum(rnd.random() < 1 / 500 for _ in range(500))) for y, p in rows]) for _ in range(60)]
    assert 0.6 < spread / statistics.stdev(plain) < 1.6


def test_predictions_are_stored_and_measured(spark, tmp_path):
    rows = [(c, p, p % 2, float((p * 7 + c) % 5)) for c in (60, 90, 1440) for p in range(20)] + [(2880, p, 1, 1.0) for p in range(4)]
    df = spark.createDataFrame(rows, "masking_point int, PID long, y int, s double")
    path = str(tmp_path / "p")
    store_predictions(predictions(df, "y", score="s"), path)
    stored = store_predictions(predictions(df, "y", score="s").where("time_min = 60"), path)  # a repeat replaces its own partition
    assert sorted(x for x in os.listdir(path) if "=" in x) == ["masking_point=1D", "masking_point=1h", "masking_point=2D", "masking_point=90min"]
    m = {r.masking_point: r for r in metrics_by_cutoff(stored, n_bootstraps=20).collect()}
    assert m["2D"].auroc is None and m["2D"].n == 4 and m["1h"].n == 20 and m["1D"].time_days == 1.0
    one = auroc_ap(df.where("masking_point = 90"), "y", "s").first()
    assert m["90min"].ap == one.ap and m["90min"].ap_ci_low <= m["90min"].ap <= m["90min"].ap_ci_high


def test_search_goes_on_where_it_stopped(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(i, float(i % 10), float(i * 7 % 11), float(i % 10 > 6), i % 3) for i in range(120)],
                               "PID long, x double, z double, label double, fold int")
    tr = cut_lineage(VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df))
    est = LogisticRegression(maxIter=5)
    grid = [{est.regParam: v} for v in (0.0, 10.0)]
    store = str(tmp_path / "store")
    search(tr, {"lr": (est, grid[:1])}, store, n_folds=3)
    before = {(r.candidate, r.fold): r.seconds for r in results(spark, store).collect()}
    assert len(before) == 3
    found = search(tr, {"lr": (est, grid)}, store, n_folds=3)
    after = {(r.candidate, r.fold): r.seconds for r in found.collect()}
    assert len(after) == 6 and all(after[k] == s for k, s in before.items())
    best = best_candidates(found, 3).first()
    assert best.n_candidates == 2 and best.cv_auroc > 0.9 and json.loads(best.params)["regParam"] in (0.0, 10.0)
    assert best_candidates(found.where("fold < 2"), 3).count() == 0  # candidates without all folds do not count


BINS = {"1h": "20min", "end": "1h"}


def _binned(spark):
    base = spark.createDataFrame([(1, at(0), at(120)), (2, at(0), at(60))], "PID long, start timestamp_ntz, end timestamp_ntz")
    long = spark.createDataFrame([(1, at(5), "a", "1"), (1, at(6), "a", "2"), (1, at(70), "b", "5"), (2, at(1), "a", "x")],
                                 "PID long, TIMESTAMP timestamp_ntz, FEATURE string, VALUE string")
    return base, long


def test_store_counts_what_is_committed(spark, tmp_path):
    base, long = _binned(spark)
    cfg = {"bin_intervals": BINS, "agg_func": {"L": ["mean", "std"]}}
    root = str(tmp_path / "store")
    ask = lambda df, b=base: {k: sorted(map(tuple, v.collect()), key=repr) for k, v in map_concepts({"L": df}, b, cfg, out_root=root).items()}
    first = ask(long)
    when = os.path.getmtime(f"{root}/_records/concept=L/agg_func=mean/_SUCCESS")
    assert ask(long) == first
    assert os.path.getmtime(f"{root}/_records/concept=L/agg_func=mean/_SUCCESS") == when  # read back, not written again
    changed = ask(long.withColumn("VALUE", F.lit("7")))
    assert changed != first and ("7.0" in {r[6] for r in changed["L", "mean"]})
    none = ask(long, base.limit(0))  # an empty result is stored as one
    assert none == {("L", "mean"): [], ("L", "std"): []} == ask(long, base.limit(0))
    assert ask(long) == first
    import shutil
    shutil.rmtree(f"{root}/_records/concept=L/agg_func=std")  # a write that broke off has no record
    assert ask(long) == first


@pytest.mark.parametrize("cat,multi,aggs", [(False, False, ["first", "last", "mean", "max", "min", "std", "sum", "count"]),
                                            (True, False, ["mode", "first", "last"]), (True, True, ["last"])])
def test_all_aggregates_at_once_equal_each_alone(spark, cat, multi, aggs):
    _, long = _binned(spark)
    placed = long.withColumn("bin_counter", F.when(F.col("FEATURE") == "a", 1).otherwise(3))
    bins = spark.createDataFrame([(p, c) for p in (1, 2) for c in (1, 2, 3)], "PID long, bin_counter int")
    many = attach_all_to_bins(bins, bin_aggregates(placed, aggs, cat, multi), aggs)
    for a in aggs:
        one = attach_to_bins(bins, bin_aggregate(placed, a, cat, multi))
        key = lambda d: sorted(map(tuple, d.select("PID", "bin_counter", "FEATURE", "VALUE").collect()), key=repr)
        assert key(many.where(F.col("agg_func") == a)) == key(one)


def test_tables_share_one_window_join(spark):
    base = spark.createDataFrame([(1, "p", at(1440), at(2880)), (2, "p", at(2000), at(2100))],
                                 "PID long, CPR_hash string, start timestamp_ntz, end timestamp_ntz")
    labs = spark.createDataFrame([("p", at(1440), 1.5), ("p", at(1440), 1.5), ("p", at(1439), 2.5), ("q", at(1500), 1.0), ("p", None, 1.0)],
                                 "CPR_hash string, `Prøvetagningstidspunkt` timestamp_ntz, v double")
    diag = spark.createDataFrame([("p", at(0), "x"), ("p", at(-1), "y"), ("p", at(2050), "z")],
                                 "CPR_hash string, Noteret_dato timestamp_ntz, code string")
    from pyspark.sql import Row
    cat = [Row(filename=f, dt_colname=d, ts_offset=o) for f, d, _, _, o in CATALOGUE_ROWS if f in ("Labsvar", "Diagnoser")]
    w = filter_tables(base, {"Labsvar": labs, "Diagnoser": diag}, cat)
    assert sorted((r.PID, r.v) for r in split_stream(w, "Labsvar").collect()) == [(1, 1.5)]
    assert split_stream(w, "Labsvar").columns == ["PID", *labs.columns]
    # the catalogue gives diagnoses a day on both sides
    assert sorted((r.PID, r.code) for r in split_stream(w, "Diagnoser").collect()) == [(1, "x"), (1, "z"), (2, "z")]


def test_dense_matrix_is_scattered(spark):
    rnd = random.Random(7)
    cells = {(s, rnd.randrange(5), rnd.randrange(4)) for s in range(6) for _ in range(rnd.randrange(12))}
    ones = spark.createDataFrame(sorted(cells), "s long, idx int, timestep int")
    got = {r.s: r.multi_hot for r in multi_hot_dense(ones, "s", 5, 4, spark.createDataFrame([(s,) for s in range(8)], "s long")).collect()}
    assert got == {s: [[float((s, i, t) in cells) for t in range(4)] for i in range(5)] for s in range(8)}
