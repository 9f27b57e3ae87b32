"""Findings of the round r03: steps that must not grow with bins or cutoffs per row."""

import datetime as dt

from pyspark.sql import functions as F

from cohortkit.config import DEFAULT_CONFIG
from cohortkit.operators.grid import Grid, attach_to_grid, make_bins
from cohortkit.plans.catalog import catalog_bins
from cohortkit.plans.features import AggregatedDataset

GENERAL_BINS = catalog_bins.GENERAL_BINS
T0 = dt.datetime(2024, 1, 1)


def _base(spark):
    rows = [(1, T0, T0 + dt.timedelta(hours=5)), (2, T0, T0 + dt.timedelta(minutes=7)), (2, T0, T0 + dt.timedelta(hours=1)),
            (3, T0, None), (None, T0, T0 + dt.timedelta(minutes=30)), (4, T0, T0 + dt.timedelta(days=3)), (5, T0, T0 - dt.timedelta(days=1))]
    return spark.createDataFrame(rows, "PID long, start timestamp_ntz, end timestamp_ntz")


def test_attach_to_grid_is_the_join_with_the_bins(spark):
    found = spark.createDataFrame(
        [(1, 2, "a", 1.0), (1, 2, "b", None), (1, 9, "a", 3.0), (2, 1, "a", 4.0), (2, 900, "a", 5.0), (4, 900, "z", 1.0), (None, 1, "a", 6.0),
         (4, 3, None, 7.0), (9, 1, "a", 8.0)], "PID long, bin_counter int, FEATURE string, VALUE double")
    for grid in (DEFAULT_CONFIG["bin_intervals"], GENERAL_BINS):
        want = make_bins(_base(spark), grid).join(found, ["PID", "bin_counter"], "left")
        got = attach_to_grid(_base(spark), found, grid)
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_attach_to_grid_shuffles_no_bins(spark):
    found = spark.createDataFrame([(1, 2, "a", 1.0)], "PID long, bin_counter int, FEATURE string, VALUE double")
    plan = attach_to_grid(_base(spark), found, GENERAL_BINS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join LeftOuter")  # bins come after the join
    assert "aggregate(" not in plan and "lambda" not in plan  # and their segments are plain columns


def _edges(window_us):
    """The definition: edges from the last edge on, strictly below min(interval end, window end); the last partial bin is dropped."""
    us = {"min": 60, "h": 3600, "D": 86400}
    parse = lambda t: int("".join(c for c in t if c.isdigit())) * us["".join(c for c in t if not c.isdigit())] * 1_000_000
    cur, out = 0, []
    for end, freq in GENERAL_BINS.items():
        lim, f = window_us if end == "end" else min(parse(end), window_us), parse(freq)
        while cur + f < lim:
            out.append((cur, cur + f, freq))
            cur += f
    return out


def test_general_grid_segments(spark):
    windows = [1, 600, 1199, 1200, 1201, 2400, 3600, 3601, 4000, 9000, 10800, 10801, 20000, 172800, 172801, 200000, 500000]
    base = spark.createDataFrame([(i, T0, T0 + dt.timedelta(seconds=w - 600)) for i, w in enumerate(windows)],
                                 "PID long, start timestamp_ntz, end timestamp_ntz")
    got = {}
    for r in make_bins(base, GENERAL_BINS).collect():
        off = lambda t: round((t - T0).total_seconds() * 1e6)
        got.setdefault(r.PID, []).append((r.bin_counter, (off(r.bin_start), off(r.bin_end), r.bin_freq)))
    for i, w in enumerate(windows):
        assert sorted(got.get(i, [])) == list(enumerate(_edges(w * 1_000_000), 1))
    assert Grid(GENERAL_BINS).general


def test_runs_of_cutoffs(spark):
    base = spark.createDataFrame([(1, T0, 40, 1), (2, T0, 50, 0), (None, T0, 60, 0)], "PID long, start timestamp_ntz, AGE long, y int")
    at = lambda m: T0 + dt.timedelta(minutes=m)
    labs = spark.createDataFrame([(1, at(30), "a", 1.0), (1, at(90), "b", 2.0), (1, at(100), "a", 3.0), (1, at(999999), "a", 9.0)],
                                 "PID long, TIMESTAMP timestamp_ntz, FEATURE string, VALUE double")
    med = spark.createDataFrame([(1, at(61), "x", "m")], "PID long, TIMESTAMP timestamp_ntz, FEATURE string, VALUE string")
    cfg = {"target": "y", "dataset": {"id_col": "PID", "num_cols": ["AGE"], "ts_cat_names": ["Med"]}}
    ds = AggregatedDataset(cfg, base, {"Labs": labs, "Med": med}, agg_funcs=["last", "std", "count"],
                           pivot_values={"Labs": ["a", "b"], "Med": ["m"]})
    cuts = [60 * h for h in range(1, 73)]
    runs = ds.build_runs(cuts)
    assert runs.count() == 4  # two states of PID 1, one each of the others; not a row per cutoff
    full = {(r.masking_point, r.PID): r for r in ds.build_at(cuts).collect()}
    assert len(full) == 3 * 72
    first, later = full[(60, 1)], full[(4320, 1)]
    assert (first["a_Labs_last"], first["a_Labs_count"], first["b_Labs_last"], first["m_Med_given"]) == (1.0, 1.0, 0.0, 0)
    assert (later["a_Labs_last"], later["a_Labs_count"], later["b_Labs_last"], later["m_Med_count"]) == (3.0, 2.0, 2.0, 1)
    assert abs(later["a_Labs_std"] - 2 ** 0.5) < 1e-9 and first["a_Labs_std"] == 0.0
    assert full[(60, None)]["AGE"] == 60 and full[(4320, 2)]["a_Labs_count"] == 0.0


def test_predictions_are_written_without_a_sort(spark, tmp_path):
    from cohortkit.sources.sinks import WRITERS, write_predictions
    before = spark.conf.get(WRITERS)
    rows = spark.range(0, 3000, 1, 2).select("id", (F.col("id") % 3).cast("string").alias("masking_point"))
    seen = []
    write = type(rows.write).parquet
    try:
        type(rows.write).parquet = lambda self, *a, **k: (seen.append(spark.conf.get(WRITERS)), write(self, *a, **k))[1]
        write_predictions(rows, str(tmp_path / "p"))
    finally:
        type(rows.write).parquet = write
    assert seen == ["128"] and spark.conf.get(WRITERS) == before
    assert spark.read.parquet(str(tmp_path / "p")).groupBy("masking_point").count().count() == 3
