"""Bin grid (G1/K15/K16/W8/S12) and bin placement (J6/J8/J9), FIXTURES §4."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortkit.config import DEFAULT_CONFIG
from cohortkit.operators.grid import (assign_points, check_bin_freqs, expand_intervals, grid_segments,
                                      make_bins)
from cohortkit.operators.aggregates import attach_to_bins, bin_aggregate

BINS = DEFAULT_CONFIG["bin_intervals"]
T0 = dt.datetime(2024, 1, 1)


def _base(spark, rows):
    return spark.createDataFrame(rows, "PID long, start timestamp_ntz, end timestamp_ntz")


def test_segments_default():
    segs = [(s.start_us // 60_000_000, s.freq_us // 60_000_000, s.first_counter, s.n_bins)
            for s in grid_segments(BINS)]
    assert segs == [(0, 5, 1, 35), (175, 10, 36, 18), (355, 15, 54, 24), (715, 30, 78, 24),
                    (1435, 60, 102, 48), (4315, 360, 150, 44), (20155, 1440, 194, None)]


def test_non_monotone_grid_is_folded_per_trajectory(spark):
    cfg = {"1h": "20min", "3h": "5min", "end": "1h"}
    with pytest.raises(ValueError):
        grid_segments(cfg)  # no constant segments exist for this config
    b = _base(spark, [(1, T0, T0 + dt.timedelta(minutes=61))])  # window 71 min
    rows = make_bins(b, cfg).orderBy("bin_counter").collect()
    # 0-20, 20-40 (edge 60 not below min(60, 71)); then 5-min bins from 40 to 70
    assert [(r.bin_start.minute if r.bin_start.hour == 0 else 60 + r.bin_start.minute, r.bin_freq) for r in rows] == \
        [(0, "20min"), (20, "20min")] + [(m, "5min") for m in range(40, 70, 5)]
    ev = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=42), "x", 1.0), (1, T0 + dt.timedelta(minutes=70), "x", 2.0)],
                               "PID long, TIMESTAMP timestamp_ntz, FEATURE string, VALUE double")
    assert sorted((r.VALUE, r.bin_counter) for r in assign_points(ev, b, cfg).collect()) == [(1.0, 3)]
    assert sorted((r.VALUE, r.bin_counter) for r in assign_points(ev, b, cfg, closed=True).collect()) == [(1.0, 3), (2.0, 8)]


@pytest.mark.parametrize("minutes,n,last", [(175, 35, (170, 175, "5min")), (176, 36, (175, 185, "10min"))])
def test_window_end_rule(spark, minutes, n, last):
    b = _base(spark, [(1, T0, T0 + dt.timedelta(minutes=minutes))])
    bins = make_bins(b, BINS).orderBy("bin_counter").collect()
    assert len(bins) == n
    lb = bins[-1]
    assert (lb.bin_start, lb.bin_end, lb.bin_freq) == (T0 + dt.timedelta(minutes=last[0]),
                                                       T0 + dt.timedelta(minutes=last[1]), last[2])
    assert [r.bin_counter for r in bins] == list(range(1, n + 1))


def test_bins_contiguous_and_long_stay(spark):
    b = _base(spark, [(1, T0, T0 + dt.timedelta(days=20))])
    rows = make_bins(b, BINS).orderBy("bin_counter").collect()
    assert len(rows) == 193 + 6
    for a, c in zip(rows, rows[1:]):
        assert a.bin_end == c.bin_start
    assert rows[193].bin_freq == "1D" and rows[193].bin_counter == 194


def test_skip_null_and_empty_windows_and_drop_last(spark):
    b = spark.createDataFrame([(1, T0, T0 + dt.timedelta(hours=1), True), (2, None, T0, False),
                               (3, T0, T0 - dt.timedelta(hours=1), False), (4, T0, T0 + dt.timedelta(minutes=1), True)],
                              "PID long, start timestamp_ntz, end timestamp_ntz, drop_last_bin boolean")
    counts = {r.PID: r["count"] for r in make_bins(b, BINS, drop_last_col="drop_last_bin").groupBy("PID").count().collect()}
    # 70 min window -> 13 bins, minus the dropped last; PID 4: 11 min -> 2 bins -> 1
    assert counts == {1: 12, 4: 1}


def test_point_half_open_vs_closed(spark):
    b = _base(spark, [(1, T0, T0 + dt.timedelta(hours=1))])
    ev = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=5), "x", 1.0)],
                               "PID long, TIMESTAMP timestamp_ntz, FEATURE string, VALUE double")
    half = [r.bin_counter for r in assign_points(ev, b, BINS).collect()]
    closed = sorted(r.bin_counter for r in assign_points(ev, b, BINS, closed=True).collect())
    assert half == [2] and closed == [1, 2]


def test_interval_overlap_strict(spark):
    b = _base(spark, [(1, T0, T0 + dt.timedelta(hours=1))])
    ev = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=4), T0 + dt.timedelta(minutes=10), "ADT", "OR")],
                               "PID long, TIMESTAMP timestamp_ntz, END_TIMESTAMP timestamp_ntz, FEATURE string, VALUE string")
    out = expand_intervals(ev, b, BINS).orderBy("TIMESTAMP").collect()
    assert [r.TIMESTAMP for r in out] == [T0, T0 + dt.timedelta(minutes=5)]
    assert "END_TIMESTAMP" not in out[0].asDict()


def test_std_single_value_bin_vanishes(spark):
    b = _base(spark, [(1, T0, T0 + dt.timedelta(minutes=1))])  # 2 bins
    ev = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=1), "HR", "80")],
                               "PID long, TIMESTAMP timestamp_ntz, FEATURE string, VALUE string")
    agg = bin_aggregate(assign_points(ev, b, BINS), "std")
    out = attach_to_bins(make_bins(b, BINS), agg).collect()
    assert [(r.bin_counter, r.FEATURE, r.VALUE) for r in out] == [(2, None, None)]


def test_freshness_check(spark):
    b = _base(spark, [(1, T0, T0 + dt.timedelta(hours=1))])
    bins = make_bins(b, BINS)
    missing = check_bin_freqs(bins, BINS)
    assert "1D" in missing and "5min" not in missing
    with pytest.raises(ValueError):
        check_bin_freqs(bins, BINS, strict=True)
    with pytest.raises(ValueError):
        check_bin_freqs(bins.withColumn("bin_freq", F.lit("7min")), BINS)
