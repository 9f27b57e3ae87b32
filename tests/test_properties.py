"""Property tests with small example counts: each example runs
Spark jobs."""
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortkit.config import DEFAULT_CONFIG
from cohortkit.operators.grid import assign_points, make_bins
from cohortkit.operators.joins import semi_join_ids
from cohortkit.operators.ordered import ordered_scan, time_bucket
from cohortkit.operators.trajectories import collapse_admissions
from cohortkit.plans.split import temporal_split

T0 = dt.datetime(2024, 1, 1)
BINS = DEFAULT_CONFIG["bin_intervals"]
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 600), st.integers(1, 300)), min_size=1, max_size=25))
def test_collapse_idempotent_on_disjoint_stays(spark, gaps):
    rows, t = [], T0
    for gap, dur in gaps:  # disjoint, ordered stays
        s = t + dt.timedelta(minutes=gap)
        e = s + dt.timedelta(minutes=dur)
        rows.append(("p", s, e))
        t = e
    df = spark.createDataFrame(rows, "CPR_hash string, start timestamp_ntz, end timestamp_ntz")
    once = collapse_admissions(df, label_col=None, gap_hours=1).select("CPR_hash", "start", "end")
    twice = collapse_admissions(once, label_col=None, gap_hours=1).select("CPR_hash", "start", "end")
    assert sorted(once.collect()) == sorted(twice.collect())


@SETTINGS
@given(st.integers(1, 40 * 24 * 60), st.lists(st.integers(-60, 45 * 24 * 60), min_size=1, max_size=30))
def test_each_event_in_at_most_one_half_open_bin(spark, stay_min, offsets):
    base = spark.createDataFrame([(1, T0, T0 + dt.timedelta(minutes=stay_min))],
                                 "PID long, start timestamp_ntz, end timestamp_ntz")
    ev = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=o, seconds=i % 2), "f", float(i))
                                for i, o in enumerate(offsets)],
                               "PID long, TIMESTAMP timestamp_ntz, FEATURE string, VALUE double")
    placed = assign_points(ev, base, BINS)
    per_event = placed.groupBy("VALUE").count().collect()
    assert all(r["count"] == 1 for r in per_event)
    # the bin really contains the event
    assert placed.where((F.col("TIMESTAMP") < F.col("bin_start")) | (F.col("TIMESTAMP") >= F.col("bin_end"))).count() == 0
    # and agrees with a join against the generated grid
    bins = make_bins(base, BINS)
    joined = ev.join(bins, "PID").where((F.col("TIMESTAMP") >= F.col("bin_start")) & (F.col("TIMESTAMP") < F.col("bin_end")))
    assert sorted((r.VALUE, r.bin_counter) for r in joined.collect()) == \
        sorted((r.VALUE, r.bin_counter) for r in placed.collect())
    closed = assign_points(ev, base, BINS, closed=True)
    joined_c = ev.join(bins, "PID").where((F.col("TIMESTAMP") >= F.col("bin_start")) & (F.col("TIMESTAMP") <= F.col("bin_end")))
    assert sorted((r.VALUE, r.bin_counter) for r in joined_c.collect()) == \
        sorted((r.VALUE, r.bin_counter) for r in closed.collect())


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20 * 24 * 60), st.integers(-5, 5)), min_size=1, max_size=60),
       st.sampled_from([3600, 6 * 3600, 86400]))
def test_bucketed_running_ops_equal_window(spark, rows, width):
    data = [(k, T0 + dt.timedelta(minutes=m), i, v) for i, (k, m, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k long, t timestamp_ntz, i long, v long").withColumn("b", time_bucket("t", width))
    spec = dict(lag={"p": "v"}, lead={"n": "v"}, cumsum={"c": "v"})
    a = sorted(tuple(r) for r in ordered_scan(df, ["k"], ["t", "i"], "b", **spec).select("i", "p", "n", "c").collect())
    b = sorted(tuple(r) for r in ordered_scan(df, ["k"], ["t", "i"], None, **spec).select("i", "p", "n", "c").collect())
    assert a == b


@SETTINGS
@given(st.lists(st.sampled_from(["a", "b", "c", None]), min_size=1, max_size=20),
       st.lists(st.sampled_from(["a", "b", "z"]), max_size=5))
def test_semi_join_subset(spark, left, ids):
    l = spark.createDataFrame([(x, i) for i, x in enumerate(left)], "CPR_hash string, i long")
    r = spark.createDataFrame([(x,) for x in ids], "CPR_hash string")
    got = {row.i for row in semi_join_ids(l, r).collect()}
    assert got == {i for i, x in enumerate(left) if x is not None and x in set(ids)}


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(-400, 400)), min_size=1, max_size=30))
def test_temporal_split_partitions_non_null_dates(spark, days):
    df = spark.createDataFrame([(i, None if d is None else T0 + dt.timedelta(days=d)) for i, d in enumerate(days)],
                               "i long, ServiceDate timestamp_ntz")
    tr, ho = temporal_split(df, "2024-01-01")
    a, b = {r.i for r in tr.collect()}, {r.i for r in ho.collect()}
    assert not (a & b) and a | b == {i for i, d in enumerate(days) if d is not None}
