"""Code, numeric and time scalars (X1-X13, N1, D4-D9), FIXTURES §4."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortkit.config import DEFAULT_CONFIG
from cohortkit.functions import codes
from cohortkit.functions.numeric import lab_clean, numeric_or_null, parse_numeric
from cohortkit.functions.timefns import (age_years, event_within_days, mask_mortality, masking_summary,
                                         micros_between, step_to_time, time_thresholds, time_to_step, to_ts)
from cohortkit.operators.reshape import split_blood_pressure

BINS = DEFAULT_CONFIG["bin_intervals"]


def col1(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"c {typ}")
    return [r[0] for r in df.select(expr(F.col("c"))).collect()]


def test_department_classes(spark):
    names = ["RH TRAUMECENTER", "dagkirurgi intensiv", "øjenklinik operation", "RH INTENSIV, 4131", "ITA 1",
             "HGH SENGEAFSNIT", "AMBULATORIUM", "KØKKEN", "rh bedøvelse og operation", None, ""]
    assert col1(spark, names, codes.classify) == ["TC", "OR", "OR", "ICU", "ICU", "BED", "AMB", None, "OR", None, None]


def test_first_hospital(spark):
    names = ["SJ HOLBÆK, SENGE", "RH x", "rh x", "sj holbæk", "Foo bar", None, ""]
    assert col1(spark, names, codes.derive_first_hospital) == ["SJ HOLBÆK", "RH", "RH", "MISC", "MISC", None, None]
    assert col1(spark, [""], lambda c: codes.derive_first_hospital(c, empty_is_null=False)) == ["MISC"]


def test_atc(spark):
    assert col1(spark, ["J01CA04", "N02AB03", "C03CA01", "Z99", None], codes.classify_atc) == \
        ["antibiotics", "opiods", "diuretics", None, None]


def test_lab_cleanup(spark):
    got = col1(spark, ["<0,5", "3*", ">1.2", "neg", "neg 1", "5d", "nan"], lambda c: numeric_or_null(lab_clean(c)))
    assert got == [0.5, 3.0, 1.2, None, None, None, None]
    assert col1(spark, ["< 4", ">7", "x"], parse_numeric) == [4.0, 7.0, None]


def test_strip_code_ends(spark):
    assert col1(spark, ["DC221A", "DC220", "A", None], codes.strip_code_ends) == ["C221", "C22", "", None]


def test_bp_split_and_units(spark):
    df = spark.createDataFrame([(1, "BT", "120/80"), (1, "Puls", "70")], "PID long, FEATURE string, VALUE string")
    got = {(r.FEATURE, r.VALUE) for r in split_blood_pressure(df, codes.BP_TYPES).collect()}
    assert got == {("SBP", "120.0"), ("DBP", "80.0"), ("Puls", "70")}
    assert abs(70 * 2.54 - 177.8) < 1e-9 and abs(2800 * 0.0283495231 - 79.378665) < 1e-6


def test_age_and_deceased(spark):
    s = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(dt.datetime(2000, 1, 1), s)], "dob timestamp_ntz, s timestamp_ntz")
    assert df.select(age_years(F.col("dob"), F.col("s"))).first()[0] == 24
    dods = [s + dt.timedelta(days=30), s + dt.timedelta(days=30, seconds=1), s - dt.timedelta(days=1), None]
    d2 = spark.createDataFrame([(d, s) for d in dods], "dod timestamp_ntz, s timestamp_ntz")
    assert [r[0] for r in d2.select(event_within_days(F.col("dod"), F.col("s"), 30)).collect()] == [1.0, 0.0, 1.0, 0.0]


def test_tolerant_parse(spark):
    got = col1(spark, ["2024-01-02 03:04:05", "2024-01-02", "02-01-2024 03:04", "garbage", None], to_ts)
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4), None, None]


def test_wall_clock_in_every_session_zone(spark):
    """The hour that a zone skips exists on the wall clock."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Copenhagen")
    try:
        got = col1(spark, ["31-03-2024 02:30:00", "2024-03-31 02:30:00", "31/03/2024 02:30"], to_ts)
        assert got == [dt.datetime(2024, 3, 31, 2, 30)] * 3
        a, b = dt.datetime(2024, 3, 31), dt.datetime(2024, 3, 31, 2, 30)
        df = spark.createDataFrame([(a, b), (b, a)], "a timestamp_ntz, b timestamp_ntz")
        assert [r[0] for r in df.select(micros_between(F.col("a"), F.col("b"))).collect()] == [9_000_000_000, -9_000_000_000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_steps(spark):
    mins = [60, 180, 181, 1440, 4320, 5760, 21600]
    assert col1(spark, [float(m) for m in mins], lambda c: time_to_step(c, "min", BINS), "double") == \
        [11, 35, 36, 101, 149, 153, 194]
    assert col1(spark, [11, 149, 194], lambda c: step_to_time(c, BINS), "long") == [60.0, 4320.0, None]
    assert col1(spark, [60 * 60_000_000, 60 * 60_000_000 + 1, 0, -5], lambda c: time_to_step(c, "us", BINS), "long") == [11, 12, 0, 0]
    steps = [r[0] for r in time_thresholds(spark, BINS).collect()]
    assert len(steps) == 99 and steps == sorted(set(steps))
    with pytest.raises(ValueError):
        time_to_step(F.col("x"), "weeks", BINS)


def test_labels(spark):
    df = spark.createDataFrame([(5.0, 0), (360.0, 1), (1440.0, 2), (4320.0, 3), (None, 194), (75.0, 4), (90.0, 5)],
                               "m double, s long")
    out = df.select(codes.step_label(F.col("m"), F.col("s")), codes.hours_label(F.col("m"))).collect()
    assert [tuple(r) for r in out] == [("5 min", "0.1h"), ("6 h", "6.0h"), ("1 day", "1.0d"), ("3 days", "3.0d"),
                                       ("Step 194", "N/A"), ("1.25 h", "1.2h"), ("1.5 h", "1.5h")]


def test_mask_mortality(spark):
    s = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, s, s + dt.timedelta(hours=10), s), (2, s, s + dt.timedelta(hours=0.4), s),
                                (3, s, s + dt.timedelta(hours=10), None)],
                               "PID long, start timestamp_ntz, end timestamp_ntz, DOD timestamp_ntz")
    got = {r.PID: r.end for r in mask_mortality(df, "percentage").collect()}
    assert got == {1: s + dt.timedelta(hours=9.5), 2: s + dt.timedelta(hours=0.5), 3: s + dt.timedelta(hours=10)}
    summary = masking_summary(mask_mortality(df, "percentage")).first()
    assert summary.n_masked == 2 and abs(summary.mean_hours_removed - (0.5 - 0.1) / 2) < 1e-9
