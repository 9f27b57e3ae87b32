"""Registered queries, part 3: grid, binning, per-bin and per-patient
aggregates, time steps and mortality masking."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.timefns import mask_mortality, micros_between, micros_sql, step_to_time, time_thresholds, time_to_step
from ..operators.aggregates import bin_aggregate, categorical_wide, numeric_wide
from ..operators.filters import mask_after
from ..operators.grid import assign_points, check_bin_freqs, expand_intervals, make_bins
from ..operators.joins import filter_by_time_window, window_join
from ..operators.selection import exact_median
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.readers import get_concept
from ..sources.sinks import read_binned
from . import driver_tables as dt
from .binning import map_concept, map_concepts
from .catalog_ops import _LAB_INCLUDE, _LAB_MAP_SQL, _NUM_RE, _sql_classify
from .catalog import BINS, SQL_BASE, SQL_WLONG, base, r6, register, sql_bins, windowed_long
from .cohort import add_first_contacts

W = dt.with_sql
CFG = {"bin_intervals": BINS}


def _base_with_dod(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    pi = dt.patient_info(dt.read(spark, sf, "customer")).select("CPR_hash", "DOD")
    return b.join(pi, "CPR_hash", "left")


SQL_BASE_DOD = SQL_BASE + """,
based AS (SELECT b.*, p.DOD FROM base b LEFT JOIN pinfo p ON b.CPR_hash = p.CPR_hash)"""


# ---------------------------------------------------------------------------
# G1 / K16 / W8 / D9(drop_last_bin): grid with last bin dropped for deceased
# ---------------------------------------------------------------------------
def g1_k16_bins(spark: SparkSession, sf: str) -> DataFrame:
    b = mask_mortality(_base_with_dod(spark, sf), "drop_last_bin")
    bins = make_bins(b, BINS, drop_last_col="drop_last_bin")
    return bins.groupBy("PID").agg(F.count(F.lit(1)).cast("bigint").alias("n_bins"),
                                   F.max("bin_end").alias("last_bin_end"),
                                   F.max_by("bin_freq", "bin_counter").alias("last_freq"))


register("g1_k16_bins", W(dt.SQL_ADT, dt.SQL_PINFO, SQL_BASE_DOD, sql_bins(BINS, "based")) + """,
counted AS (SELECT b.*, count(*) OVER (PARTITION BY b.PID) AS n, d.DOD FROM bins b JOIN based d ON b.PID = d.PID),
kept AS (SELECT * FROM counted WHERE NOT (DOD IS NOT NULL AND n > 1 AND bin_counter = n))
SELECT PID, CAST(count(*) AS BIGINT) AS n_bins, max(bin_end) AS last_bin_end, arg_max(bin_freq, bin_counter) AS last_freq
FROM kept GROUP BY PID""")(g1_k16_bins)


def s12_bin_freqs(spark: SparkSession, sf: str) -> DataFrame:
    """Bins per frequency; the check (S12) names the frequencies that no trajectory reaches."""
    bins = make_bins(base(spark, sf), BINS)
    missing = check_bin_freqs(bins, BINS)
    found = bins.groupBy("bin_freq").agg(F.count(F.lit(1)).cast("bigint").alias("n_bins"),
                                         F.min("bin_counter").alias("first_counter"))
    unused = spark.createDataFrame([(f, 0, None) for f in missing], "bin_freq string, n_bins bigint, first_counter int")
    return found.unionByName(unused)


register("s12_bin_freqs", W(dt.SQL_ADT, SQL_BASE, sql_bins()) + """
SELECT lbl AS bin_freq, CAST(count(bin_freq) AS BIGINT) AS n_bins, min(bin_counter) AS first_counter
FROM (SELECT DISTINCT lbl FROM spans) LEFT JOIN bins ON bin_freq = lbl GROUP BY lbl""")(s12_bin_freqs)


# ---------------------------------------------------------------------------
# Half-open and closed point-in-bin
# ---------------------------------------------------------------------------
def _point_counts(spark: SparkSession, sf: str, closed: bool) -> DataFrame:
    b = base(spark, sf)
    lm = windowed_long(spark, sf, b)
    placed = assign_points(lm, b, BINS, closed=closed)
    return placed.groupBy("PID", "bin_counter").agg(F.count(F.lit(1)).cast("bigint").alias("n_events"),
                                                    r6(F.sum("VALUE")).alias("sum_value"))


def j8_point_in_bin(spark: SparkSession, sf: str) -> DataFrame:
    return _point_counts(spark, sf, False)


def j9_point_in_bin_closed(spark: SparkSession, sf: str) -> DataFrame:
    return _point_counts(spark, sf, True)


def _sql_points(op: str) -> str:
    return W(dt.SQL_ADT, SQL_BASE, SQL_WLONG, sql_bins()) + f"""
SELECT bn.PID, bn.bin_counter, CAST(count(*) AS BIGINT) AS n_events, round(sum(w.VALUE), 6) AS sum_value
FROM wlong w JOIN bins bn ON w.PID = bn.PID AND w."TIMESTAMP" >= bn.bin_start AND w."TIMESTAMP" {op} bn.bin_end
GROUP BY bn.PID, bn.bin_counter"""


register("j8_point_in_bin", _sql_points("<"))(j8_point_in_bin)
register("j9_point_in_bin_closed", _sql_points("<="))(j9_point_in_bin_closed)


# ---------------------------------------------------------------------------
# J6 / C7-style interval concept: ADT stays expanded to overlapping bins
# ---------------------------------------------------------------------------
def j6_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    a = dt.adt(dt.read(spark, sf, "events"))
    inside = window_join(a, b, "CPR_hash", "Flyt_ind", F.col("start"), F.col("end"), carry=["PID"])
    ev = inside.select("PID", "event_id", F.col("Flyt_ind").alias("TIMESTAMP"), F.col("Flyt_ud").alias("END_TIMESTAMP"),
                       F.lit("ADT").alias("FEATURE"), codes.classify(F.col("Afsnit")).alias("VALUE"))
    return expand_intervals(ev, b, BINS).select("event_id", "PID", "TIMESTAMP", "VALUE")


register("j6_interval_overlap", W(dt.SQL_ADT, SQL_BASE, sql_bins()) + f""",
inside AS (SELECT DISTINCT a.*, b.PID FROM adt a JOIN base b ON a.CPR_hash = b.CPR_hash
           AND a.Flyt_ind >= b.start AND a.Flyt_ind <= b."end")
SELECT i.event_id, i.PID, bn.bin_start AS "TIMESTAMP",
       {_sql_classify('i.Afsnit')} AS VALUE
FROM inside i JOIN bins bn ON i.PID = bn.PID AND i.Flyt_ind < bn.bin_end AND i.Flyt_ud > bn.bin_start""")(
    j6_interval_overlap)


# ---------------------------------------------------------------------------
# A4 + A10: per-bin std (single values vanish) and last
# ---------------------------------------------------------------------------
def a4_bin_std(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    out = map_concept(windowed_long(spark, sf, b), b, CFG, agg_func="std")
    return out.withColumn("VALUE", r6("VALUE"))


def a4_bin_last(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    out = map_concept(windowed_long(spark, sf, b), b, CFG, agg_func="last")
    return out.withColumn("VALUE", r6("VALUE"))


def _sql_bin_agg(agg: str) -> str:
    return W(dt.SQL_ADT, SQL_BASE, SQL_WLONG, sql_bins()) + f""",
placed AS (SELECT w.PID, bn.bin_counter, w.FEATURE, w.VALUE, w."TIMESTAMP" FROM wlong w
           JOIN bins bn ON w.PID = bn.PID AND w."TIMESTAMP" >= bn.bin_start AND w."TIMESTAMP" < bn.bin_end),
agg AS (SELECT PID, bin_counter, FEATURE, {agg} AS VALUE FROM placed GROUP BY PID, bin_counter, FEATURE)
SELECT bn.PID, bn.bin_start, bn.bin_end, bn.bin_counter, bn.bin_freq, a.FEATURE, round(a.VALUE, 6) AS VALUE
FROM bins bn LEFT JOIN agg a ON bn.PID = a.PID AND bn.bin_counter = a.bin_counter
WHERE NOT (a.FEATURE IS NOT NULL AND a.VALUE IS NULL)"""


register("a4_bin_std", _sql_bin_agg("stddev_samp(VALUE)"))(a4_bin_std)
register("a4_bin_last", _sql_bin_agg('arg_max(VALUE, "TIMESTAMP")'))(a4_bin_last)


# ---------------------------------------------------------------------------
# A5: per-bin categorical mode (smallest value on ties)
# ---------------------------------------------------------------------------
def _event_labels(spark: SparkSession, sf: str, b: DataFrame) -> DataFrame:
    lm = windowed_long(spark, sf, b)
    return lm.select("PID", "TIMESTAMP", F.lit("event").alias("FEATURE"), F.col("FEATURE").alias("VALUE"))


def a5_bin_mode(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    return map_concept(_event_labels(spark, sf, b), b, CFG, agg_func="mode", is_categorical=True)


register("a5_bin_mode", W(dt.SQL_ADT, SQL_BASE, SQL_WLONG, sql_bins()) + """,
placed AS (SELECT w.PID, bn.bin_counter, w.FEATURE AS v FROM wlong w
           JOIN bins bn ON w.PID = bn.PID AND w."TIMESTAMP" >= bn.bin_start AND w."TIMESTAMP" < bn.bin_end),
cnt AS (SELECT PID, bin_counter, v, count(*) AS c FROM placed GROUP BY ALL),
agg AS (SELECT PID, bin_counter, 'event' AS FEATURE, first(v ORDER BY c DESC, v) AS VALUE FROM cnt GROUP BY PID, bin_counter)
SELECT bn.PID, bn.bin_start, bn.bin_end, bn.bin_counter, bn.bin_freq, a.FEATURE, a.VALUE
FROM bins bn LEFT JOIN agg a ON bn.PID = a.PID AND bn.bin_counter = a.bin_counter""")(a5_bin_mode)


# ---------------------------------------------------------------------------
# A6 + R6: per-bin distinct labels of list-valued cells
# ---------------------------------------------------------------------------
def a6_bin_multilabel(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    ev = dt.read(spark, sf, "events")
    lm = ev.select(F.col("user_id").cast("string").alias("CPR_hash"), F.col("ts").alias("TIMESTAMP"),
                   F.lit("labels").alias("FEATURE"),
                   F.array(F.col("event_type"), F.concat(F.lit("k"), (dt.prop_k() % 3).cast("string"))).alias("VALUE"))
    w = window_join(lm, b, "CPR_hash", "TIMESTAMP", F.col("start"), F.col("end"), carry=["PID"]).drop("CPR_hash")
    return map_concept(w, b, CFG, is_categorical=True, is_multi_label=True)


register("a6_bin_multilabel", W(dt.SQL_ADT, SQL_BASE, sql_bins()) + f""",
lm AS (SELECT DISTINCT b.PID, e.ts AS "TIMESTAMP", unnest([e.event_type, 'k' || CAST({dt.SQL_K} % 3 AS VARCHAR)]) AS v
       FROM events e JOIN base b ON CAST(e.user_id AS VARCHAR) = b.CPR_hash AND e.ts >= b.start AND e.ts <= b."end"),
agg AS (SELECT DISTINCT l.PID, bn.bin_counter, 'labels' AS FEATURE, l.v AS VALUE FROM lm l
        JOIN bins bn ON l.PID = bn.PID AND l."TIMESTAMP" >= bn.bin_start AND l."TIMESTAMP" < bn.bin_end)
SELECT bn.PID, bn.bin_start, bn.bin_end, bn.bin_counter, bn.bin_freq, a.FEATURE, a.VALUE
FROM bins bn LEFT JOIN agg a ON bn.PID = a.PID AND bn.bin_counter = a.bin_counter""")(a6_bin_multilabel)


# ---------------------------------------------------------------------------
# Idealised steps, step times and labels
# ---------------------------------------------------------------------------
def d6_d7_steps(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    lm = windowed_long(spark, sf, b)
    d = lm.select("PID", "TIMESTAMP", "FEATURE",
                  time_to_step(micros_between(F.col("start"), F.col("TIMESTAMP")), "us", BINS).alias("step"))
    d = d.withColumn("step_min", step_to_time(F.col("step"), BINS))
    return d.select("PID", "TIMESTAMP", "FEATURE", "step", "step_min",
                    codes.step_label(F.col("step_min"), F.col("step")).alias("label"),
                    codes.hours_label(F.col("step_min")).alias("short_label"))


# Oracle of the step grid, derived in SQL from the configured texts alone.
def sql_step_ranges() -> str:
    rows = ", ".join(f"({i}, '{e}', '{f}')" for i, (e, f) in enumerate(BINS.items()))

    def minutes(c):
        return (f"CAST(regexp_extract({c}, '[0-9]+') AS BIGINT) * CASE WHEN {c} LIKE '%min' THEN 1 WHEN {c} LIKE '%h' THEN 60 "
                f"ELSE 1440 END")
    return f"""cfg(i, e, f) AS (VALUES {rows}),
mins AS (SELECT i, CASE WHEN e <> 'end' THEN {minutes('e')} END AS hi, {minutes('f')} AS size FROM cfg),
lows AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY i), 0) AS lo FROM mins),
ranges AS (SELECT *, coalesce(sum((hi - lo) // size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_step,
                  max(i) OVER () AS last_i FROM lows)"""


def _sql_steps() -> str:
    t = "(date_diff('microsecond', b.start, w.\"TIMESTAMP\") / 60000000.0)"
    return W(dt.SQL_ADT, SQL_BASE, SQL_WLONG, sql_step_ranges()) + f""",
timed AS (SELECT w.PID, w."TIMESTAMP", w.FEATURE, {t} AS t FROM wlong w JOIN base b ON w.PID = b.PID),
s1 AS (SELECT PID, "TIMESTAMP", FEATURE,
              CASE WHEN t <= 0 THEN 0 ELSE CAST(first_step + ceil((t - lo) / size) - 1 AS BIGINT) END AS step
       FROM timed LEFT JOIN ranges ON t > lo AND (hi IS NULL OR t <= hi)),
s2 AS (SELECT s1.*, CASE WHEN r.i < r.last_i THEN CAST(r.lo + (step - r.first_step + 1) * r.size AS DOUBLE) END AS step_min
       FROM s1 LEFT JOIN ranges r ON step >= r.first_step
            AND step < r.first_step + coalesce((r.hi - r.lo) // r.size, 9223372036854775807 - r.first_step))
SELECT PID, "TIMESTAMP", FEATURE, step, step_min,
  CASE WHEN step_min IS NULL THEN 'Step ' || CAST(step AS VARCHAR)
       WHEN step_min < 60 THEN CAST(CAST(step_min AS BIGINT) AS VARCHAR) || ' min'
       WHEN step_min < 1440 THEN (CASE WHEN step_min / 60 = floor(step_min / 60) THEN CAST(CAST(step_min / 60 AS BIGINT) AS VARCHAR)
                                       ELSE CAST(step_min / 60 AS VARCHAR) END) || ' h'
       ELSE (CASE WHEN step_min / 1440 = floor(step_min / 1440) THEN CAST(CAST(step_min / 1440 AS BIGINT) AS VARCHAR)
                  ELSE CAST(step_min / 1440 AS VARCHAR) END) || CASE WHEN step_min / 1440 = 1 THEN ' day' ELSE ' days' END
  END AS label,
  CASE WHEN step_min IS NULL THEN 'N/A'
       WHEN step_min / 60 < 24 THEN printf('%.1f', round_even(step_min / 60, 1)) || 'h'
       ELSE printf('%.1f', round_even(step_min / 60 / 24, 1)) || 'd' END AS short_label
FROM s2"""


register("d6_d7_steps", _sql_steps())(d6_d7_steps)


def d8_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """D8 steps, and how many events of the table lie at or before each step's right edge."""
    steps = time_thresholds(spark, BINS).withColumn("step_min", step_to_time(F.col("step"), BINS))
    b = base(spark, sf)
    lm = windowed_long(spark, sf, b)
    per = lm.select(time_to_step(micros_between(F.col("start"), F.col("TIMESTAMP")), "us", BINS).alias("s")).groupBy("s").count()
    # both sides are as small as the grid; steps are joined by range over per-step counts
    j = steps.join(per, F.col("s") <= F.col("step"), "left")
    return j.groupBy("step", "step_min").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("n_events"))


register("d8_thresholds", W(dt.SQL_ADT, SQL_BASE, SQL_WLONG, sql_step_ranges()) + """,
times AS (SELECT unnest(range(1, 73)) * 60 AS t UNION ALL SELECT unnest(range(4, 31)) * 1440),
steps AS (SELECT DISTINCT CAST(first_step + ceil((t - lo) / size) - 1 AS BIGINT) AS step
          FROM times JOIN ranges ON t > lo AND (hi IS NULL OR t <= hi)),
edges AS (SELECT step, CASE WHEN r.i < r.last_i THEN CAST(r.lo + (step - r.first_step + 1) * r.size AS DOUBLE) END AS step_min
          FROM steps JOIN ranges r ON step >= r.first_step
               AND step < r.first_step + coalesce((r.hi - r.lo) // r.size, 9223372036854775807 - r.first_step)),
timed AS (SELECT date_diff('microsecond', b.start, w."TIMESTAMP") / 60000000.0 AS t FROM wlong w JOIN base b ON w.PID = b.PID),
ev AS (SELECT CASE WHEN t <= 0 THEN 0 ELSE CAST(first_step + ceil((t - lo) / size) - 1 AS BIGINT) END AS s
       FROM timed LEFT JOIN ranges ON t > lo AND (hi IS NULL OR t <= hi))
SELECT e.step, e.step_min, count(ev.s) AS n_events FROM edges e LEFT JOIN ev ON ev.s <= e.step GROUP BY ALL""")(d8_thresholds)


# ---------------------------------------------------------------------------
# Mortality masking of the trajectory end
# ---------------------------------------------------------------------------
def d9_mask_mortality(spark: SparkSession, sf: str) -> DataFrame:
    b = _base_with_dod(spark, sf)
    pct = mask_mortality(b, "percentage").select("PID", F.col("end").alias("end_pct"),
                                                 F.col("hours_removed").alias("hours_removed_pct"))
    ab = mask_mortality(b, "absolute").select("PID", F.col("end").alias("end_abs"))
    return pct.join(ab, "PID")


register("d9_mask_mortality", W(dt.SQL_ADT, dt.SQL_PINFO, SQL_BASE_DOD) + """,
d AS (SELECT *, date_diff('microsecond', start, "end") AS dur, date_diff('microsecond', start, "end") / 3600000000.0 AS h
      FROM based),
m AS (SELECT PID, start, "end", DOD,
        CASE WHEN DOD IS NULL THEN "end"
             WHEN h <= 6 THEN start + to_microseconds(CAST(round(dur * 0.9) AS BIGINT))
             WHEN h <= 72 THEN start + to_microseconds(CAST(round(dur * 0.95) AS BIGINT))
             ELSE start + to_microseconds(CAST(round(dur * 0.98) AS BIGINT)) END AS p,
        CASE WHEN DOD IS NULL THEN "end"
             WHEN h < 3 THEN DOD - INTERVAL 10 MINUTE
             WHEN h <= 72 THEN DOD - INTERVAL 30 MINUTE
             WHEN h <= 168 THEN DOD - INTERVAL 3 HOUR
             ELSE DOD - INTERVAL 1 DAY END AS a
      FROM d),
r AS (SELECT PID, "end", DOD,
        CASE WHEN DOD IS NOT NULL AND p <= start + INTERVAL 30 MINUTE THEN start + INTERVAL 30 MINUTE ELSE p END AS end_pct,
        CASE WHEN DOD IS NOT NULL AND a <= start + INTERVAL 30 MINUTE THEN start + INTERVAL 30 MINUTE ELSE a END AS end_abs
      FROM m)
SELECT PID, end_pct, CASE WHEN DOD IS NOT NULL THEN date_diff('microsecond', end_pct, "end") / 3600000000.0 END
       AS hours_removed_pct, end_abs
FROM r""")(d9_mask_mortality)


# ---------------------------------------------------------------------------
# Numeric wide aggregates per patient
# ---------------------------------------------------------------------------
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
WIDE_AGGS = ["first", "last", "min", "max", "mean", "std", "count", "median"]


def a1_numeric_wide(spark: SparkSession, sf: str) -> DataFrame:
    lm = dt.long_model(dt.read(spark, sf, "events"))
    wide, names = numeric_wide(lm, "events", WIDE_AGGS, EVENT_TYPES)
    return wide.select("PID", *[r6(n).alias(n) for n in names])


def _sql_a1() -> str:
    fn = {"first": 'arg_min(value, ts)', "last": 'arg_max(value, ts)', "min": "min(value)", "max": "max(value)",
          "mean": "avg(value)", "std": "stddev_samp(value)", "count": "CAST(count(value) AS DOUBLE)",
          "median": "median(value)"}
    cols = []
    for f in EVENT_TYPES:
        for a in WIDE_AGGS:
            agg = fn[a].replace("(value", "(value").replace(")", f") FILTER (WHERE event_type = '{f}')", 1)
            cols.append(f"round(coalesce({agg}, 0.0), 6) AS {f}_events_{a}")
    return "SELECT user_id AS PID, " + ", ".join(cols) + " FROM events GROUP BY user_id"


register("a1_numeric_wide", _sql_a1())(a1_numeric_wide)


def a1_group_median(spark: SparkSession, sf: str) -> DataFrame:
    """Median and row count per event type: groups of a fifth of all rows, selected by counting over all tasks."""
    lm = dt.long_model(dt.read(spark, sf, "events"))
    return exact_median(lm, ["FEATURE"], "VALUE", hot=100).select("FEATURE", "median")


register("a1_group_median", "SELECT event_type AS FEATURE, median(value) AS median FROM events WHERE value IS NOT NULL GROUP BY event_type")(
    a1_group_median)


def a3_categorical_wide(spark: SparkSession, sf: str) -> DataFrame:
    lm = dt.long_model(dt.read(spark, sf, "events")).withColumn("VALUE", F.col("FEATURE"))
    wide, _, _ = categorical_wide(lm, "events", EVENT_TYPES)
    return wide


register("a3_categorical_wide", "SELECT user_id AS PID, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE event_type = '{v}') > 0 AS BIGINT) AS {v}_events_given, "
    f"CAST(count(*) FILTER (WHERE event_type = '{v}') AS BIGINT) AS {v}_events_count" for v in EVENT_TYPES)
    + " FROM events GROUP BY user_id")(a3_categorical_wide)


# ---------------------------------------------------------------------------
# First contact and first hospital
# ---------------------------------------------------------------------------
def k6_first_contacts(spark: SparkSession, sf: str) -> DataFrame:
    from .cohort import add_first_hospital
    b = base(spark, sf).withColumn("ServiceDate", F.date_trunc("day", "start").cast("timestamp_ntz"))
    a = dt.adt(dt.read(spark, sf, "events"))
    out = add_first_hospital(add_first_contacts(b, a))
    return out.select("PID", "first_afsnit", "first_RH", "FIRST_HOSPITAL",
                      (F.expr(micros_sql("start", "first_RH")) / 6e7).alias("time_to_RH_min"))


register("k6_first_contacts", W(dt.SQL_ADT, SQL_BASE) + f""",
inside AS (SELECT b.PID, b.start, a.Afsnit, a.Flyt_ind FROM base b JOIN adt a ON a.CPR_hash = b.CPR_hash
           AND a.Flyt_ind >= b.start AND a.Flyt_ind <= b."end"),
f AS (SELECT PID, first(Afsnit ORDER BY Flyt_ind, Afsnit) FILTER (WHERE Afsnit IS NOT NULL) AS fa,
             min(Flyt_ind) FILTER (WHERE regexp_matches(Afsnit, '(?i)RH ')) AS first_RH
      FROM inside GROUP BY PID),
g AS (SELECT b.PID, b.start, replace(f.fa, ',', '') AS first_afsnit, f.first_RH FROM base b LEFT JOIN f ON b.PID = f.PID),
w AS (SELECT *, string_split_regex(trim(first_afsnit), '\\s+') AS words FROM g),
fw AS (SELECT *, CASE WHEN first_afsnit IS NULL THEN NULL WHEN words[1] = 'SJ' THEN array_to_string(words[1:2], ' ')
                      ELSE words[1] END AS fh FROM w)
SELECT PID, first_afsnit, first_RH,
       CASE WHEN fh IS NULL THEN NULL
            WHEN starts_with(upper(fh), 'SJ HOL') THEN 'SJ HOLBÆK'
            WHEN starts_with(upper(fh), 'SJ ROS') THEN 'SJ ROSKILDE'
            WHEN upper(fh) IN ({', '.join(repr(h.upper()) for h in codes.VALID_HOSPITALS)}) THEN upper(fh)
            ELSE 'MISC' END AS FIRST_HOSPITAL,
       date_diff('microsecond', start, first_RH) / 60000000.0 AS time_to_RH_min
FROM fw""")(k6_first_contacts)


# ---------------------------------------------------------------------------
# Cutoff mask (24 h after start)
# ---------------------------------------------------------------------------
def p9_mask_after(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    lm = windowed_long(spark, sf, b)
    return mask_after(lm, b, "24h").select("PID", "TIMESTAMP", "FEATURE")


register("p9_mask_after", W(dt.SQL_ADT, SQL_BASE, SQL_WLONG) + """
SELECT w.PID, w."TIMESTAMP", w.FEATURE FROM wlong w JOIN base b ON w.PID = b.PID
WHERE w."TIMESTAMP" <= b.start + INTERVAL 24 HOUR""")(p9_mask_after)


# ---------------------------------------------------------------------------
# A4 on a placed frame: per-bin count and sum without the bin join
# ---------------------------------------------------------------------------
def a4_bin_count(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    placed = assign_points(windowed_long(spark, sf, b), b, BINS)
    return bin_aggregate(placed, "count").withColumn("VALUE", r6("VALUE"))


register("a4_bin_count", W(dt.SQL_ADT, SQL_BASE, SQL_WLONG, sql_bins()) + """
SELECT w.PID, bn.bin_counter, w.FEATURE, CAST(count(w.VALUE) AS DOUBLE) AS VALUE FROM wlong w
JOIN bins bn ON w.PID = bn.PID AND w."TIMESTAMP" >= bn.bin_start AND w."TIMESTAMP" < bn.bin_end
GROUP BY w.PID, bn.bin_counter, w.FEATURE""")(a4_bin_count)


# ---------------------------------------------------------------------------
# A raw concept table to the binned store in one call, and back
# ---------------------------------------------------------------------------
def k20_map_concepts(spark: SparkSession, sf: str) -> DataFrame:
    b = cut_lineage(base(spark, sf))
    labs = filter_by_time_window(b, dt.labs_raw(dt.read(spark, sf, "events")), "Prøvetagningstidspunkt", offset_days=0)
    root = f"{ensure_checkpoint_dir(spark)}/k20-{uuid.uuid4().hex}"
    cfg = {"bin_intervals": BINS, "agg_func": {"Labsvar": ["mean", "count"]}}
    map_concepts({"Labsvar": labs}, b, cfg, out_root=root)
    stored = get_concept(read_binned(spark, root), "Labsvar", ["mean", "count"])
    mean, count = (stored[a].select("PID", "bin_counter", "FEATURE", r6("VALUE").alias("VALUE"), F.lit(a).alias("agg_func"))
                   for a in ("mean", "count"))
    return mean.unionByName(count)


register("k20_map_concepts", W(dt.SQL_ADT, SQL_BASE, dt.SQL_LABS, sql_bins()) + f""",
lw AS (SELECT DISTINCT l.*, b.PID FROM labs_raw l JOIN base b ON l.CPR_hash = b.CPR_hash
       AND l."Prøvetagningstidspunkt" >= b.start AND l."Prøvetagningstidspunkt" <= b."end"),
lc AS (SELECT PID, "Prøvetagningstidspunkt" AS t, BestOrd, replace(replace("Resultatværdi", ',', '.'), '*', '') AS raw FROM lw),
lk AS (SELECT PID, t, CASE BestOrd {_LAB_MAP_SQL} ELSE BestOrd END AS f, regexp_replace(raw, '[*<>]', '', 'g') AS r FROM lc
       WHERE raw IS NOT NULL AND regexp_matches(raw, '[0-9]') AND BestOrd IN ({_LAB_INCLUDE})),
lv AS (SELECT PID, t, f, TRY_CAST(trim(r) AS DOUBLE) AS v FROM lk WHERE regexp_matches(r, '{_NUM_RE}')),
placed AS (SELECT lv.PID, bn.bin_counter, f, v FROM lv JOIN bins bn ON lv.PID = bn.PID AND t >= bn.bin_start AND t < bn.bin_end
           WHERE v IS NOT NULL)
SELECT PID, bin_counter, f AS FEATURE, round(avg(v), 6) AS VALUE, 'mean' AS agg_func FROM placed GROUP BY PID, bin_counter, f
UNION ALL
SELECT PID, bin_counter, f, CAST(count(v) AS DOUBLE), 'count' FROM placed GROUP BY PID, bin_counter, f""")(k20_map_concepts)


# ---------------------------------------------------------------------------
# Three concepts, all their aggregates, one pass each
# ---------------------------------------------------------------------------
NUMERIC = ["first", "last", "mean", "max", "min", "std", "sum", "count"]
K20_CONCEPTS = {"events": NUMERIC, "Steps": ["mode", "first", "last"], "Kinds": ["last"]}


def k20_all_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    """Values (all numeric aggregates), event types as categories (mode, first, last) and as a multi-label
    concept, each placed once; stored by concept and aggregate and read back, then asked for again."""
    b = cut_lineage(base(spark, sf))
    lm = cut_lineage(windowed_long(spark, sf, b))
    steps = lm.select("PID", "TIMESTAMP", F.lit("step").alias("FEATURE"), F.col("FEATURE").alias("VALUE"))
    concepts = {"events": lm, "Steps": steps, "Kinds": steps.withColumn("VALUE", F.array("VALUE", F.lit("any")))}
    root = f"{ensure_checkpoint_dir(spark)}/k20-{uuid.uuid4().hex}"
    cfg = {"bin_intervals": BINS, "agg_func": K20_CONCEPTS,
           "dataset": {"ts_cat_names": ["Steps", "Kinds"], "ts_categorical_multi_label": ["Kinds"]}}
    map_concepts(concepts, b, cfg, out_root=root)
    again = map_concepts(concepts, b, cfg, out_root=root)  # nothing has changed: read back by their records
    out = None
    for (concept, agg), df in again.items():
        text = F.round(F.col("VALUE").cast("double"), 6).cast("string") if concept == "events" else F.col("VALUE")
        d = df.where(F.col("FEATURE").isNotNull()).select(F.lit(concept).alias("concept"), F.lit(agg).alias("agg_func"), "PID",
                                                          "bin_counter", "FEATURE", text.alias("VALUE"))
        out = d if out is None else out.unionByName(d)
    return out.withColumn("NUMBER", F.when(F.col("concept") == "events", F.col("VALUE").cast("double"))).withColumn(
        "VALUE", F.when(F.col("concept") != "events", F.col("VALUE")))


def _sql_k20_all() -> str:
    fn = {"first": "arg_min(VALUE, {o})", "last": "arg_max(VALUE, {o})", "mean": "avg(VALUE)", "max": "max(VALUE)", "min": "min(VALUE)",
          "std": "stddev_samp(VALUE)", "sum": "sum(VALUE)", "count": "CAST(count(VALUE) AS DOUBLE)"}
    order = "struct_pack(t := \"TIMESTAMP\", v := VALUE)"
    numeric = " UNION ALL ".join(
        f"SELECT 'events' AS concept, '{a}' AS agg_func, PID, bin_counter, FEATURE, CAST(NULL AS VARCHAR) AS VALUE, "
        f"round({fn[a].format(o=order)}, 6) AS NUMBER FROM placed GROUP BY PID, bin_counter, FEATURE" for a in NUMERIC)
    pick = {"first": "arg_min(FEATURE, struct_pack(t := \"TIMESTAMP\", v := FEATURE))",
            "last": "arg_max(FEATURE, struct_pack(t := \"TIMESTAMP\", v := FEATURE))"}
    texts = " UNION ALL ".join(
        f"SELECT 'Steps', '{a}', PID, bin_counter, 'step', {pick[a]}, NULL FROM placed GROUP BY PID, bin_counter" for a in pick)
    return W(dt.SQL_ADT, SQL_BASE, SQL_WLONG, sql_bins()) + f""",
placed AS (SELECT w.PID, bn.bin_counter, w.FEATURE, w."TIMESTAMP", w.VALUE FROM wlong w
           JOIN bins bn ON w.PID = bn.PID AND w."TIMESTAMP" >= bn.bin_start AND w."TIMESTAMP" < bn.bin_end),
modes AS (SELECT PID, bin_counter, FEATURE, row_number() OVER (PARTITION BY PID, bin_counter ORDER BY count(*) DESC, FEATURE) AS rn
          FROM placed GROUP BY PID, bin_counter, FEATURE)
SELECT * FROM ({numeric} UNION ALL {texts}
UNION ALL SELECT 'Steps', 'mode', PID, bin_counter, 'step', FEATURE, NULL FROM modes WHERE rn = 1
UNION ALL SELECT DISTINCT 'Kinds', 'last', PID, bin_counter, 'step', FEATURE, CAST(NULL AS DOUBLE) FROM placed
UNION ALL SELECT DISTINCT 'Kinds', 'last', PID, bin_counter, 'step', 'any', CAST(NULL AS DOUBLE) FROM placed)
WHERE VALUE IS NOT NULL OR NUMBER IS NOT NULL"""


register("k20_all_aggregates", _sql_k20_all())(k20_all_aggregates)


# ---------------------------------------------------------------------------
# G1 (general): a grid whose bin sizes shrink -- segments folded per trajectory
# ---------------------------------------------------------------------------
GENERAL_BINS = {"1h": "20min", "3h": "5min", "2D": "2h", "end": "1D"}


def g1_general_grid_mean(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    out = map_concept(windowed_long(spark, sf, b), b, {"bin_intervals": GENERAL_BINS}, agg_func="mean")
    return out.withColumn("VALUE", r6("VALUE"))


register("g1_general_grid_mean", W(dt.SQL_ADT, SQL_BASE, SQL_WLONG, sql_bins(GENERAL_BINS)) + """,
placed AS (SELECT w.PID, bn.bin_counter, w.FEATURE, w.VALUE FROM wlong w
           JOIN bins bn ON w.PID = bn.PID AND w."TIMESTAMP" >= bn.bin_start AND w."TIMESTAMP" < bn.bin_end),
agg AS (SELECT PID, bin_counter, FEATURE, avg(VALUE) AS VALUE FROM placed GROUP BY PID, bin_counter, FEATURE)
SELECT bn.PID, bn.bin_start, bn.bin_end, bn.bin_counter, bn.bin_freq, a.FEATURE, round(a.VALUE, 6) AS VALUE
FROM bins bn LEFT JOIN agg a ON bn.PID = a.PID AND bn.bin_counter = a.bin_counter
WHERE NOT (a.FEATURE IS NOT NULL AND a.VALUE IS NULL)""")(g1_general_grid_mean)
