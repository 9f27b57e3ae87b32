"""Registered queries, part 2: scans, filters, scalars, ordered operators
and joins on the driver tables (see ``catalog`` for the conventions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.numeric import lab_clean, numeric_or_null, parse_numeric
from ..functions.timefns import age_years, days_between, event_within_days, micros_sql
from ..operators.filters import keyword_flags, member_filter, prefix_filter
from ..operators.joins import (filter_by_time_window, lookback_join, match_trajectories, nearest_in_time,
                               semi_join_ids)
from ..operators.ordered import dense_rank_global
from ..operators.trajectories import admission_counter, fill_missing_end, overlap_with_next
from . import driver_tables as dt
from .catalog import SQL_BASE, SQL_TRAJ, base, r6, register, trajectories
from .concepts import filter_labs

W = dt.with_sql


# ---------------------------------------------------------------------------
# Long model scan
# ---------------------------------------------------------------------------
def s1_long_model(spark: SparkSession, sf: str) -> DataFrame:
    return dt.long_model(dt.read(spark, sf, "events"))


register("s1_long_model", """
SELECT user_id AS PID, ts AS "TIMESTAMP", event_type AS FEATURE, value AS VALUE FROM events""")(s1_long_model)


# ---------------------------------------------------------------------------
# K1 / P2 + S4 / J1: population seed and population-restricted load
# ---------------------------------------------------------------------------
def s4_population_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    ev = dt.read(spark, sf, "events")
    pop = prefix_filter(dt.procedures(ev), "ProcedureCode", "KJJ")
    return semi_join_ids(dt.adt(ev), pop, "CPR_hash").select("event_id", "CPR_hash", "Flyt_ind")


register("s4_population_semi_join", W(dt.SQL_PROC, dt.SQL_ADT) + """
SELECT event_id, CPR_hash, Flyt_ind FROM adt
WHERE CPR_hash IN (SELECT CPR_hash FROM proc WHERE starts_with(ProcedureCode, 'KJJ'))""")(s4_population_semi_join)


def s5_lineitem_population(spark: SparkSession, sf: str) -> DataFrame:
    """Population of urgent orders; all their line items (large-table S5)."""
    orders = prefix_filter(dt.read(spark, sf, "orders"), "o_orderpriority", "1-")
    li = dt.read(spark, sf, "lineitem")
    return semi_join_ids(li, orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey") \
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


register("s5_lineitem_population", """
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, '1-'))""")(s5_lineitem_population)


# ---------------------------------------------------------------------------
# Membership and exclusion (null-safe)
# ---------------------------------------------------------------------------
def p3_p4_membership(spark: SparkSession, sf: str) -> DataFrame:
    labs = dt.labs_raw(dt.read(spark, sf, "events"))
    kept = member_filter(labs, "BestOrd", sorted(codes.LABS_REVERSE_MAP))
    kept = member_filter(kept, "BestOrd", ["TEG-R"], keep=False)
    return kept.select("event_id", "BestOrd")


_LAB_INCLUDE = ", ".join("'" + x + "'" for x in sorted(codes.LABS_REVERSE_MAP))
register("p3_p4_membership", W(dt.SQL_LABS) + f"""
SELECT event_id, BestOrd FROM labs_raw
WHERE BestOrd IN ({_LAB_INCLUDE}) AND (BestOrd IS NULL OR BestOrd NOT IN ('TEG-R'))""")(p3_p4_membership)


# ---------------------------------------------------------------------------
# C4 (+P5, X10, X7, N2): lab normaliser
# ---------------------------------------------------------------------------
def c4_labs(spark: SparkSession, sf: str) -> DataFrame:
    labs = dt.labs_raw(dt.read(spark, sf, "events")).withColumn("PID", F.col("CPR_hash").cast("bigint"))
    out = filter_labs(labs)
    return out.select("event_id", "PID", "TIMESTAMP", "FEATURE", r6("VALUE").alias("VALUE"))


_NUM_RE = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
_LAB_MAP_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.LABS_REVERSE_MAP.items())
register("c4_labs", W(dt.SQL_LABS) + f""",
cleaned AS (
  SELECT event_id, CAST(CPR_hash AS BIGINT) AS PID, "Prøvetagningstidspunkt" AS "TIMESTAMP", BestOrd,
         replace(replace("Resultatværdi", ',', '.'), '*', '') AS v
  FROM labs_raw),
kept AS (
  SELECT *, regexp_replace(v, '[*<>]', '', 'g') AS v2 FROM cleaned
  WHERE v IS NOT NULL AND regexp_matches(v, '[0-9]') AND BestOrd IN ({_LAB_INCLUDE}))
SELECT event_id, PID, "TIMESTAMP", CASE BestOrd {_LAB_MAP_SQL} ELSE BestOrd END AS FEATURE,
       round(TRY_CAST(trim(v2) AS DOUBLE), 6) AS VALUE
FROM kept WHERE regexp_matches(v2, '{_NUM_RE}') AND TRY_CAST(trim(v2) AS DOUBLE) IS NOT NULL""")(c4_labs)


# ---------------------------------------------------------------------------
# Numeric text parsing
# ---------------------------------------------------------------------------
def x9_x10_parse(spark: SparkSession, sf: str) -> DataFrame:
    labs = dt.labs_raw(dt.read(spark, sf, "events"))
    t = F.col("Resultatværdi")
    return labs.select("event_id", r6(parse_numeric(t)).alias("parsed"),
                       r6(numeric_or_null(lab_clean(t))).alias("cleaned"))


register("x9_x10_parse", W(dt.SQL_LABS) + f""",
p AS (SELECT event_id, regexp_replace(trim("Resultatværdi"), '^[<>]\\s*', '') AS a,
             regexp_replace(replace("Resultatværdi", ',', '.'), '[*<>]', '', 'g') AS b FROM labs_raw)
SELECT event_id,
       round(CASE WHEN regexp_matches(a, '{_NUM_RE}') THEN TRY_CAST(trim(a) AS DOUBLE) END, 6) AS parsed,
       round(CASE WHEN regexp_matches(b, '{_NUM_RE}') THEN TRY_CAST(trim(b) AS DOUBLE) END, 6) AS cleaned
FROM p""")(x9_x10_parse)


# ---------------------------------------------------------------------------
# Department class and first hospital
# ---------------------------------------------------------------------------
def x1_x4_departments(spark: SparkSession, sf: str) -> DataFrame:
    a = dt.adt(dt.read(spark, sf, "events"))
    c = F.col("Afsnit")
    return a.select("event_id", "Afsnit", codes.classify(c).alias("dept_class"),
                    codes.first_hospital(F.regexp_replace(c, ",", "")).alias("first_word"),
                    codes.derive_first_hospital(c).alias("hospital"))


def _sql_classify(col: str) -> str:
    whens = []
    for label, pats in codes.ADT_RULES:
        conds = []
        simple = [p for p in pats if isinstance(p, str)]
        if simple:
            conds.append(f"regexp_matches({col}, '(?i)(?:{'|'.join(simple)})')")
        for p in pats:
            if isinstance(p, tuple):
                conds.append("(" + " AND ".join(f"regexp_matches({col}, '(?i){q}')" for q in p) + ")")
        whens.append(f"WHEN {' OR '.join(conds)} THEN '{label}'")
    return f"CASE WHEN {col} IS NULL OR {col} = '' THEN NULL {' '.join(whens)} END"


_VALID = ", ".join(f"'{h.upper()}'" for h in codes.VALID_HOSPITALS)
register("x1_x4_departments", W(dt.SQL_ADT) + f""",
w AS (SELECT event_id, Afsnit, string_split_regex(trim(replace(Afsnit, ',', '')), '\\s+') AS words FROM adt),
fw AS (SELECT *, CASE WHEN words[1] = 'SJ' THEN array_to_string(words[1:2], ' ') ELSE words[1] END AS first_word FROM w)
SELECT event_id, Afsnit, {_sql_classify('Afsnit')} AS dept_class, first_word,
       CASE WHEN Afsnit IS NULL OR trim(Afsnit) = '' THEN NULL
            WHEN starts_with(upper(first_word), 'SJ HOL') THEN 'SJ HOLBÆK'
            WHEN starts_with(upper(first_word), 'SJ ROS') THEN 'SJ ROSKILDE'
            WHEN upper(first_word) IN ({_VALID}) THEN upper(first_word)
            ELSE 'MISC' END AS hospital
FROM fw""")(x1_x4_departments)


# ---------------------------------------------------------------------------
# ATC categories and the medication normaliser
# ---------------------------------------------------------------------------
def c6_medication(spark: SparkSession, sf: str) -> DataFrame:
    from .concepts import filter_medicin
    m = filter_medicin(dt.medication(dt.read(spark, sf, "events")))
    return m.select("event_id", "PID", "TIMESTAMP", "FEATURE", "VALUE", "ATC",
                    codes.classify_atc(F.col("ATC")).alias("atc_category"))


def _sql_map(col: str, mapping: dict) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


_ACTIONS = ", ".join("'" + a + "'" for a in codes.MEDICATION_ACTION_LIST)
register("c6_medication", W(dt.SQL_MED) + f""",
adm AS (SELECT * FROM med WHERE Handling IN ({_ACTIONS})),
lv AS (
  SELECT event_id, PID, ATC, Administrationstidspunkt, {_sql_map('substr(ATC, 1, 3)', codes.ATC_LVL3_REVERSE)} AS cat FROM adm
  UNION
  SELECT event_id, PID, ATC, Administrationstidspunkt, {_sql_map('substr(ATC, 1, 4)', codes.ATC_LVL4_REVERSE)} AS cat FROM adm)
SELECT event_id, PID, Administrationstidspunkt AS "TIMESTAMP", 'medication' AS FEATURE, cat AS VALUE, ATC,
       coalesce({_sql_map('substr(ATC, 1, 3)', codes.ATC_LVL3_REVERSE)},
                {_sql_map('substr(ATC, 1, 4)', codes.ATC_LVL4_REVERSE)}) AS atc_category
FROM lv WHERE cat IS NOT NULL""")(c6_medication)


# ---------------------------------------------------------------------------
# X11: diagnosis code stripping
# ---------------------------------------------------------------------------
def x11_code_strip(spark: SparkSession, sf: str) -> DataFrame:
    d = dt.diagnoses(dt.read(spark, sf, "events"))
    return d.select("event_id", "Diagnosekode", codes.strip_code_ends(F.col("Diagnosekode")).alias("icd10"))


register("x11_code_strip", W(dt.SQL_DIAG) + """
SELECT event_id, Diagnosekode, substr(Diagnosekode, 2, greatest(length(Diagnosekode) - 2, 0)) AS icd10 FROM diag""")(
    x11_code_strip)


# ---------------------------------------------------------------------------
# Static features of a customer cohort
# ---------------------------------------------------------------------------
def d4_d5_static(spark: SparkSession, sf: str) -> DataFrame:
    orders = dt.read(spark, sf, "orders")
    win = orders.groupBy(F.col("o_custkey").cast("string").alias("CPR_hash")).agg(
        F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    pi = dt.patient_info(dt.read(spark, sf, "customer"))
    j = win.join(pi, "CPR_hash", "inner")
    return j.select("CPR_hash", days_between(F.col("start"), F.col("end")).alias("DURATION"),
                    age_years(F.col("DOB"), F.col("start")).alias("AGE"),
                    event_within_days(F.col("DOD"), F.col("start"), 30).alias("DECEASED_30d"),
                    event_within_days(F.col("DOD"), F.col("start"), 90).alias("DECEASED_90d"),
                    codes.normalize_sex(F.col("SEX_RAW")).alias("SEX"))


register("d4_d5_static", W(dt.SQL_PINFO) + """,
win AS (SELECT CAST(o_custkey AS VARCHAR) AS CPR_hash, min(o_orderdate) AS start, max(o_orderdate) AS "end"
        FROM orders GROUP BY 1)
SELECT w.CPR_hash, date_diff('microsecond', start, "end") / 86400000000.0 AS DURATION,
       CAST(floor(floor(date_diff('microsecond', DOB, start) / 86400000000.0) / 365.25) AS BIGINT) AS AGE,
       CASE WHEN date_diff('microsecond', start, DOD) <= 30 * 86400000000 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS DECEASED_30d,
       CASE WHEN date_diff('microsecond', start, DOD) <= 90 * 86400000000 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS DECEASED_90d,
       CASE SEX_RAW WHEN 'Mand' THEN 'Male' WHEN 'Kvinde' THEN 'Female' WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female'
                    WHEN 'K' THEN 'Female' ELSE SEX_RAW END AS SEX
FROM win w JOIN pinfo p ON w.CPR_hash = p.CPR_hash""")(d4_d5_static)


# ---------------------------------------------------------------------------
# Running admission counter
# ---------------------------------------------------------------------------
def w1_admission_counter(spark: SparkSession, sf: str) -> DataFrame:
    a = dt.adt(dt.read(spark, sf, "events"))
    return admission_counter(a, tie_cols=["event_id"]).select("event_id", "CPR_hash", "trajectory")


register("w1_admission_counter", W(dt.SQL_ADT) + """,
n AS (SELECT event_id, CPR_hash,
             sum(CASE WHEN ADT_haendelse = 'Indlæggelse' THEN 1 ELSE 0 END)
               OVER (PARTITION BY CPR_hash ORDER BY Flyt_ind, event_id ROWS UNBOUNDED PRECEDING) AS c FROM adt)
SELECT event_id, CPR_hash, CASE WHEN c > 0 THEN CAST(c AS BIGINT) END AS trajectory FROM n""")(w1_admission_counter)


# ---------------------------------------------------------------------------
# Gap trajectories
# ---------------------------------------------------------------------------
def w2_k4_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    t = trajectories(spark, sf)
    return t.select("CPR_hash", "start", "end", "trajectory",
                    (F.expr(micros_sql("start", "end")) / 6e7).alias("duration_min"))


register("w2_k4_trajectories", W(dt.SQL_ADT, SQL_TRAJ) + """
SELECT CPR_hash, start, "end", trajectory, date_diff('microsecond', start, "end") / 60000000.0 AS duration_min
FROM traj""")(w2_k4_trajectories)


# ---------------------------------------------------------------------------
# Dense PID
# ---------------------------------------------------------------------------
def k11_dense_pid(spark: SparkSession, sf: str) -> DataFrame:
    p = dt.procedures(dt.read(spark, sf, "events"))
    return dense_rank_global(p, ["CPR_hash", "ServiceDate"]).select("event_id", "CPR_hash", "ServiceDate", "PID")


register("k11_dense_pid", W(dt.SQL_PROC) + """
SELECT event_id, CPR_hash, ServiceDate, CAST(dense_rank() OVER (ORDER BY CPR_hash, ServiceDate) AS BIGINT) AS PID
FROM proc""")(k11_dense_pid)


# ---------------------------------------------------------------------------
# Overlap with next trajectory
# ---------------------------------------------------------------------------
def w5_overlap(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    return overlap_with_next(b, "CPR_hash", tie_cols=["end"]).select("PID", "overlap")


register("w5_overlap", W(dt.SQL_ADT, SQL_BASE) + """
SELECT PID, coalesce("end" > lead(start) OVER (PARTITION BY CPR_hash ORDER BY start, "end"), false) AS overlap
FROM base""")(w5_overlap)


# ---------------------------------------------------------------------------
# Missing move-out filled from the next move-in
# ---------------------------------------------------------------------------
def w4_fill_end(spark: SparkSession, sf: str) -> DataFrame:
    a = dt.adt(dt.read(spark, sf, "events"))
    a = a.withColumn("Flyt_ud", F.when(F.col("event_id") % 7 != 0, F.col("Flyt_ud")))
    f = fill_missing_end(a, "CPR_hash", "Flyt_ind", "Flyt_ud", None, tie_cols=["event_id"])
    return f.select("event_id", "Flyt_ud")


register("w4_fill_end", W(dt.SQL_ADT) + """,
m AS (SELECT event_id, CPR_hash, Flyt_ind, CASE WHEN event_id % 7 <> 0 THEN Flyt_ud END AS ud FROM adt),
f AS (SELECT event_id, coalesce(ud, lead(Flyt_ind) OVER (PARTITION BY CPR_hash ORDER BY Flyt_ind, event_id)) AS Flyt_ud
      FROM m)
SELECT * FROM f WHERE Flyt_ud IS NOT NULL""")(w4_fill_end)


# ---------------------------------------------------------------------------
# Events in trajectory windows +-1 day
# ---------------------------------------------------------------------------
def j2_time_window(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    a = dt.adt(dt.read(spark, sf, "events"))
    return filter_by_time_window(b, a, "Flyt_ind", offset_days=1).select("event_id", "PID")


register("j2_time_window", W(dt.SQL_ADT, SQL_BASE) + """
SELECT DISTINCT a.event_id, b.PID FROM adt a JOIN base b ON a.CPR_hash = b.CPR_hash
 AND a.Flyt_ind >= b.start - INTERVAL 1 DAY AND a.Flyt_ind <= b."end" + INTERVAL 1 DAY""")(j2_time_window)


# ---------------------------------------------------------------------------
# Procedures matched to trajectories
# ---------------------------------------------------------------------------
def j3_trajectory_match(spark: SparkSession, sf: str) -> DataFrame:
    t = trajectories(spark, sf)
    p = dt.procedures(dt.read(spark, sf, "events"))
    return match_trajectories(t, p, "ServiceDate").select("event_id", "trajectory")


register("j3_trajectory_match", W(dt.SQL_ADT, SQL_TRAJ, dt.SQL_PROC) + """
SELECT DISTINCT p.event_id, t.trajectory FROM proc p JOIN traj t ON p.CPR_hash = t.CPR_hash
 AND p.ServiceDate >= t.start - INTERVAL 1 DAY AND p.ServiceDate <= t."end" + INTERVAL 1 DAY""")(j3_trajectory_match)


# ---------------------------------------------------------------------------
# Six-month look-back
# ---------------------------------------------------------------------------
def j4_lookback(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    d = dt.diagnoses(dt.read(spark, sf, "events"))
    return lookback_join(b, d, "Noteret_dato", months=6).select("event_id", "PID")


register("j4_lookback", W(dt.SQL_ADT, SQL_BASE, dt.SQL_DIAG) + """
SELECT DISTINCT d.event_id, b.PID FROM diag d JOIN base b ON d.CPR_hash = b.CPR_hash
 AND d.Noteret_dato >= b.start - INTERVAL 6 MONTH AND d.Noteret_dato <= b."end\"""")(j4_lookback)


# ---------------------------------------------------------------------------
# Nearest-in-time within 24 h
# ---------------------------------------------------------------------------
def j5_nearest(spark: SparkSession, sf: str) -> DataFrame:
    ev = dt.read(spark, sf, "events")
    p = dt.procedures(ev).select("CPR_hash", "ServiceDate").distinct()
    knife = ev.where(F.col("event_type") == "click").select(
        F.col("user_id").cast("string").alias("CPR_hash"), F.col("event_id").alias("Case_ID"),
        F.col("ts").alias("knife_time"))
    return nearest_in_time(p, knife, "CPR_hash", "ServiceDate", "knife_time", ["CPR_hash", "ServiceDate"],
                           tie_cols=["Case_ID"], right_cols=["Case_ID", "knife_time"])


register("j5_nearest", W(dt.SQL_PROC) + """,
p AS (SELECT DISTINCT CPR_hash, ServiceDate FROM proc),
k AS (SELECT CAST(user_id AS VARCHAR) AS CPR_hash, event_id AS Case_ID, ts AS knife_time FROM events
      WHERE event_type = 'click'),
c AS (SELECT p.CPR_hash, p.ServiceDate, k.Case_ID, k.knife_time,
             row_number() OVER (PARTITION BY p.CPR_hash, p.ServiceDate
                                ORDER BY abs(date_diff('microsecond', p.ServiceDate, k.knife_time)), k.knife_time, k.Case_ID) AS rn
      FROM p JOIN k ON p.CPR_hash = k.CPR_hash
       AND abs(date_diff('microsecond', p.ServiceDate, k.knife_time)) <= 86400000000)
SELECT p.CPR_hash, p.ServiceDate, c.Case_ID, c.knife_time FROM p
LEFT JOIN c ON p.CPR_hash = c.CPR_hash AND p.ServiceDate = c.ServiceDate AND c.rn = 1""")(j5_nearest)


# ---------------------------------------------------------------------------
# Keyword flags over whole document texts
# ---------------------------------------------------------------------------
KEYWORDS = ["license", "password", "secret", "copyright"]


def p12_keywords(spark: SparkSession, sf: str) -> DataFrame:
    docs = dt.read(spark, sf, "documents")
    f = keyword_flags(docs, "text", KEYWORDS, "flagged")
    return f.groupBy("lang").agg(F.count(F.lit(1)).cast("bigint").alias("n_docs"),
                                 F.sum(F.col("flagged").cast("bigint")).cast("bigint").alias("n_flagged"))


register("p12_keywords", f"""
SELECT lang, CAST(count(*) AS BIGINT) AS n_docs,
       CAST(sum(CASE WHEN coalesce(regexp_matches(text, '(?i)(?:{'|'.join(KEYWORDS)})'), false) THEN 1 ELSE 0 END) AS BIGINT)
         AS n_flagged
FROM documents GROUP BY lang""")(p12_keywords)


def p5_numeric_looking(spark: SparkSession, sf: str) -> DataFrame:
    conv = dt.read(spark, sf, "conversations")
    from ..functions.numeric import looks_numeric
    return conv.groupBy("role").agg(F.count(F.lit(1)).cast("bigint").alias("n_turns"),
                                    F.sum(looks_numeric(F.col("text")).cast("bigint")).cast("bigint").alias("n_numeric"))


register("p5_numeric_looking", """
SELECT role, CAST(count(*) AS BIGINT) AS n_turns,
       CAST(sum(CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END) AS BIGINT) AS n_numeric
FROM conversations GROUP BY role""")(p5_numeric_looking)
