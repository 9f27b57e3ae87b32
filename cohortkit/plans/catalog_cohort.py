"""Registered queries, part 4: normalisers, cohort steps, comorbidity,
splits, metrics, reshape and the wide dataset."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.timefns import micros_sql
from ..operators.aggregates import cohort_summary
from ..operators.joins import filter_by_time_window
from ..operators.reshape import category_labels, multi_hot_dense, multi_hot_transform, multi_hot_vocabulary
from ..session import ensure_checkpoint_dir
from . import driver_tables as dt
from .catalog import SQL_BASE, SQL_TRAJ, SQL_WLONG, base, r6, register, trajectories, windowed_long
from .catalog_bins import sql_step_ranges
from .catalog_ops import _sql_classify
from .cohort import add_case_knife_time, height_weight, match_population_to_trajectories
from .comorbidity import CHARLSON, CHARLSON_ZERO, ELIX_ZERO, ELIXHAUSER, add_comorbidity, expand
from .concepts import filter_adt, filter_ita, filter_labs, filter_medicin, filter_procedures, filter_vitals
from .features import AggregatedDataset, at_cutoffs, cutoff_features
from .evaluation import metrics_by_cutoff, predictions, store_predictions
from .metrics import _poisson_cdf, ap_interval, auroc_ap
from .split import stratified_folds, stratified_split, temporal_split

W = dt.with_sql


# ---------------------------------------------------------------------------
# Vitals normaliser
# ---------------------------------------------------------------------------
def c1_vitals(spark: SparkSession, sf: str) -> DataFrame:
    return filter_vitals(dt.vitals(dt.read(spark, sf, "events"))).select("PID", "TIMESTAMP", "FEATURE", "VALUE")


_NUM_RE = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def _sql_num(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{_NUM_RE}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


_BP = ", ".join(f"'{b}'" for b in codes.BP_TYPES)
_VMAP = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**codes.VITALS_MAP, **codes.HEIGHT_WEIGHT_MAP}.items())
_VKEEP = ", ".join(f"'{v}'" for v in sorted(set(codes.VITALS_MAP.values())))
register("c1_vitals", W(dt.SQL_VITALS) + f""",
v0 AS (SELECT PID, Registreringstidspunkt AS "TIMESTAMP", Vital_parametre AS FEATURE,
              CASE WHEN Vital_parametre = 'Temp.' THEN "Værdi_Omregnet" ELSE "Værdi" END AS VALUE FROM vit),
v1 AS (SELECT * FROM v0 WHERE FEATURE IS NULL OR FEATURE NOT IN ({_BP})
       UNION ALL
       SELECT PID, "TIMESTAMP", 'SBP', CAST({_sql_num("split_part(VALUE, '/', 1)")} AS VARCHAR) FROM v0 WHERE FEATURE IN ({_BP})
       UNION ALL
       SELECT PID, "TIMESTAMP", 'DBP',
              CAST(CASE WHEN strpos(VALUE, '/') > 0 THEN {_sql_num("substr(VALUE, strpos(VALUE, '/') + 1)")} END AS VARCHAR)
       FROM v0 WHERE FEATURE IN ({_BP})),
v2 AS (SELECT PID, "TIMESTAMP", CASE FEATURE {_VMAP} ELSE FEATURE END AS FEATURE, VALUE FROM v1)
SELECT * FROM v2 WHERE FEATURE IN ({_VKEEP}) AND VALUE IS NOT NULL AND regexp_matches(VALUE, '[0-9]')""")(c1_vitals)


# ---------------------------------------------------------------------------
# Procedures and ICU score normalisers
# ---------------------------------------------------------------------------
def c3_procedures(spark: SparkSession, sf: str) -> DataFrame:
    p = dt.procedures(dt.read(spark, sf, "events"))
    return filter_procedures(p, dt.PROCEDURE_CATEGORIES).select("event_id", "TIMESTAMP", "FEATURE", "VALUE")


_PCODES = ", ".join(f"'{c}'" for cs in dt.PROCEDURE_CATEGORIES.values() for c in cs)
register("c3_procedures", W(dt.SQL_PROC) + f"""
SELECT event_id, ServiceDatetime AS "TIMESTAMP", 'procedures' AS FEATURE, 'abdominal_major' AS VALUE
FROM proc WHERE ProcedureCode IN ({_PCODES})""")(c3_procedures)


def c5_ita(spark: SparkSession, sf: str) -> DataFrame:
    return filter_ita(dt.ita(dt.read(spark, sf, "events"))).select("event_id", "PID", "TIMESTAMP", "FEATURE", "VALUE")


register("c5_ita", W(dt.SQL_ITA) + f"""
SELECT event_id, PID, "Målingstidspunkt" AS "TIMESTAMP",
       CASE "ITAOversigt_Måling" {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.ICU_MAP.items())}
            ELSE "ITAOversigt_Måling" END AS FEATURE, "Værdi" AS VALUE FROM ita""")(c5_ita)


# ---------------------------------------------------------------------------
# ADT normaliser on windowed moves (interval concept)
# ---------------------------------------------------------------------------
def c7_adt(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    a = dt.adt(dt.read(spark, sf, "events")).withColumn(
        "Flyt_ud", F.when(F.col("event_id") % 7 != 0, F.col("Flyt_ud")))
    win = filter_by_time_window(b, a, "Flyt_ind", offset_days=0)
    out = filter_adt(win, b)
    return out.select("event_id", "PID", "TIMESTAMP", "END_TIMESTAMP", "VALUE")


register("c7_adt", W(dt.SQL_ADT, SQL_BASE) + f""",
w AS (SELECT DISTINCT a.event_id, a.CPR_hash, a.Flyt_ind, CASE WHEN a.event_id % 7 <> 0 THEN a.Flyt_ud END AS ud,
             a.Afsnit, b.PID, b."end" AS bend
      FROM adt a JOIN base b ON a.CPR_hash = b.CPR_hash AND a.Flyt_ind >= b.start AND a.Flyt_ind <= b."end"),
c AS (SELECT *, {_sql_classify('Afsnit')} AS VALUE
      FROM w),
k AS (SELECT * FROM c WHERE VALUE IS NOT NULL),
f AS (SELECT event_id, PID, Flyt_ind AS "TIMESTAMP",
             coalesce(ud, lead(Flyt_ind) OVER (PARTITION BY PID ORDER BY Flyt_ind), bend) AS "END_TIMESTAMP", VALUE FROM k)
SELECT * FROM f WHERE "END_TIMESTAMP" IS NOT NULL""")(c7_adt)


# ---------------------------------------------------------------------------
# Latest height and weight per PID
# ---------------------------------------------------------------------------
def k13_height_weight(spark: SparkSession, sf: str) -> DataFrame:
    hw = height_weight(base(spark, sf), dt.vitals(dt.read(spark, sf, "events")))
    return hw.select("PID", r6("HEIGHT").alias("HEIGHT"), r6("WEIGHT").alias("WEIGHT"))


register("k13_height_weight", W(dt.SQL_ADT, SQL_BASE, dt.SQL_VITALS) + f""",
v AS (SELECT CPR_hash, CASE Vital_parametre WHEN 'Højde' THEN 'HEIGHT' WHEN 'Vægt' THEN 'WEIGHT' END AS f,
             {_sql_num('"Værdi"')} AS x, Registreringstidspunkt AS t FROM vit WHERE Vital_parametre IN ('Højde', 'Vægt')),
j AS (SELECT b.PID, v.f, CASE WHEN v.f = 'HEIGHT' THEN v.x * 2.54 ELSE v.x * 0.0283495231 END AS x, v.t
      FROM v JOIN base b ON v.CPR_hash = b.CPR_hash WHERE v.x IS NOT NULL AND v.t <= b."end")
SELECT PID, round(arg_max(x, t) FILTER (WHERE f = 'HEIGHT'), 6) AS HEIGHT,
       round(arg_max(x, t) FILTER (WHERE f = 'WEIGHT'), 6) AS WEIGHT
FROM j GROUP BY PID""")(k13_height_weight)


# ---------------------------------------------------------------------------
# Procedures per trajectory, unmatched re-appended
# ---------------------------------------------------------------------------
def k5_match_population(spark: SparkSession, sf: str) -> DataFrame:
    t = trajectories(spark, sf)
    p = dt.procedures(dt.read(spark, sf, "events"))
    m = match_population_to_trajectories(t, p)
    return m.select("CPR_hash", "trajectory", "event_id", "ServiceDate", "start", "end",
                    F.concat_ws(",", F.transform("procedures", lambda p: p["ProcedureCode"])).alias("codes"))


register("k5_match_population", W(dt.SQL_ADT, SQL_TRAJ, dt.SQL_PROC) + """,
fdf AS (SELECT DISTINCT p.*, t.trajectory FROM proc p JOIN traj t ON p.CPR_hash = t.CPR_hash
        AND p.ServiceDate >= t.start - INTERVAL 1 DAY AND p.ServiceDate <= t."end" + INTERVAL 1 DAY),
grp AS (SELECT CPR_hash, trajectory,
               first(event_id ORDER BY ServiceDate, ServiceDatetime, ProcedureCode) AS event_id,
               min(ServiceDate) AS ServiceDate,
               string_agg(ProcedureCode, ',' ORDER BY ServiceDate, ServiceDatetime, ProcedureCode) AS codes
        FROM fdf GROUP BY CPR_hash, trajectory),
m AS (SELECT g.CPR_hash, g.trajectory, g.event_id, g.ServiceDate, t.start, t."end", g.codes
      FROM grp g LEFT JOIN traj t ON g.CPR_hash = t.CPR_hash AND g.trajectory = t.trajectory)
SELECT * FROM m
UNION ALL
SELECT p.CPR_hash, NULL, p.event_id, p.ServiceDate, NULL, NULL, p.ProcedureCode FROM proc p
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.CPR_hash = p.CPR_hash AND m.ServiceDate IS NOT DISTINCT FROM p.ServiceDate)""")(
    k5_match_population)


# ---------------------------------------------------------------------------
# Knife time per procedure day
# ---------------------------------------------------------------------------
def k8_knife_time(spark: SparkSession, sf: str) -> DataFrame:
    ev = dt.read(spark, sf, "events")
    df = dt.procedures(ev).select("CPR_hash", "ServiceDate").distinct()
    out = add_case_knife_time(df, dt.cases(ev))
    return out.select("CPR_hash", "ServiceDate", "Case_ID", "knife_time", "knife_time_end",
                      F.col("elapsed_knife_time_minutes"))


register("k8_knife_time", W(dt.SQL_PROC, dt.SQL_CASES) + """,
df AS (SELECT DISTINCT CPR_hash, ServiceDate FROM proc),
s AS (SELECT CPR_hash, Case_ID, "Operationshændelses_Tidspunkt" AS knife_time FROM cases
      WHERE "Operationshændelse" = 'Knivtid/procedure start' AND Status = 'Fuldført'),
e AS (SELECT Case_ID, "Operationshændelses_Tidspunkt" AS knife_time_end FROM cases
      WHERE "Operationshændelse" = 'Sidste sutur/procedure slut'),
k AS (SELECT s.*, e.knife_time_end,
             date_diff('microsecond', s.knife_time, e.knife_time_end) / 60000000.0 AS elapsed FROM s LEFT JOIN e USING (Case_ID)),
c AS (SELECT d.CPR_hash, d.ServiceDate, k.Case_ID, k.knife_time, k.knife_time_end, k.elapsed,
             row_number() OVER (PARTITION BY d.CPR_hash, d.ServiceDate
               ORDER BY abs(date_diff('microsecond', d.ServiceDate, k.knife_time)), k.knife_time, k.Case_ID,
                        k.knife_time_end NULLS FIRST) AS rn
      FROM df d JOIN k ON d.CPR_hash = k.CPR_hash AND abs(date_diff('microsecond', d.ServiceDate, k.knife_time)) <= 86400000000)
SELECT d.CPR_hash, d.ServiceDate, c.Case_ID, c.knife_time, c.knife_time_end, c.elapsed AS elapsed_knife_time_minutes
FROM df d LEFT JOIN c ON d.CPR_hash = c.CPR_hash AND d.ServiceDate = c.ServiceDate AND c.rn = 1""")(k8_knife_time)


# ---------------------------------------------------------------------------
# Comorbidity flags and scores
# ---------------------------------------------------------------------------
def k14_comorbidity(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf).select("PID", "CPR_hash", "start")
    out = add_comorbidity(b, dt.diagnoses(dt.read(spark, sf, "events")))
    return out.where(F.col("ASMT_ELIX").isNotNull()).drop("CPR_hash", "start")


def sql_comorbidity(base_name: str = "base") -> str:
    """CTEs up to ``scores``, from the diagnoses and a base of (PID, CPR_hash, start)."""
    rows = [("CHAR", c, p) for c, (_, s) in CHARLSON.items() for p in expand(s)]
    rows += [("ELIX", c, p) for c, (_, s) in ELIXHAUSER.items() for p in expand(s)]
    values = ", ".join(f"('{a}_{b}', '{p}')" for a, b, p in rows)
    names = [f"ELIX_{c}" for c in ELIXHAUSER] + [f"CHAR_{c}" for c in CHARLSON]
    raw = ", ".join(f"max(CASE WHEN h.flag = '{n}' THEN 1 ELSE 0 END) AS {n}" for n in names)
    zero = {f"ELIX_{m}": f"ELIX_{s}" for m, s in ELIX_ZERO.items()}
    zero.update({f"CHAR_{m}": f"CHAR_{s}" for m, s in CHARLSON_ZERO.items()})
    final = ", ".join(f"CAST(CASE WHEN {zero[n]} = 1 THEN 0 ELSE {n} END AS INTEGER) AS {n}" if n in zero
                      else f"CAST({n} AS INTEGER) AS {n}" for n in names)
    elix = " + ".join(f"({w}) * {('CASE WHEN ' + zero['ELIX_' + c] + ' = 1 THEN 0 ELSE ELIX_' + c + ' END') if 'ELIX_' + c in zero else 'ELIX_' + c}"
                      for c, (w, _) in ELIXHAUSER.items())
    char = " + ".join(f"({w}) * {('CASE WHEN ' + zero['CHAR_' + c] + ' = 1 THEN 0 ELSE CHAR_' + c + ' END') if 'CHAR_' + c in zero else 'CHAR_' + c}"
                      for c, (w, _) in CHARLSON.items())
    ctes = f"""
pref(flag, prefix) AS (VALUES {values}),
codes AS (SELECT b.PID, substr(d.Diagnosekode, 2, greatest(length(d.Diagnosekode) - 2, 0)) AS code
          FROM {base_name} b JOIN diag d ON b.CPR_hash = d.CPR_hash
          WHERE d.Noteret_dato <= b.start - INTERVAL 1 DAY
            AND (d."Løst_dato" IS NULL OR d."Løst_dato" >= b.start + INTERVAL 1 DAY)),
h AS (SELECT DISTINCT c.PID, p.flag FROM codes c JOIN pref p ON starts_with(c.code, p.prefix)),
pids AS (SELECT DISTINCT PID FROM codes),
raw AS (SELECT pids.PID, {raw} FROM pids LEFT JOIN h ON pids.PID = h.PID GROUP BY pids.PID),
scores AS (SELECT PID, {final}, CAST({elix} AS DOUBLE) AS ASMT_ELIX, CAST({char} AS DOUBLE) AS ASMT_CHARLSON FROM raw)"""
    return ctes


register("k14_comorbidity", W(dt.SQL_ADT, SQL_BASE, dt.SQL_DIAG) + "," + sql_comorbidity() + "\nSELECT * FROM scores")(k14_comorbidity)


# ---------------------------------------------------------------------------
# Temporal split, stratified holdout, stratified folds
# ---------------------------------------------------------------------------
def k23_temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    o = dt.read(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("ServiceDate"))
    tr, ho = temporal_split(o, "1998-01-01")
    return tr.withColumn("split", F.lit("train")).unionByName(ho.withColumn("split", F.lit("holdout"))) \
             .select("o_orderkey", "split")


register("k23_temporal_split", """
SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1998-01-01' THEN 'train' ELSE 'holdout' END AS split
FROM orders WHERE o_orderdate IS NOT NULL""")(k23_temporal_split)


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return dt.read(spark, sf, "labels").select(F.col("doc_id").alias("PID"), "quality")


def k23_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    tr, ho = stratified_split(_labels(spark, sf), "quality", "PID", 0.2, 2024)
    return tr.withColumn("holdout", F.lit(False)).unionByName(ho.withColumn("holdout", F.lit(True)))


register("k23_stratified_split", """
WITH r AS (SELECT doc_id AS PID, quality,
                  row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '|2024'), doc_id) AS rn,
                  count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT PID, quality, rn <= ceil(0.2 * n) AS holdout FROM r""")(k23_stratified_split)


def m4_folds(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_folds(_labels(spark, sf), "quality", "PID", 5, 42)


register("m4_folds", """
SELECT doc_id AS PID, quality,
       CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) - 1) % 5 AS INTEGER)
         AS fold
FROM labels""")(m4_folds)


# ---------------------------------------------------------------------------
# Rank metrics and cohort summary
# ---------------------------------------------------------------------------
def m2_m3_auroc_ap(spark: SparkSession, sf: str) -> DataFrame:
    s = dt.read(spark, sf, "labels").join(dt.read(spark, sf, "documents"), "doc_id") \
          .select(F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("p"))
    m = auroc_ap(s, "y", "p")
    return m.select(*[r6(c).alias(c) for c in ("auroc", "auroc_var", "auroc_ci_low", "auroc_ci_high", "ap")],
                    "n", "n_positive")


register("m2_m3_auroc_ap", """
WITH s AS (SELECT CAST(n_chars AS DOUBLE) p, CAST(quality AS INTEGER) y FROM labels JOIN documents USING (doc_id)),
g AS (SELECT p, CAST(sum(y) AS DOUBLE) np, CAST(sum(1 - y) AS DOUBLE) nn FROM s GROUP BY p),
cu AS (SELECT *, sum(nn) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) - nn AS neg_below,
              sum(np) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
              sum(np + nn) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS k,
              sum(np) OVER () AS tot_p, sum(nn) OVER () AS tot_n FROM g),
a AS (SELECT sum(np * (neg_below + 0.5 * nn)) / (max(tot_p) * max(tot_n)) AS A,
             sum(np / tot_p * tp / k) AS ap, max(tot_p) AS P, max(tot_n) AS N FROM cu),
v AS (SELECT *, (A / (2 - A) - A * A) / N + (2 * A * A / (1 + A) - A * A) / P AS var FROM a)
SELECT round(A, 6) AS auroc, round(var, 6) AS auroc_var,
       round(greatest(0.0, least(1.0, A - 1.959963984540054 * sqrt(greatest(var, 0.0)))), 6) AS auroc_ci_low,
       round(greatest(0.0, least(1.0, A + 1.959963984540054 * sqrt(greatest(var, 0.0)))), 6) AS auroc_ci_high,
       round(ap, 6) AS ap, CAST(P + N AS BIGINT) AS n, CAST(P AS BIGINT) AS n_positive FROM v""")(m2_m3_auroc_ap)


# ---------------------------------------------------------------------------
# M3: interval of average precision, drawn on counts
# ---------------------------------------------------------------------------
RESAMPLES = 1000


def _scored_labels(spark: SparkSession, sf: str) -> DataFrame:
    return dt.read(spark, sf, "labels").join(dt.read(spark, sf, "documents"), "doc_id") \
             .select(F.col("quality").alias("y"), F.floor(F.sqrt(F.col("n_chars").cast("double"))).cast("double").alias("p"))


def m3_ap_interval(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored_labels(spark, sf)
    ci = ap_interval(s, "y", "p", n_bootstraps=RESAMPLES)
    return auroc_ap(s, "y", "p").select(r6("ap").alias("ap"), "n").crossJoin(
        ci.select(r6("ap_ci_low").alias("ap_ci_low"), r6("ap_ci_high").alias("ap_ci_high"), "n_resamples"))


def _sql_uniform(name: str, part: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({name} || '|{part}'), 1, 13) AS BIGINT) AS DOUBLE) / {float(1 << 52)!r}"


def _sql_poisson(n: str, name: str, bits: int) -> str:
    """Poisson(n): below 2^bits by the thresholds of Poisson's distribution function, above by the corrected normal quantile."""
    parts = []
    for j in range(bits):
        cdf = ", ".join(f"{c!r}::DOUBLE" for c in _poisson_cdf(1 << j))
        parts.append(f"CASE WHEN {n} & {1 << j} <> 0 THEN len(list_filter([{cdf}], lambda c: c <= {_sql_uniform(name, str(j))})) ELSE 0 END")
    z = f"(sqrt(-2 * ln(1 - {_sql_uniform(name, 'r')})) * cos({2 * math.pi!r} * {_sql_uniform(name, 'a')}))"
    wide = f"CAST(greatest(0.0, floor({n} + {z} * sqrt(CAST({n} AS DOUBLE)) + ({z} * {z} - 1) / 6 + 0.5)) AS BIGINT)"
    return f"CASE WHEN {n} < {1 << bits} THEN {' + '.join(parts)} ELSE {wide} END"


def _sql_ap_interval(counts: str, bits: int, keys: tuple[str, ...] = (), resamples: int = RESAMPLES, seed: int = 42) -> str:
    """CTEs from ``counts`` (keys, p, np, nn) to ``ci`` (keys, ap_ci_low, ap_ci_high, n_resamples)."""
    k = "".join(f"{c}, " for c in keys)
    name = "concat_ws('|', " + k + f"CAST(p AS VARCHAR), CAST(b AS VARCHAR), '{seed}')"
    part = f"PARTITION BY {k}b"
    return f"""
drawn AS (SELECT {k}b, p, {_sql_poisson('np', f"({name} || '|1')", bits)} AS np, {_sql_poisson('nn', f"({name} || '|0')", bits)} AS nn
          FROM (SELECT {k}p, CAST(np AS BIGINT) AS np, CAST(nn AS BIGINT) AS nn FROM {counts}), range(0, {resamples}) AS r(b)),
ran AS (SELECT {k}b, np, sum(np) OVER ({part} ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
               sum(np + nn) OVER ({part} ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS k,
               sum(np) OVER ({part}) AS pos, sum(nn) OVER ({part}) AS neg FROM drawn),
aps AS (SELECT {k}b, sum(CASE WHEN np > 0 THEN np * tp / k ELSE 0.0 END) / max(pos) AS ap FROM ran WHERE pos > 0 AND neg > 0 GROUP BY {k}b),
lst AS (SELECT {k}list_sort(list(ap)) AS v FROM aps GROUP BY {k[:-2] or "()"}),
ci AS (SELECT {k}v[least(len(v) - 1, CAST(floor({(1.0 - 0.95) / 2!r} * len(v)) AS BIGINT)) + 1] AS ap_ci_low,
              v[least(len(v) - 1, CAST(floor({(1.0 + 0.95) / 2!r} * len(v)) AS BIGINT)) + 1] AS ap_ci_high,
              CAST(len(v) AS BIGINT) AS n_resamples FROM lst)"""


register("m3_ap_interval", f"""
WITH s AS (SELECT CAST(floor(sqrt(CAST(n_chars AS DOUBLE))) AS DOUBLE) p, CAST(quality AS INTEGER) y FROM labels JOIN documents USING (doc_id)),
g AS (SELECT p, CAST(sum(y) AS DOUBLE) np, CAST(sum(1 - y) AS DOUBLE) nn FROM s GROUP BY p),
cu AS (SELECT *, sum(np) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
              sum(np + nn) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS k, sum(np) OVER () AS tot_p FROM g),
{_sql_ap_interval('g', 8)}
SELECT (SELECT round(sum(np / tot_p * tp / k), 6) FROM cu) AS ap, (SELECT CAST(sum(np + nn) AS BIGINT) FROM g) AS n,
       round(ap_ci_low, 6) AS ap_ci_low, round(ap_ci_high, 6) AS ap_ci_high, n_resamples FROM ci""")(m3_ap_interval)


def a13_cohort_summary(spark: SparkSession, sf: str) -> DataFrame:
    return cohort_summary(dt.read(spark, sf, "labels"), "quality").select(
        "n_rows", "n_positive", r6("positive_rate").alias("positive_rate"))


register("a13_cohort_summary", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(quality) AS BIGINT) AS n_positive,
       round(avg(CAST(quality AS DOUBLE)), 6) AS positive_rate FROM labels""")(a13_cohort_summary)


# ---------------------------------------------------------------------------
# Multi-hot vocabulary and sparse transform
# ---------------------------------------------------------------------------
def _weekly_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Event types per user and week, and the week columns: every week from the table's first to its last."""
    ev = dt.read(spark, sf, "events").withColumn(
        "week", F.floor(F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("int"))
    first, last = ev.agg(F.min("week"), F.max("week")).first()
    weeks = [] if first is None else list(range(first, last + 1))
    p = ev.groupBy("user_id").pivot("week", weeks).agg(F.array_sort(F.collect_set("event_type")))
    # the feature label is derived from the row (a literal would let the
    # optimizer fold the vocabulary join key away)
    feature = F.when(F.col("user_id").isNotNull(), F.lit("etype"))
    return (p.select("user_id", feature.alias("FEATURE"), *[F.col(str(w)).alias(f"w{w}") for w in weeks]),
            [f"w{w}" for w in weeks])


def r7_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    voc = multi_hot_vocabulary(*_weekly_sets(spark, sf))
    labels = category_labels(voc).select("feature", F.array_join("labels", ",").alias("labels"))
    return voc.join(labels, "feature")


register("r7_vocabulary", """
WITH v AS (SELECT DISTINCT event_type AS value FROM events)
SELECT 'etype' AS feature, value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS idx,
       (SELECT string_agg(value, ',' ORDER BY value) FROM v) AS labels FROM v""")(r7_vocabulary)


def r8_multi_hot(spark: SparkSession, sf: str) -> DataFrame:
    df, steps = _weekly_sets(spark, sf)
    voc = multi_hot_vocabulary(df, steps)
    return multi_hot_transform(df, voc, "user_id", steps)


register("r8_multi_hot", """
WITH e AS (SELECT user_id, event_type, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS INTEGER) AS w
           FROM events),
v AS (SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS idx
      FROM (SELECT DISTINCT event_type AS value FROM e))
SELECT DISTINCT e.user_id, v.idx, CAST(e.w - (SELECT min(w) FROM e) AS INTEGER) AS timestep FROM e JOIN v ON e.event_type = v.value""")(
    r8_multi_hot)


def r8_multi_hot_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Dense matrices of all users, fitted and transformed on two of three: the others are absent samples, all zero."""
    wide, steps = _weekly_sets(spark, sf)
    some = wide.where(F.col("user_id") % 3 != 0)
    voc = multi_hot_vocabulary(some, steps)
    dense = multi_hot_dense(multi_hot_transform(some, voc, "user_id", steps), "user_id", voc.count(), len(steps), wide)
    bits = F.concat_ws("", F.transform("row", lambda x: x.cast("int").cast("string"))).alias("bits")
    return dense.select("user_id", F.posexplode("multi_hot").alias("idx", "row")).select("user_id", "idx", bits)


register("r8_multi_hot_dense", """
WITH e AS (SELECT user_id, event_type, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS INTEGER) AS w
           FROM events),
v AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS idx
      FROM (SELECT DISTINCT event_type AS value FROM e WHERE user_id % 3 <> 0)),
steps AS (SELECT unnest(range((SELECT min(w) FROM e), (SELECT max(w) FROM e) + 1)) AS w),
ones AS (SELECT DISTINCT e.user_id, v.idx, e.w FROM e JOIN v ON e.event_type = v.value WHERE user_id % 3 <> 0),
cells AS (SELECT u.user_id, v.idx, s.w FROM (SELECT DISTINCT user_id FROM e) u CROSS JOIN v CROSS JOIN steps s)
SELECT c.user_id, c.idx, string_agg(CASE WHEN o.w IS NULL THEN '0' ELSE '1' END, '' ORDER BY c.w) AS bits
FROM cells c LEFT JOIN ones o ON o.user_id = c.user_id AND o.idx = c.idx AND o.w = c.w GROUP BY c.user_id, c.idx""")(r8_multi_hot_dense)


# ---------------------------------------------------------------------------
# Wide per-patient dataset at 24 h
# ---------------------------------------------------------------------------
LAB_FEATURES = sorted({codes.LABS_REVERSE_MAP[n] for n in dt.LAB_NAMES if n in codes.LABS_REVERSE_MAP})
MED_VALUES = sorted({c for c in (codes.ATC_LVL3_REVERSE.get(a[:3]) or codes.ATC_LVL4_REVERSE.get(a[:4])
                                 for a in dt.ATC_CODES) if c})
K21_AGGS = ["last", "mean", "max", "count"]


def _k21_base(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    pi = dt.patient_info(dt.read(spark, sf, "customer"))
    from ..functions.timefns import age_years, days_between, event_within_days
    from ..session import cut_lineage
    return cut_lineage(b.join(pi, "CPR_hash", "left").select(
        "PID", "CPR_hash", "start", "end", age_years(F.col("DOB"), F.col("start")).alias("AGE"),
        days_between(F.col("start"), F.col("end")).alias("DURATION"),
        codes.normalize_sex(F.col("SEX_RAW")).alias("SEX"),
        event_within_days(F.col("DOD"), F.col("start"), 90).alias("DECEASED_90d")))


def k21_wide_dataset(spark: SparkSession, sf: str) -> DataFrame:
    b = _k21_base(spark, sf)
    ev = dt.read(spark, sf, "events")
    labs = filter_by_time_window(b, dt.labs_raw(ev), "Prøvetagningstidspunkt", offset_days=0)
    med = dt.medication(ev).withColumn("CPR_hash", F.col("PID").cast("string")).drop("PID")
    med = filter_by_time_window(b, med, "Administrationstidspunkt", offset_days=0)
    cfg = {"target": "DECEASED_90d", "drop_features": {"Labsvar": ["TEG-MA"]},
           "dataset": {"id_col": "PID", "num_cols": ["AGE", "DURATION"], "cat_cols": ["SEX"],
                       "ts_cat_names": ["Medicin"]}}
    ds = AggregatedDataset(cfg, b, {"Labsvar": labs, "Medicin": med}, masking_point="24h", agg_funcs=K21_AGGS,
                           normalisers={"Labsvar": filter_labs, "Medicin": filter_medicin},
                           pivot_values={"Labsvar": [f for f in LAB_FEATURES if f != "TEG-MA"], "Medicin": MED_VALUES})
    out = ds.build()
    # DURATION is one division of whole microseconds: compared as it is
    return out.select(*[r6(c).alias(c) if out.schema[c].dataType.typeName() == "double" and c != "DURATION"
                        else F.col(f"`{c}`") for c in out.columns])


def _sql_k21() -> str:
    labs = [f for f in LAB_FEATURES if f != "TEG-MA"]
    fn = {"last": "arg_max(v, t)", "mean": "avg(v)", "max": "max(v)", "count": "CAST(count(v) AS DOUBLE)"}
    lab_cols = ", ".join(
        f"{fn[a].replace(')', ') FILTER (WHERE f = ' + repr(x) + ')', 1)} AS \"{x}_Labsvar_{a}\""
        for x in labs for a in K21_AGGS)
    med_cols = ", ".join(
        f"CAST(count(*) FILTER (WHERE v = '{m}') > 0 AS BIGINT) AS \"{m}_Medicin_given\", "
        f"CAST(count(*) FILTER (WHERE v = '{m}') AS BIGINT) AS \"{m}_Medicin_count\"" for m in MED_VALUES)
    outs = ", ".join(f"round(coalesce(l.\"{x}_Labsvar_{a}\", 0.0), 6) AS \"{x}_Labsvar_{a}\"" for x in labs for a in K21_AGGS)
    outs += ", " + ", ".join(f"coalesce(m.\"{m}_Medicin_{k}\", 0) AS \"{m}_Medicin_{k}\"" for m in MED_VALUES
                             for k in ("given", "count"))
    lab_map = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.LABS_REVERSE_MAP.items())
    lab_include = ", ".join(f"'{x}'" for x in sorted(codes.LABS_REVERSE_MAP))
    actions = ", ".join(f"'{a}'" for a in codes.MEDICATION_ACTION_LIST)
    m3 = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.ATC_LVL3_REVERSE.items())
    m4 = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.ATC_LVL4_REVERSE.items())
    return W(dt.SQL_ADT, SQL_BASE, dt.SQL_PINFO, dt.SQL_LABS, dt.SQL_MED) + f""",
kb AS (SELECT b.PID, b.CPR_hash, b.start, b."end",
              CAST(floor(floor(date_diff('microsecond', p.DOB, b.start) / 86400000000.0) / 365.25) AS BIGINT) AS AGE,
              date_diff('microsecond', b.start, b."end") / 86400000000.0 AS DURATION,
              CASE p.SEX_RAW WHEN 'Mand' THEN 'Male' WHEN 'Kvinde' THEN 'Female' ELSE p.SEX_RAW END AS SEX,
              CASE WHEN date_diff('microsecond', b.start, p.DOD) <= 90 * 86400000000 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS DECEASED_90d
       FROM base b LEFT JOIN pinfo p ON b.CPR_hash = p.CPR_hash),
lw AS (SELECT DISTINCT l.*, k.PID FROM labs_raw l JOIN kb k ON l.CPR_hash = k.CPR_hash
       AND l."Prøvetagningstidspunkt" >= k.start AND l."Prøvetagningstidspunkt" <= k."end"),
lc AS (SELECT PID, "Prøvetagningstidspunkt" AS t, BestOrd,
              replace(replace("Resultatværdi", ',', '.'), '*', '') AS raw FROM lw),
lk AS (SELECT PID, t, CASE BestOrd {lab_map} ELSE BestOrd END AS f, regexp_replace(raw, '[*<>]', '', 'g') AS r
       FROM lc WHERE raw IS NOT NULL AND regexp_matches(raw, '[0-9]') AND BestOrd IN ({lab_include})),
ln AS (SELECT lk.PID, t, f, {_sql_num('r')} AS v FROM lk JOIN kb ON lk.PID = kb.PID
       WHERE t <= kb.start + INTERVAL 24 HOUR),
lv AS (SELECT * FROM ln WHERE v IS NOT NULL AND f <> 'TEG-MA'),
l AS (SELECT PID, {lab_cols} FROM lv GROUP BY PID),
mw AS (SELECT DISTINCT md.*, k.PID AS BPID FROM med md JOIN kb k ON CAST(md.PID AS VARCHAR) = k.CPR_hash
       AND md.Administrationstidspunkt >= k.start AND md.Administrationstidspunkt <= k."end"),
ml AS (SELECT BPID AS PID, event_id, Administrationstidspunkt AS t, CASE substr(ATC, 1, 3) {m3} END AS v FROM mw
       WHERE Handling IN ({actions})
       UNION
       SELECT BPID, event_id, Administrationstidspunkt, CASE substr(ATC, 1, 4) {m4} END FROM mw WHERE Handling IN ({actions})),
mm AS (SELECT ml.* FROM ml JOIN kb ON ml.PID = kb.PID WHERE v IS NOT NULL AND t <= kb.start + INTERVAL 24 HOUR),
m AS (SELECT PID, {med_cols} FROM mm GROUP BY PID)
SELECT kb.PID, kb.AGE, kb.DURATION, kb.SEX, kb.DECEASED_90d, {outs}
FROM kb LEFT JOIN l ON kb.PID = l.PID LEFT JOIN m ON kb.PID = m.PID"""


register("k21_wide_dataset", _sql_k21())(k21_wide_dataset)


# ---------------------------------------------------------------------------
# M11 input: features at many cutoffs in one scan
# ---------------------------------------------------------------------------
CUTOFFS = [60 * h for h in range(1, 73)] + [1440 * d for d in range(4, 31)]  # the 99 evaluation times of D8


def m11_cutoff_features(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    return cutoff_features(windowed_long(spark, sf, b), b, CUTOFFS, "events", ["last", "mean", "count"], digits=6)


register("m11_cutoff_features", W(dt.SQL_ADT, SQL_BASE, SQL_WLONG) + f""",
c(masking_point) AS (VALUES {', '.join(f'({c})' for c in CUTOFFS)}),
j AS (SELECT c.masking_point, w.* FROM wlong w JOIN base b ON w.PID = b.PID JOIN c
      ON date_diff('microsecond', b.start, w."TIMESTAMP") / 60000000.0 <= c.masking_point)
SELECT masking_point, PID, FEATURE, round(arg_max(VALUE, "TIMESTAMP"), 6) AS last, round(avg(VALUE), 6) AS mean,
       round(CAST(count(VALUE) AS DOUBLE), 6) AS count
FROM j GROUP BY masking_point, PID, FEATURE""")(m11_cutoff_features)


# ---------------------------------------------------------------------------
# Metrics at all 99 cutoffs, from stored predictions
# ---------------------------------------------------------------------------
# A fixed additive score on the event counts, in halves so that ties are exact in every engine.
COUNT_WEIGHTS = {"error": 2.0, "purchase": 1.0, "click": 0.5, "view": 0.5, "signup": -1.0}
POINT = "CASE WHEN m % 1440 = 0 THEN (m // 1440) || 'D' WHEN m % 60 = 0 THEN (m // 60) || 'h' ELSE m || 'min' END"


def m10_metrics_all_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of each event type at 99 cutoffs -> a fixed additive score -> predictions stored by masking
    point -> metrics of all masking points in one job."""
    b = _k21_base(spark, sf)
    cfg = {"target": "DECEASED_90d", "dataset": {"id_col": "PID", "num_cols": ["AGE"]}}
    ds = AggregatedDataset(cfg, b, {"events": windowed_long(spark, sf, b)}, agg_funcs=["count"],
                           pivot_values={"events": list(COUNT_WEIGHTS)})
    score = sum((F.col(f"{f}_events_count") * w for f, w in COUNT_WEIGHTS.items()), F.lit(0.0))
    scored = ds.build_runs(CUTOFFS).select("PID", "DECEASED_90d", score.alias("y_pred"), "first_cut", "next_cut")
    stored = store_predictions(predictions(at_cutoffs(scored, CUTOFFS), "DECEASED_90d"), f"{ensure_checkpoint_dir(spark)}/predictions-{uuid.uuid4().hex}")
    m = metrics_by_cutoff(stored, n_bootstraps=RESAMPLES)
    return m.select("masking_point", "time_min", "time_hours", "time_days", "censor_step", *[r6(c).alias(c) for c in (
        "auroc", "auroc_ci_low", "auroc_ci_high", "ap", "ap_ci_low", "ap_ci_high")], "n", "n_positive", "n_resamples")


def _sql_m10() -> str:
    weights = " ".join(f"WHEN '{f}' THEN {w}::DOUBLE" for f, w in COUNT_WEIGHTS.items())
    return W(dt.SQL_ADT, SQL_BASE, SQL_WLONG, dt.SQL_PINFO, sql_step_ranges()) + f""",
c(m) AS (VALUES {', '.join(f'({c})' for c in CUTOFFS)}),
kb AS (SELECT b.PID, b.start, CASE WHEN date_diff('microsecond', b.start, p.DOD) <= 90 * 86400000000 THEN 1 ELSE 0 END AS y
       FROM base b LEFT JOIN pinfo p ON b.CPR_hash = p.CPR_hash),
sc AS (SELECT c.m, kb.PID, kb.y, coalesce(sum(CASE w.FEATURE {weights} END) FILTER (WHERE w.VALUE IS NOT NULL), 0.0) AS p
       FROM kb CROSS JOIN c LEFT JOIN wlong w ON w.PID = kb.PID AND date_diff('microsecond', kb.start, w."TIMESTAMP") <= c.m * CAST(60000000 AS BIGINT)
       GROUP BY c.m, kb.PID, kb.y),
g AS (SELECT m, {POINT} AS mp, CAST(m AS DOUBLE) AS tm, p, CAST(sum(y) AS DOUBLE) np, CAST(sum(1 - y) AS DOUBLE) nn FROM sc GROUP BY m, p),
cu AS (SELECT *, sum(nn) OVER (PARTITION BY m ORDER BY p ROWS UNBOUNDED PRECEDING) - nn AS neg_below,
              sum(np) OVER (PARTITION BY m ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
              sum(np + nn) OVER (PARTITION BY m ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS k,
              sum(np) OVER (PARTITION BY m) AS tot_p, sum(nn) OVER (PARTITION BY m) AS tot_n FROM g),
a AS (SELECT mp, tm, CASE WHEN max(tot_p) * max(tot_n) > 0 THEN sum(np * (neg_below + 0.5 * nn)) / (max(tot_p) * max(tot_n)) END AS A,
             CASE WHEN max(tot_p) > 0 THEN sum(np / tot_p * tp / k) END AS ap, max(tot_p) AS P, max(tot_n) AS N FROM cu GROUP BY mp, tm),
v AS (SELECT *, (A / (2 - A) - A * A) / N + (2 * A * A / (1 + A) - A * A) / P AS var FROM a),
{_sql_ap_interval('g', 8, ('mp', 'tm'))},
edges AS (SELECT CAST(first_step + ceil((tm - lo) / size) - 1 AS BIGINT) AS step, tm AS tm2
          FROM (SELECT DISTINCT tm FROM g) JOIN ranges ON tm > lo AND (hi IS NULL OR tm <= hi))
SELECT v.mp AS masking_point, v.tm AS time_min, v.tm / 60 AS time_hours, v.tm / 1440 AS time_days, step AS censor_step,
       round(A, 6) AS auroc, round(greatest(0.0, least(1.0, A - 1.959963984540054 * sqrt(greatest(var, 0.0)))), 6) AS auroc_ci_low,
       round(greatest(0.0, least(1.0, A + 1.959963984540054 * sqrt(greatest(var, 0.0)))), 6) AS auroc_ci_high, round(ap, 6) AS ap,
       round(ap_ci_low, 6) AS ap_ci_low, round(ap_ci_high, 6) AS ap_ci_high, CAST(P + N AS BIGINT) AS n, CAST(P AS BIGINT) AS n_positive,
       n_resamples
FROM v JOIN edges ON v.tm = tm2 LEFT JOIN ci ON ci.mp = v.mp AND ci.tm = v.tm"""


register("m10_metrics_all_cutoffs", _sql_m10())(m10_metrics_all_cutoffs)


# ---------------------------------------------------------------------------
# Included diagnoses in the look-back window, numbered wide
# ---------------------------------------------------------------------------
def k9_diagnoses(spark: SparkSession, sf: str) -> DataFrame:
    from .cohort import DIAGNOSIS_INCLUSION, add_diagnoses
    b = base(spark, sf).withColumn("ServiceDate", F.col("start"))
    d = dt.diagnoses(dt.read(spark, sf, "events")).drop("event_id")
    wide = add_diagnoses(b.select("PID", "CPR_hash", "ServiceDate", "start", "end"), d, DIAGNOSIS_INCLUSION)
    return wide.select("PID", F.concat_ws(",", F.transform("diagnoses", lambda d: d["Diagnosekode"])).alias("codes"))


def _sql_k9() -> str:
    from .cohort import DIAGNOSIS_INCLUSION
    inc = ", ".join(f"'{c}'" for c in DIAGNOSIS_INCLUSION)
    return W(dt.SQL_ADT, SQL_BASE, dt.SQL_DIAG) + f""",
m AS (SELECT DISTINCT d.CPR_hash, d.Diagnosekode, d.Noteret_dato, d."Løst_dato", b.start AS ServiceDate
      FROM diag d JOIN base b ON d.CPR_hash = b.CPR_hash
      AND d.Noteret_dato >= b.start - INTERVAL 6 MONTH AND d.Noteret_dato <= b."end"
      WHERE d.Diagnosekode IN ({inc})),
w AS (SELECT CPR_hash, ServiceDate, string_agg(Diagnosekode, ',' ORDER BY Noteret_dato, Diagnosekode) AS codes
      FROM m GROUP BY CPR_hash, ServiceDate)
SELECT b.PID, coalesce(w.codes, '') AS codes FROM base b
LEFT JOIN w ON b.CPR_hash = w.CPR_hash AND b.start = w.ServiceDate"""


register("k9_diagnoses", _sql_k9())(k9_diagnoses)


# ---------------------------------------------------------------------------
# Mixed-format move times parsed, move-ins shifted 1 s
# ---------------------------------------------------------------------------
def k2_load_adt(spark: SparkSession, sf: str) -> DataFrame:
    from .cohort import load_adt
    a = dt.adt(dt.read(spark, sf, "events"))
    fmt = F.col("event_id") % 3
    text_in = (F.when(fmt == 0, F.date_format("Flyt_ind", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
                .when(fmt == 1, F.date_format("Flyt_ind", "dd-MM-yyyy HH:mm:ss"))
                .otherwise(F.date_format("Flyt_ind", "yyyy-MM-dd'T'HH:mm:ss")))
    text_out = F.when(F.col("event_id") % 11 == 0, F.lit("unknown")) \
                .otherwise(F.date_format("Flyt_ud", "yyyy-MM-dd HH:mm"))
    raw = a.select("event_id", "CPR_hash", "ADT_haendelse", text_in.alias("Flyt_ind"), text_out.alias("Flyt_ud"))
    return load_adt(raw).select("event_id", "Flyt_ind", "Flyt_ud")


register("k2_load_adt", W(dt.SQL_ADT) + """,
raw AS (SELECT event_id, ADT_haendelse,
               CASE event_id % 3 WHEN 0 THEN strftime(Flyt_ind, '%Y-%m-%d %H:%M:%S.%f')
                                 WHEN 1 THEN strftime(Flyt_ind, '%d-%m-%Y %H:%M:%S')
                                 ELSE strftime(Flyt_ind, '%Y-%m-%dT%H:%M:%S') END AS i,
               CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE strftime(Flyt_ud, '%Y-%m-%d %H:%M') END AS u
        FROM adt),
p AS (SELECT event_id, ADT_haendelse,
             coalesce(try_strptime(i, '%Y-%m-%d %H:%M:%S.%f'), try_strptime(i, '%d-%m-%Y %H:%M:%S'),
                      try_strptime(i, '%Y-%m-%dT%H:%M:%S')) AS fi,
             try_strptime(u, '%Y-%m-%d %H:%M') AS fu
      FROM raw)
SELECT event_id, CASE WHEN ADT_haendelse = 'Flyt Ind' THEN fi + INTERVAL 1 SECOND ELSE fi END AS Flyt_ind,
       fu AS Flyt_ud FROM p""")(k2_load_adt)


# ---------------------------------------------------------------------------
# Catalogue-driven in-hospital windowing of one raw table
# ---------------------------------------------------------------------------
def k17_window_labs(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.readers import load_catalogue
    from .windowing import window_table
    cat = load_catalogue(spark, configured=["Labsvar"]).where(F.col("filename") == "Labsvar").first()
    b = base(spark, sf)
    labs = dt.labs_raw(dt.read(spark, sf, "events"))
    out = window_table(b, labs, cat.dt_colname, cat.ts_offset)
    return out.select("event_id", "PID")


register("k17_window_labs", W(dt.SQL_ADT, SQL_BASE, dt.SQL_LABS) + """
SELECT DISTINCT l.event_id, b.PID FROM labs_raw l JOIN base b ON l.CPR_hash = b.CPR_hash
 AND l."Prøvetagningstidspunkt" >= b.start AND l."Prøvetagningstidspunkt" <= b."end\"""")(k17_window_labs)


# ---------------------------------------------------------------------------
# Preoperative windowing (cutoff knife_time -> ServiceDate)
# ---------------------------------------------------------------------------
def k18_preoperative_labs(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.filters import preop_cutoff
    from .windowing import window_table
    b = base(spark, sf).withColumn("ServiceDate", F.col("start"))
    long_stay = F.expr(f"{micros_sql('start', 'end')} > 4 * 3600000000")
    b = b.withColumn("knife_time", F.when(long_stay, F.col("start") + F.make_interval(hours=F.lit(2))))
    b = b.withColumn("preop_cutoff", preop_cutoff(b))
    out = window_table(b, dt.labs_raw(dt.read(spark, sf, "events")), "Prøvetagningstidspunkt", 0, "preop_cutoff")
    return out.select("event_id", "PID")


register("k18_preoperative_labs", W(dt.SQL_ADT, SQL_BASE, dt.SQL_LABS) + """,
pb AS (SELECT PID, CPR_hash, start,
              coalesce(CASE WHEN date_diff('microsecond', start, "end") > 4 * 3600000000 THEN start + INTERVAL 2 HOUR END,
                       start) AS cutoff FROM base)
SELECT DISTINCT l.event_id, b.PID FROM labs_raw l JOIN pb b ON l.CPR_hash = b.CPR_hash
 AND l."Prøvetagningstidspunkt" >= b.start AND l."Prøvetagningstidspunkt" <= b.cutoff""")(k18_preoperative_labs)


# ---------------------------------------------------------------------------
# Every catalogued table that the driver tables can give, windowed in one scan
# ---------------------------------------------------------------------------
def catalogued_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    ev = dt.read(spark, sf, "events")
    by_pid = lambda d: d.withColumn("CPR_hash", F.col("PID").cast("string")).drop("PID")
    return {"ADTHaendelser": dt.adt(ev), "Procedurer": dt.procedures(ev), "Diagnoser": dt.diagnoses(ev),
            "VitaleVaerdier": dt.vitals(ev).drop("PID"), "Medicin": by_pid(dt.medication(ev)), "Labsvar": dt.labs_raw(ev),
            "Cases": dt.cases(ev), "ITAOversigtsrapport": by_pid(dt.ita(ev))}


def _window_all(spark: SparkSession, sf: str, b: DataFrame, end_col: str) -> DataFrame:
    from ..sources.readers import load_catalogue
    from .windowing import filter_tables
    tables = catalogued_tables(spark, sf)
    cat = load_catalogue(spark, configured=list(tables)).collect()
    w = filter_tables(b, tables, cat, end_col)
    name = F.coalesce(*[F.col(f"t_{t}.event_id").cast("string") for t in tables if t != "Cases"], F.col("t_Cases.Case_ID"))
    return w.select("filename", "PID", F.col("__t").alias("TIMESTAMP"), name.alias("row"))


def k17_window_all(spark: SparkSession, sf: str) -> DataFrame:
    return _window_all(spark, sf, base(spark, sf), "end")


def _with_preop(b: DataFrame) -> DataFrame:
    from ..operators.filters import preop_cutoff
    b = b.withColumn("ServiceDate", F.col("start"))
    long_stay = F.expr(f"{micros_sql('start', 'end')} > 4 * 3600000000")
    b = b.withColumn("knife_time", F.when(long_stay, F.col("start") + F.make_interval(hours=F.lit(2))))
    return b.withColumn("preop_cutoff", preop_cutoff(b))


def k18_preoperative_all(spark: SparkSession, sf: str) -> DataFrame:
    return _window_all(spark, sf, _with_preop(base(spark, sf)), "preop_cutoff")


def _sql_window_all(cutoff: str) -> str:
    """Per table: its rows inside the window, widened by the catalogue's days."""
    from ..sources.schemas import CATALOGUE_ROWS
    cte = {"ADTHaendelser": ("adt", "CPR_hash"), "Procedurer": ("proc", "CPR_hash"), "Diagnoser": ("diag", "CPR_hash"),
           "VitaleVaerdier": ("vit", "CPR_hash"), "Medicin": ("med", "CAST(PID AS VARCHAR)"), "Labsvar": ("labs_raw", "CPR_hash"),
           "Cases": ("cases", "CPR_hash"), "ITAOversigtsrapport": ("ita", "CAST(PID AS VARCHAR)")}
    parts = []
    for name, col, _, _, days in CATALOGUE_ROWS:
        if name in cte:
            table, key = cte[name]
            row = "Case_ID" if name == "Cases" else "CAST(event_id AS VARCHAR)"
            parts.append(f"""SELECT '{name}' AS filename, PID, t AS "TIMESTAMP", row FROM (
  SELECT DISTINCT b.PID, x.t, x.row, x.k FROM (SELECT {key} AS id, "{col}" AS t, {row} AS row, {table}::VARCHAR AS k FROM {table}) x
  JOIN pb b ON x.id = b.CPR_hash AND x.t >= b.start - to_days({days}) AND x.t <= b.cutoff + to_days({days}))""")
    return W(dt.SQL_ADT, SQL_BASE, dt.SQL_PROC, dt.SQL_DIAG, dt.SQL_VITALS, dt.SQL_MED, dt.SQL_LABS, dt.SQL_CASES, dt.SQL_ITA) + f""",
pb AS (SELECT PID, CPR_hash, start, {cutoff} AS cutoff FROM base)
""" + " UNION ALL ".join(parts)


register("k17_window_all", _sql_window_all('"end"'))(k17_window_all)
register("k18_preoperative_all", _sql_window_all("""coalesce(CASE WHEN date_diff('microsecond', start, "end") > 4 * 3600000000
       THEN start + INTERVAL 2 HOUR END, start)"""))(k18_preoperative_all)
