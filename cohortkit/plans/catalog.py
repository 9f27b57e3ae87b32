"""Registered queries: one per operator family of the inventory.

Each entry has a Spark implementation built from the library operators
(reads whole driver tables) and, where SQL can express it, an independent
DuckDB oracle.  Computed columns carry the same alias on both sides; floats
are rounded to 6 places on both sides (summation order differs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG
from ..operators.joins import window_join
from ..operators.trajectories import build_trajectories, number_trajectories
from ..plans.binning import map_concept
from ..session import cut_lineage
from . import driver_tables as dt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

GAP_HOURS = 6  # collapse gap for the driver events (~67 events/user/month)
BINS = DEFAULT_CONFIG["bin_intervals"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c: str | F.Column) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------------------
# shared derivations
# ---------------------------------------------------------------------------
def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """K3/K4 on the driver events: W1 admission counter, W2 gap sessions,
    A7 label collapse."""
    a = dt.adt(dt.read(spark, sf, "events"))
    return build_trajectories(a, "CPR_hash", gap_hours=GAP_HOURS, tie_cols=["event_id"])


SQL_TRAJ = f"""numbered AS (
  SELECT *, sum(CASE WHEN ADT_haendelse = 'Indlæggelse' THEN 1 ELSE 0 END)
              OVER (PARTITION BY CPR_hash ORDER BY Flyt_ind, event_id ROWS UNBOUNDED PRECEDING) AS cnt
  FROM adt),
lagged AS (
  SELECT CPR_hash, event_id, Flyt_ind AS s, Flyt_ud AS e, CASE WHEN cnt > 0 THEN cnt END AS lbl,
         lag(Flyt_ud) OVER (PARTITION BY CPR_hash ORDER BY Flyt_ind, event_id) AS pe
  FROM numbered),
grouped AS (
  SELECT *, sum(CASE WHEN date_diff('microsecond', pe, s) >= {GAP_HOURS * 3600 * 1000000} THEN 1 ELSE 0 END)
              OVER (PARTITION BY CPR_hash ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS gid
  FROM lagged),
traj AS (
  SELECT CPR_hash, min(s) AS start, max(e) AS "end",
         coalesce(array_to_string(list_sort(list_distinct(
             list(CAST(lbl AS VARCHAR)) FILTER (WHERE lbl IS NOT NULL))), ','), '') AS trajectory
  FROM grouped GROUP BY CPR_hash, gid)"""


def base(spark: SparkSession, sf: str) -> DataFrame:
    """Trajectories with a dense PID (K11) keyed by (patient, start).

    The cohort table is a stage boundary: it is materialised once (reliable
    checkpoint in ``spark.checkpoint.dir``) and every later join, grid and
    bin placement reads the stored rows instead of recomputing the
    trajectory scans."""
    a = dt.adt(dt.read(spark, sf, "events"))
    t = build_trajectories(a, "CPR_hash", gap_hours=GAP_HOURS, tie_cols=["event_id"], keep_group_id=True)
    numbered = number_trajectories(t)
    try:
        return cut_lineage(numbered.drop("group_id"))
    finally:
        t.unpersist()


SQL_BASE = SQL_TRAJ + """,
base AS (SELECT CAST(dense_rank() OVER (ORDER BY CPR_hash, start) AS BIGINT) AS PID, * FROM traj)"""


def windowed_long(spark: SparkSession, sf: str, b: DataFrame, carry: tuple[str, ...] = ("PID", "start", "end")) -> DataFrame:
    """Event long model restricted to each trajectory window (J2, offset 0); the window travels with the event."""
    ev = dt.read(spark, sf, "events")
    lm = ev.select(F.col("user_id").cast("string").alias("CPR_hash"), F.col("ts").alias("TIMESTAMP"),
                   F.col("event_type").alias("FEATURE"), F.col("value").alias("VALUE"))
    w = window_join(lm, b, "CPR_hash", "TIMESTAMP", F.col("start"), F.col("end"), carry=list(carry))
    return w.drop("CPR_hash")


SQL_WLONG = """wlong AS (
  SELECT DISTINCT b.PID, e.ts AS "TIMESTAMP", e.event_type AS FEATURE, e.value AS VALUE
  FROM events e JOIN base b ON CAST(e.user_id AS VARCHAR) = b.CPR_hash
   AND e.ts >= b.start AND e.ts <= b."end")"""


def sql_bins(intervals: dict = BINS, base_name: str = "base") -> str:
    """Oracle bin grid, derived by recursion from the configured texts: the
    edges of an interval run from the previous interval's last edge,
    strictly below its end and below end + 10 min."""
    rows = ", ".join(f"({i + 1}, '{e}', '{f}')" for i, (e, f) in enumerate(intervals.items()))

    def micros(c):
        return (f"CAST(regexp_extract({c}, '[0-9]+') AS BIGINT) * CASE WHEN {c} LIKE '%min' THEN 60000000 "
                f"WHEN {c} LIKE '%h' THEN 3600000000 ELSE 86400000000 END")
    lim = "least(coalesce(c.ie, r.W), r.W)"
    n = f"greatest(CASE WHEN {lim} > r.cur THEN ({lim} - r.cur + c.f - 1) // c.f ELSE 0 END - 1, 0)"
    return f"""cfg(i, e, lbl) AS (VALUES {rows}),
spans AS (SELECT i, lbl, CASE WHEN e <> 'end' THEN {micros('e')} END AS ie, {micros('lbl')} AS f FROM cfg),
bw AS (SELECT PID, start, date_diff('microsecond', start, "end") + 600000000 AS W FROM {base_name}
       WHERE start IS NOT NULL AND "end" IS NOT NULL AND date_diff('microsecond', start, "end") + 600000000 > 0),
rec AS (SELECT PID, start, W, 0 AS i, CAST(0 AS BIGINT) AS s0, CAST(0 AS BIGINT) AS f, CAST(1 AS BIGINT) AS c0,
               CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS cur, CAST(1 AS BIGINT) AS cnt, '' AS lbl FROM bw
        UNION ALL
        SELECT r.PID, r.start, r.W, c.i, r.cur, c.f, r.cnt, {n}, r.cur + {n} * c.f, r.cnt + {n}, c.lbl
        FROM rec r JOIN spans c ON c.i = r.i + 1),
bin_idx AS (SELECT PID, start, s0, f, c0, lbl, unnest(range(n)) AS k FROM rec WHERE n > 0),
bins AS (SELECT PID, start + to_microseconds(s0 + k * f) AS bin_start, start + to_microseconds(s0 + (k + 1) * f) AS bin_end,
                CAST(c0 + k AS INTEGER) AS bin_counter, lbl AS bin_freq FROM bin_idx)"""


# ---------------------------------------------------------------------------
# flagship: K19 per-bin mean of the event long model
# ---------------------------------------------------------------------------
def k19_bin_mean(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    lm = windowed_long(spark, sf, b)
    out = map_concept(lm, b, {"bin_intervals": BINS}, agg_func="mean")
    return out.withColumn("VALUE", r6("VALUE"))


register("k19_bin_mean", dt.with_sql(dt.SQL_ADT, SQL_BASE, SQL_WLONG, sql_bins()) + """,
placed AS (
  SELECT w.PID, bn.bin_counter, w.FEATURE, w.VALUE FROM wlong w
  JOIN bins bn ON w.PID = bn.PID AND w."TIMESTAMP" >= bn.bin_start AND w."TIMESTAMP" < bn.bin_end),
agg AS (SELECT PID, bin_counter, FEATURE, avg(VALUE) AS VALUE FROM placed GROUP BY PID, bin_counter, FEATURE)
SELECT bn.PID, bn.bin_start, bn.bin_end, bn.bin_counter, bn.bin_freq, a.FEATURE, round(a.VALUE, 6) AS VALUE
FROM bins bn LEFT JOIN agg a ON bn.PID = a.PID AND bn.bin_counter = a.bin_counter
WHERE NOT (a.FEATURE IS NOT NULL AND a.VALUE IS NULL)""")(k19_bin_mean)


from . import catalog_ops  # noqa: E402,F401  (registers more queries)
from . import catalog_bins  # noqa: E402,F401
from . import catalog_cohort  # noqa: E402,F401
from . import catalog_jobs  # noqa: E402,F401
from . import catalog_small  # noqa: E402,F401
