"""Joins between event tables and per-patient windows.

Range joins always carry the patient-id equality *and* a time-bucket
equality: each window is exploded to the buckets (days) it covers and each
event has exactly one bucket, so a patient with a third of all rows is
spread over many join partitions and every (event, window) pair is produced
once.  Top-1 selections use ``min_by`` (partial aggregation) instead of a
sorted window over the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefns import micros_sql
from ..session import cut_lineage
from .ordered import time_bucket


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str | Sequence[str] = "CPR_hash") -> DataFrame:
    """Keep rows whose id is in the cohort (left semi join).

    No broadcast hint: the cohort can grow with the data; AQE turns the
    join into a broadcast at run time when the measured id set is small.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(ids.select(*keys).distinct(), on=keys, how="left_semi")


def window_join(events: DataFrame, windows: DataFrame, id_col: str, ts_col: str,
                lo: Column, hi: Column, carry: Sequence[str] = ("PID",),
                bucket_seconds: int = 86400, distinct: bool = True,
                keep_window_cols: bool = False) -> DataFrame:
    """Inclusive range join ``lo <= ts <= hi`` per id (J2/J3/J4 core).

    ``lo``/``hi`` are expressions over ``windows``.  Output: event columns
    plus ``carry`` columns of the window.  ``distinct`` reproduces the
    duplicate drop of the windowing step (A12).
    """
    w = windows.select(F.col(id_col), *[F.col(c) for c in carry],
                       lo.alias("__lo"), hi.alias("__hi")) \
               .where(F.col("__lo").isNotNull() & F.col("__hi").isNotNull() & (F.col("__lo") <= F.col("__hi")))
    w = w.withColumn("__b", F.explode(F.sequence(time_bucket("__lo", bucket_seconds),
                                                 time_bucket("__hi", bucket_seconds))))
    e = events.where(F.col(ts_col).isNotNull()).withColumn("__b", time_bucket(ts_col, bucket_seconds))
    j = e.join(w, on=[id_col, "__b"], how="inner") \
         .where((F.col(ts_col) >= F.col("__lo")) & (F.col(ts_col) <= F.col("__hi")))
    cols = list(events.columns) + [c for c in carry if c not in events.columns]
    if keep_window_cols:
        cols += ["__lo", "__hi"]
    if not distinct:
        return j.select(*cols)
    # with the bucket in the key, equal rows are where the join has put them: no second shuffle
    return j.select(*cols, "__b").distinct().drop("__b")


def filter_by_time_window(base: DataFrame, df: DataFrame, dt_name: str, start_col: str = "start",
                          end_col: str = "end", offset_days: int = 1, id_col: str = "CPR_hash",
                          carry: Sequence[str] = ("PID",)) -> DataFrame:
    """Events within ``[start - offset d, end + offset d]`` (inclusive),
    plus the window's PID, duplicates dropped."""
    lo = F.col(start_col) - F.make_interval(days=F.lit(offset_days))
    hi = F.col(end_col) + F.make_interval(days=F.lit(offset_days))
    return window_join(df, base, id_col, dt_name, lo, hi, carry=carry)


def match_trajectories(trajectories: DataFrame, df: DataFrame, dt_name: str, offset_days: int = 1,
                       id_col: str = "CPR_hash") -> DataFrame:
    """Rows of ``df`` whose time lies in ``[start-1d, end+1d]`` of a
    trajectory; adds ``trajectory``."""
    return filter_by_time_window(trajectories, df, dt_name, offset_days=offset_days,
                                 id_col=id_col, carry=("trajectory",))


def lookback_join(base: DataFrame, df: DataFrame, dt_name: str, months: int = 6,
                  start_col: str = "start", end_col: str = "end", id_col: str = "CPR_hash",
                  carry: Sequence[str] = ("PID",), bucket_seconds: int = 30 * 86400) -> DataFrame:
    """``start - N months <= t <= end`` (month end clipped, time kept).

    Windows span months, so buckets are 30 days wide: about N+1 bucket rows
    per window instead of ~30 N day rows, while a heavy patient is still
    split by month."""
    lo = F.col(start_col) - F.make_interval(months=F.lit(months))
    return window_join(df, base, id_col, dt_name, lo, F.col(end_col), carry=carry, bucket_seconds=bucket_seconds)


def nearest_in_time(left: DataFrame, right: DataFrame, id_col: str, left_ts: str, right_ts: str,
                    left_keys: Sequence[str], tie_cols: Sequence[str] = (),
                    tolerance_seconds: int = 86400, right_cols: Sequence[str] | None = None) -> DataFrame:
    """For each ``left_keys`` row the right row nearest in time with
    ``|Δ| <= tolerance``; ties broken by (right time, ``tie_cols``).

    Left join semantics: left rows without a candidate keep nulls.  The
    candidate search is bucketed (right rows are replicated to the buckets
    within the tolerance) and the pick is a ``min_by`` aggregate.
    """
    right_cols = list(right_cols or [c for c in right.columns if c != id_col])
    width = tolerance_seconds
    r = right.where(F.col(right_ts).isNotNull()).select(
        id_col, *right_cols,
        F.explode(F.sequence(time_bucket(F.col(right_ts) - F.make_interval(secs=F.lit(width)), width),
                             time_bucket(F.col(right_ts) + F.make_interval(secs=F.lit(width)), width))).alias("__b"))
    if left_ts not in left_keys:
        raise ValueError("left_ts must be one of left_keys")
    lsel = left.select(*left_keys).distinct() \
               .where(F.col(left_ts).isNotNull()) \
               .withColumn("__b", time_bucket(left_ts, width)) \
               .withColumn("__lts", F.col(left_ts))
    cand = lsel.join(r, on=[id_col, "__b"], how="inner")
    diff = F.abs(F.expr(micros_sql("__lts", right_ts)))
    cand = cand.where(diff <= F.lit(tolerance_seconds * 1_000_000))
    order = F.struct(diff.alias("d"), F.col(right_ts).alias("t"), *[F.col(c) for c in tie_cols])
    best = cand.groupBy(*left_keys).agg(F.min_by(F.struct(*[F.col(c) for c in right_cols]), order).alias("__best"))
    best = best.select(*left_keys, *[F.col(f"__best.{c}").alias(c) for c in right_cols])
    return left.join(best, on=list(left_keys), how="left")


def anti_reappend(population: DataFrame, matched: DataFrame, keys: Sequence[str],
                  rename: dict[str, str] | None = None) -> DataFrame:
    """Population rows whose ``keys`` are absent from ``matched``
    (null-safe key equality), renamed and appended by name."""
    m = matched.select(*[F.col(k).alias(f"__m_{k}") for k in keys]).distinct()
    cond = [population[k].eqNullSafe(m[f"__m_{k}"]) for k in keys]
    unmatched = population.join(m, on=cond, how="left_anti")
    for a, b in (rename or {}).items():
        if a in unmatched.columns:
            unmatched = unmatched.withColumnRenamed(a, b)
    return matched.unionByName(unmatched, allowMissingColumns=True)


def guarded_left_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """J10 + J11 without a job of its own: the left join, which raises where a
    left row meets a key that ``right`` has several times.

    The right side is counted per key in the join's own plan (its rows are
    dealt by the key for the join anyway), so the check costs no pass over
    the data, sees the same rows as the join, and holds if tasks are
    repeated.  (Counts by ``observe`` would leave an object in the session
    that Spark ML's closures can't be serialised with.)"""
    keys = [on] if isinstance(on, str) else list(on)
    rest = [c for c in right.columns if c not in keys]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    if not rest:
        rest_of = []
        one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__copies"))
    else:
        # the columns travel as one: an aggregate and a check for each of many columns is code too long to be compiled well
        rest_of = [F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("__r")]
        one = right.select(*keys, *rest_of).groupBy(*keys).agg(F.count(F.lit(1)).alias("__copies"), F.first("__r").alias("__r"))
    joined = left.join(one, on=keys, how="left")
    own = [quoted(c) for c in joined.columns if c in left.columns]
    if not rest:
        return joined.select(*own)
    bad = F.raise_error(F.concat(F.lit("the join would repeat rows: duplicate key "), F.to_json(F.struct(*keys))))
    fine = F.col("__copies").isNull() | (F.col("__copies") == 1)
    checked = joined.select(*own, F.when(fine, F.col("__r")).otherwise(bad.cast(one.schema["__r"].dataType)).alias("__r"))
    return checked.select(*own, *[F.col(f"__r.c{i}").alias(c) for i, c in enumerate(rest)])


def left_join_unique(left: DataFrame, right: DataFrame, on: str | Sequence[str],
                     check: bool = True) -> DataFrame:
    """J10 + J11: left enrichment join that must keep the row count.

    The checked form stores the result (reliable checkpoint), and a key that
    would repeat rows raises in that write."""
    if not check:
        return left.join(right, on=[on] if isinstance(on, str) else list(on), how="left")
    try:
        return cut_lineage(guarded_left_join(left, right, on))
    except Exception as e:
        if "duplicate key" in str(e):
            raise ValueError("the join would repeat rows: " + str(e)[str(e).index("duplicate key"):].split("\n")[0]) from e
        raise


def pair_start_end(cases: DataFrame, case_col: str = "Case_ID", type_col: str = "Operationshændelse",
                   ts_col: str = "Operationshændelses_Tidspunkt", status_col: str = "Status",
                   start_type: str = "Knivtid/procedure start", start_status: str = "Fuldført",
                   end_type: str = "Sidste sutur/procedure slut", id_col: str = "CPR_hash",
                   first_end: bool = False) -> DataFrame:
    """J12 + P7: start rows (type and status) left-joined to end rows of the
    same case (end rows are not status-filtered and may be several).
    ``first_end`` pairs every start with the case's earliest end only, so
    that the result has a row per start."""
    starts = cases.where((F.col(type_col) == start_type) & (F.col(status_col) == start_status)) \
                  .select(id_col, case_col, F.col(ts_col).alias("knife_time"))
    ends = cases.where(F.col(type_col) == end_type).select(case_col, F.col(ts_col).alias("knife_time_end"))
    if first_end:
        ends = ends.groupBy(case_col).agg(F.min("knife_time_end").alias("knife_time_end"))
    out = starts.join(ends, on=case_col, how="left")
    return out.withColumn("elapsed_knife_time_minutes",
                          F.expr(micros_sql("knife_time", "knife_time_end")) / F.lit(60_000_000.0))
