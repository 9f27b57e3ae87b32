"""Care trajectories: admission counter (W1), gap sessions (W2/K4) with
label collapse (A7), overlap-with-next flag (W5), missing-end fill (W4).

All running operators scan per (patient, bucket): by default range buckets
of (patient, time, ties), so a patient -- or a single patient-day -- with a
huge history is split over many tasks (a fixed time width is optional).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefns import micros_sql
from .ordered import ordered_scan, range_buckets, time_bucket


def _bucketed(d: DataFrame, id_col: str, ts_col: str, tie_cols: Sequence[str],
              bucket_seconds: int | str | None) -> tuple[DataFrame, str | None]:
    """Attach the scan bucket: range buckets of (id, time, ties) -- splits a
    hot patient or patient-day; the sampled ranges are frozen by a reliable
    checkpoint, since re-sampling could move rows between buckets --, a
    fixed time width, or none."""
    if bucket_seconds == "range":
        return range_buckets(d, [id_col, ts_col, *tie_cols], name="__b"), "__b"
    if bucket_seconds:
        return d.withColumn("__b", time_bucket(ts_col, bucket_seconds)), "__b"
    return d, None


def admission_counter(adt: DataFrame, id_col: str = "CPR_hash", ts_col: str = "Flyt_ind",
                      type_col: str = "ADT_haendelse", admit_value: str = "Indlæggelse",
                      tie_cols: Sequence[str] = (), out: str = "trajectory",
                      bucket_seconds: int | str | None = "range") -> DataFrame:
    """Running number of admission rows per patient.

    Rows before the first admission get null (the fill is per patient).
    Rows with a null time are dropped (they cannot be ordered).
    """
    df = adt.where(F.col(ts_col).isNotNull()) \
            .withColumn("__adm", F.when(F.col(type_col) == admit_value, 1).otherwise(0))
    df, bucket = _bucketed(df, id_col, ts_col, tie_cols, bucket_seconds)
    df = ordered_scan(df, [id_col], [ts_col, *tie_cols], bucket, cumsum={"__cnt": "__adm"})
    return df.withColumn(out, F.when(F.col("__cnt") > 0, F.col("__cnt").cast("bigint"))) \
             .drop("__cnt", "__adm", "__b")


def session_ids(df: DataFrame, id_col: str = "CPR_hash", start: str = "start", end: str = "end",
                gap_hours: float = 1.0, tie_cols: Sequence[str] = (), out: str = "group_id",
                bucket_seconds: int | str | None = "range") -> DataFrame:
    """Gap session id per row (W2): a row whose start is at least ``gap``
    after the *previous row's* end (not the running maximum) opens a new
    group; a missing gap keeps the group."""
    gap_us = int(round(gap_hours * 3_600_000_000))
    d, bucket = _bucketed(df.where(F.col(start).isNotNull()), id_col, start, tie_cols, bucket_seconds)
    d = ordered_scan(d, [id_col], [start, *tie_cols], bucket, lag={"__prev_end": end})
    d = d.withColumn("__new", F.coalesce(
        F.expr(micros_sql("__prev_end", start)) >= F.lit(gap_us), F.lit(False)).cast("int"))
    d = ordered_scan(d, [id_col], [start, *tie_cols], bucket, cumsum={out: "__new"})
    return d.withColumn(out, F.col(out).cast("bigint")).drop("__prev_end", "__new", "__b")


def sessionize(df: DataFrame, id_col: str, start: str, end: str, gap_hours: float,
               tie_cols: Sequence[str] = (), bucket_seconds: int | str = "range", admit: F.Column | None = None,
               out: str = "group_id", counter_out: str = "trajectory") -> DataFrame:
    """W2 (+W1) in one bucketed pass: gap-session id per row and, when
    ``admit`` (0/1 column) is given, the running admission counter.

    ``bucket_seconds`` is a time-bucket width, or ``"range"`` (default) for
    checkpointed range buckets of (id, start, ties) that also split a single
    hot patient-day.
    Inside each (id, bucket) one sorted window gives the previous end,
    the local running sum of new-session flags (the bucket's first row is
    settled later) and the local admission count.  A per-bucket summary --
    first start, last end, totals -- is aggregated from the windowed rows
    (same partitioning, no new shuffle), carried across buckets with a
    window over the summary only, and joined back: one large shuffle.
    """
    gap_us = int(round(gap_hours * 3_600_000_000))
    pk = [id_col, "__b"]
    order = [F.col(start), *[F.col(c) for c in tie_cols]]
    d, _ = _bucketed(df.where(F.col(start).isNotNull()), id_col, start, tie_cols, bucket_seconds)
    w = Window.partitionBy(*pk).orderBy(*order)
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__pe", F.lag(end).over(w))
    d = d.withColumn("__f", F.coalesce(F.timestamp_diff("MICROSECOND", F.col("__pe"), F.col(start)) >= gap_us,
                                       F.lit(False)).cast("int"))
    d = d.withColumn("__fc", F.sum("__f").over(wr))
    aggs = [F.max_by(F.col(end), F.struct(*order)).alias("__last_end"), F.min(start).alias("__first_start"),
            F.sum("__f").alias("__fsum")]
    if admit is not None:
        d = d.withColumn("__adm", admit.cast("int")).withColumn("__ac", F.sum("__adm").over(wr))
        aggs.append(F.sum("__adm").alias("__atot"))
    summ = d.groupBy(*pk).agg(*aggs)
    sw = Window.partitionBy(id_col).orderBy("__b")
    before = sw.rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("__ff", F.coalesce(
        F.timestamp_diff("MICROSECOND", F.lag("__last_end").over(sw), F.col("__first_start")) >= gap_us,
        F.lit(False)).cast("int"))
    summ = summ.withColumn("__goff", F.coalesce(F.sum(F.col("__fsum") + F.col("__ff")).over(before), F.lit(0)))
    keep = [*pk, "__ff", "__goff"]
    if admit is not None:
        summ = summ.withColumn("__aoff", F.coalesce(F.sum("__atot").over(before), F.lit(0)))
        keep.append("__aoff")
    j = d.join(summ.select(*keep), pk, "left")
    j = j.withColumn(out, (F.col("__goff") + F.col("__ff") + F.col("__fc")).cast("bigint"))
    if admit is not None:
        cnt = F.col("__ac") + F.col("__aoff")
        j = j.withColumn(counter_out, F.when(cnt > 0, cnt.cast("bigint")))
    return j.drop("__b", "__pe", "__f", "__fc", "__ff", "__goff", "__adm", "__ac", "__aoff")


def collapse_admissions(df: DataFrame, id_col: str = "CPR_hash", start: str = "start",
                        end: str = "end", label_col: str | None = "trajectory",
                        gap_hours: float = 1.0, tie_cols: Sequence[str] = (),
                        bucket_seconds: int | str | None = "range", keep_group_id: bool = False) -> DataFrame:
    """Collapse stays into trajectories (K4): ``(id, start, end, trajectory,
    duration)`` with ``trajectory`` the string-sorted distinct labels joined
    by ``,`` (``1,10,2``), nulls ignored; ``duration`` is an interval."""
    if bucket_seconds:
        g = sessionize(df, id_col, start, end, gap_hours, tie_cols, bucket_seconds, out="__gid")
    else:
        g = session_ids(df, id_col, start, end, gap_hours, tie_cols, "__gid", None)
    aggs = [F.min(start).alias("start"), F.max(end).alias("end")]
    if label_col:
        aggs.append(F.array_join(F.array_sort(F.collect_set(F.col(label_col).cast("bigint").cast("string"))),
                                 ",").alias("trajectory"))
    out = g.groupBy(id_col, "__gid").agg(*aggs)
    out = out.withColumn("duration", F.col("end") - F.col("start"))
    if keep_group_id:
        return out.withColumnRenamed("__gid", "group_id")
    return out.drop("__gid")


def build_trajectories(adt: DataFrame, id_col: str = "CPR_hash", gap_hours: float = 1.0,
                       tie_cols: Sequence[str] = (), admit_value: str = "Indlæggelse",
                       bucket_seconds: int | str = "range", keep_group_id: bool = False) -> DataFrame:
    """K3 + K4: admission counter and gap sessions in one bucketed pass
    (:func:`sessionize`), then the collapse aggregate (A7).

    The counter grows by steps of one along the rows, so the labels of a trajectory
    are all numbers from its first to its last: no set has to be collected."""
    stays = adt.select(id_col, F.col("Flyt_ind").alias("start"), F.col("Flyt_ud").alias("end"),
                       (F.col("ADT_haendelse") == admit_value).alias("__is_adm"), *tie_cols)
    g = sessionize(stays, id_col, "start", "end", gap_hours, tie_cols, bucket_seconds,
                   admit=F.coalesce(F.col("__is_adm"), F.lit(False)), out="__gid")
    out = g.groupBy(id_col, "__gid").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("trajectory").alias("__lo"), F.max("trajectory").alias("__hi"))
    labels = F.array_sort(F.sequence("__lo", "__hi").cast("array<string>"))
    out = out.withColumn("trajectory", F.coalesce(F.array_join(labels, ","), F.lit(""))).drop("__lo", "__hi")
    out = out.withColumn("duration", F.col("end") - F.col("start"))
    return out.withColumnRenamed("__gid", "group_id") if keep_group_id else out.drop("__gid")


def number_trajectories(traj: DataFrame, id_col: str = "CPR_hash", group_col: str = "group_id",
                        out: str = "PID") -> DataFrame:
    """K11 for trajectories: dense 1-based id in (patient, start) order.

    Session ids are already dense per patient in start order, so the id is
    (trajectories of all patients sorting before this one) + session id + 1.
    Only the per-patient count table is put in global order (range buckets,
    :func:`global_running_sums`); trajectories are never sorted globally.
    """
    from .ordered import global_running_sums
    t = traj.persist(StorageLevel.MEMORY_AND_DISK)
    counts = t.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n"))
    offs = global_running_sums(counts, [id_col], {"__cum": "__n"})
    offs = offs.select(id_col, (F.col("__cum") - F.col("__n")).alias("__off"))
    res = t.join(offs, id_col, "inner").withColumn(out, (F.col("__off") + F.col(group_col) + 1).cast("bigint"))
    return res.drop("__off")


def overlap_with_next(df: DataFrame, id_col: str = "CPR_hash", start: str = "start", end: str = "end",
                      tie_cols: Sequence[str] = ("ServiceDate",), out: str = "overlap",
                      bucket_seconds: int | str | None = "range") -> DataFrame:
    """``end > next.start`` in (start, ties) order; last row False."""
    d, bucket = _bucketed(df, id_col, start, tie_cols, bucket_seconds)
    d = ordered_scan(d, [id_col], [start, *tie_cols], bucket, lead={"__next_start": start})
    return d.withColumn(out, F.coalesce(F.col(end) > F.col("__next_start"), F.lit(False))) \
            .drop("__next_start", "__b")


def fill_missing_end(df: DataFrame, id_col: str = "PID", start: str = "Flyt_ind", end: str = "Flyt_ud",
                     fallback_end: str | None = "end", tie_cols: Sequence[str] = (),
                     bucket_seconds: int | str | None = "range") -> DataFrame:
    """Missing end <- next row's start (same id), else the fallback
    column (base end); rows still missing an end are dropped."""
    d, bucket = _bucketed(df.where(F.col(start).isNotNull()), id_col, start, tie_cols, bucket_seconds)
    d = ordered_scan(d, [id_col], [start, *tie_cols], bucket, lead={"__next": start})
    filled = F.coalesce(F.col(end), F.col("__next"), *( [F.col(fallback_end)] if fallback_end else []))
    return d.withColumn(end, filled).drop("__next", "__b").where(F.col(end).isNotNull())
