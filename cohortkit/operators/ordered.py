"""Ordered (running) operators that never put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to
one task: a patient (or a score range) holding a third of all rows becomes
one straggler.  Here rows are first split into *buckets* that are monotone
in the order (time buckets, or range buckets of the order key).  The window
runs per ``(key, bucket)``; a tiny per-bucket summary (last value, first
value, total) is carried across buckets with a window over the summary
only, then joined back.  Results equal the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def time_bucket(col: str | Column, width_seconds: int = 86400) -> Column:
    """Monotone bucket id of a timestamp (default: calendar day)."""
    c = F.col(col) if isinstance(col, str) else col
    secs = F.timestamp_diff("SECOND", F.expr(EPOCH_NTZ), c)
    return F.floor(secs / F.lit(width_seconds)).cast("bigint")


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                 bucket: str | None = None, *, lag: dict[str, str] | None = None,
                 lead: dict[str, str] | None = None,
                 cumsum: dict[str, str | Column] | None = None, last: dict[str, str] | None = None) -> DataFrame:
    """Add previous-row, next-row, running-sum and last-non-null columns per ``keys``.

    ``order`` must be a total, ascending, non-null order inside ``keys``;
    ``bucket`` (a column of ``df``) must be non-decreasing along it.
    ``bucket=None`` uses the plain window (for keys with bounded size).
    """
    lag, lead, cumsum, last = lag or {}, lead or {}, cumsum or {}, last or {}
    order_c = _cols(order)
    for out, c in cumsum.items():
        df = df.withColumn(f"__os_v_{out}", (F.col(c) if isinstance(c, str) else c))
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order_c) if keys else Window.orderBy(*order_c)
        for out, c in lag.items():
            df = df.withColumn(out, F.lag(c).over(w))
        for out, c in lead.items():
            df = df.withColumn(out, F.lead(c).over(w))
        wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for out in cumsum:
            df = df.withColumn(out, F.sum(f"__os_v_{out}").over(wr)).drop(f"__os_v_{out}")
        for out, c in last.items():
            df = df.withColumn(out, F.last(c, ignorenulls=True).over(wr))
        return df

    pk = [*keys, bucket]
    w = Window.partitionBy(*pk).orderBy(*order_c)
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordkey = F.struct(*order_c)
    aggs = []
    out = df.withColumn("__os_first", F.row_number().over(w) == 1) \
            .withColumn("__os_last", F.lead(F.lit(1)).over(w).isNull())
    for o, c in lag.items():
        out = out.withColumn(f"__os_l_{o}", F.lag(c).over(w))
        aggs.append(F.max_by(F.col(c), ordkey).alias(f"__os_lastv_{o}"))
    for o, c in lead.items():
        out = out.withColumn(f"__os_n_{o}", F.lead(c).over(w))
        aggs.append(F.min_by(F.col(c), ordkey).alias(f"__os_firstv_{o}"))
    for o in cumsum:
        out = out.withColumn(f"__os_c_{o}", F.sum(f"__os_v_{o}").over(wr))
        aggs.append(F.sum(f"__os_v_{o}").alias(f"__os_tot_{o}"))
    for o, c in last.items():
        out = out.withColumn(f"__os_a_{o}", F.last(c, ignorenulls=True).over(wr))
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ordkey)).alias(f"__os_la_{o}"))
    # The summary is taken from the windowed frame: it is already partitioned
    # by (keys, bucket), so the aggregate needs no new shuffle and the input
    # is scanned once (the window's exchange is reused).
    summ = out.groupBy(*pk).agg(*aggs)
    sw = Window.partitionBy(*keys).orderBy(bucket) if keys else Window.orderBy(bucket)
    keep = list(pk)
    for o in lag:
        summ = summ.withColumn(f"__os_pl_{o}", F.lag(f"__os_lastv_{o}").over(sw))
        keep.append(f"__os_pl_{o}")
    for o in lead:
        summ = summ.withColumn(f"__os_nf_{o}", F.lead(f"__os_firstv_{o}").over(sw))
        keep.append(f"__os_nf_{o}")
    for o in cumsum:
        summ = summ.withColumn(
            f"__os_off_{o}",
            F.coalesce(F.sum(f"__os_tot_{o}").over(sw.rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0)))
        keep.append(f"__os_off_{o}")
    for o in last:
        summ = summ.withColumn(f"__os_pa_{o}", F.last(f"__os_la_{o}", ignorenulls=True).over(
            sw.rowsBetween(Window.unboundedPreceding, -1)))
        keep.append(f"__os_pa_{o}")
    out = out.join(summ.select(*keep), on=pk, how="left")
    for o in lag:
        out = out.withColumn(o, F.when(F.col("__os_first"), F.col(f"__os_pl_{o}"))
                             .otherwise(F.col(f"__os_l_{o}")))
    for o in lead:
        out = out.withColumn(o, F.when(F.col("__os_last"), F.col(f"__os_nf_{o}"))
                             .otherwise(F.col(f"__os_n_{o}")))
    for o in cumsum:
        out = out.withColumn(o, F.col(f"__os_c_{o}") + F.col(f"__os_off_{o}"))
    for o in last:
        out = out.withColumn(o, F.coalesce(f"__os_a_{o}", f"__os_pa_{o}"))
    return out.drop(*[c for c in out.columns if c.startswith("__os_")])


def range_buckets(df: DataFrame, order: Sequence[str], n_buckets: int | None = None,
                  name: str = "__rb") -> DataFrame:
    """Attach a range-partition id (monotone in ``order``) and cut lineage.

    The checkpoint freezes the sampled range bounds: a re-sampled range
    shuffle is not guaranteed to put a row in the same partition again, so
    every use of the bucket id must read the stored assignment (which also
    survives executor loss).
    """
    # Without an explicit count the range shuffle is sized by AQE from the
    # data (advisory partition size); coalesced ranges stay contiguous, so
    # the id is still monotone in ``order``.  The range sample and the
    # shuffle both read the input: keep it for the duration of the
    # checkpoint so it is computed once (lost blocks are recomputed).
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        parts = src.repartitionByRange(n_buckets, *order) if n_buckets else src.repartitionByRange(*order)
        ranged = parts.withColumn(name, F.spark_partition_id().cast("bigint"))
        return cut_lineage(ranged)
    finally:
        src.unpersist()


def dense_rank_global(df: DataFrame, key_cols: Sequence[str], out: str = "PID",
                      n_buckets: int | None = None) -> DataFrame:
    """Dense 1-based id of ``key_cols`` in key order, attached to every row
    of ``df`` (K11).

    Rows are range-partitioned on the keys (equal keys share a range) and
    checkpointed; inside a range a key change is seen with ``lag``; the
    running count of key changes plus the count of all earlier ranges is
    the id.  No single-partition window, no join back.
    """
    ranged = range_buckets(df, key_cols, n_buckets)
    w = Window.partitionBy("__rb").orderBy(*key_cols)
    k = F.struct(*[F.col(c) for c in key_cols])
    prev = F.lag(k).over(w)
    ranged = ranged.withColumn("__new", F.when(prev.isNull() | ~prev.eqNullSafe(k), 1).otherwise(0))
    ranked = ordered_scan(ranged, [], list(key_cols), "__rb", cumsum={out: "__new"})
    return ranked.withColumn(out, F.col(out).cast("bigint")).drop("__new", "__rb")


def global_running_sums(df: DataFrame, order: Sequence[str], sums: dict[str, str | Column],
                        n_buckets: int | None = None) -> DataFrame:
    """Running (inclusive) sums in a global order without a global window."""
    ranged = range_buckets(df, order, n_buckets)
    return ordered_scan(ranged, [], list(order), "__rb", cumsum=sums).drop("__rb")
