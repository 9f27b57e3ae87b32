"""Aggregations (A1-A14).  All are single ``groupBy().agg`` plans with
partial (map-side) aggregation; first/last use ``min_by``/``max_by`` over a
total order ``(TIMESTAMP, VALUE)`` so they are deterministic and combinable.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import numeric_column
from .selection import HOT_GROUP, exact_median

NUMERIC_AGGS = ("first", "last", "mean", "max", "min", "std", "sum", "count")
WIDE_NUMERIC_AGGS = ("first", "last", "min", "max", "mean", "std", "count", "median")


def _numeric_agg(name: str, v: Column, order: Column) -> Column:
    return {
        "first": F.min_by(v, order),
        "last": F.max_by(v, order),
        "mean": F.avg(v),
        "max": F.max(v),
        "min": F.min(v),
        "std": F.stddev_samp(v),
        "sum": F.sum(v),
        "count": F.count(v).cast("double"),
        "median": F.median(v),
    }[name]


def _ordered(v: Column, ts: str) -> Column:
    # first/last skip nulls: rows with a null value never win
    return F.when(v.isNotNull(), F.struct(F.col(ts).alias("t"), v.alias("v")))


def bin_aggregate(binned: DataFrame, agg_func: str = "mean", is_categorical: bool = False,
                  is_multi_label: bool = False, keys: Sequence[str] = ("PID", "bin_counter"),
                  ts_col: str = "TIMESTAMP") -> DataFrame:
    """Per-bin aggregate of the long model (A4 numeric, A5 categorical,
    A6 multi-label).  Unknown numeric names fall back to mean, unknown
    categorical names to last.  Numeric VALUE is coerced (invalid -> null,
    dropped).  Output: ``keys + FEATURE + VALUE``.
    """
    k = [*keys, "FEATURE"]
    if is_categorical and is_multi_label:
        return binned.select(*k, "VALUE").distinct()
    if is_categorical:
        v = F.col("VALUE").cast("string")
        if agg_func == "mode":
            agg = F.mode(v, True)
        elif agg_func == "first":
            agg = F.min_by(v, _ordered(v, ts_col))
        else:
            agg = F.max_by(v, _ordered(v, ts_col))
        return binned.where(v.isNotNull()).groupBy(*k).agg(agg.alias("VALUE"))
    name = agg_func if agg_func in NUMERIC_AGGS else "mean"
    d = binned.withColumn("__v", numeric_column(binned, "VALUE")).where(F.col("__v").isNotNull())
    agg = _numeric_agg(name, F.col("__v"), F.struct(F.col(ts_col), F.col("__v")))
    return d.groupBy(*k).agg(agg.cast("double").alias("VALUE"))


def bin_aggregates(binned: DataFrame, agg_funcs: Sequence[str], is_categorical: bool = False, is_multi_label: bool = False,
                   keys: Sequence[str] = ("PID", "bin_counter"), ts_col: str = "TIMESTAMP") -> DataFrame:
    """All of ``agg_funcs`` of :func:`bin_aggregate` in one ``groupBy``:
    ``keys + FEATURE + aggs``, where ``aggs`` is an array of (agg_func,
    VALUE); VALUE is text for categories and a number otherwise."""
    k = [*keys, "FEATURE"]
    names = list(dict.fromkeys(agg_funcs))
    if is_categorical and is_multi_label:
        d = binned.select(*k, F.col("VALUE").cast("string").alias("VALUE")).distinct()
        return d.select(*k, F.array(*[F.struct(F.lit(a).alias("agg_func"), "VALUE") for a in names]).alias("aggs"))
    if is_categorical:
        v = F.col("VALUE").cast("string")
        pick = {"mode": F.mode(v, True), "first": F.min_by(v, _ordered(v, ts_col))}
        exprs = [pick.get(a, F.max_by(v, _ordered(v, ts_col))) for a in names]
        d = binned.where(v.isNotNull())
    else:
        v, order = F.col("__v"), F.struct(F.col(ts_col), F.col("__v"))
        exprs = [_numeric_agg(a if a in NUMERIC_AGGS else "mean", v, order).cast("double") for a in names]
        d = binned.withColumn("__v", numeric_column(binned, "VALUE")).where(v.isNotNull())
    found = d.groupBy(*k).agg(*[e.alias(f"__{i}") for i, e in enumerate(exprs)])
    return found.select(*k, F.array(*[F.struct(F.lit(a).alias("agg_func"), F.col(f"__{i}").alias("VALUE"))
                                      for i, a in enumerate(names)]).alias("aggs"))


def attach_all_to_bins(bins: DataFrame, found: DataFrame, agg_funcs: Sequence[str],
                       keys: Sequence[str] = ("PID", "bin_counter")) -> DataFrame:
    """A10 for :func:`bin_aggregates`: one join for all aggregates, then a row
    per aggregate (``agg_func``); each aggregate has every bin, as
    :func:`attach_to_bins` gives it."""
    return each_aggregate(bins.join(found, on=list(keys), how="left"), agg_funcs)


def each_aggregate(attached: DataFrame, agg_funcs: Sequence[str]) -> DataFrame:
    """A row per bin and aggregate from bins with their array ``aggs`` (null: an all-null row per aggregate)."""
    names = list(dict.fromkeys(agg_funcs))
    value = attached.schema["aggs"].dataType.elementType["VALUE"].dataType
    empty = F.array(*[F.struct(F.lit(a).alias("agg_func"), F.lit(None).cast(value).alias("VALUE")) for a in names])
    out = attached.withColumn("__a", F.explode(F.coalesce("aggs", empty)))
    out = out.withColumn("agg_func", F.col("__a.agg_func")).withColumn("VALUE", F.col("__a.VALUE")).drop("__a", "aggs")
    return out.where(HAS_VALUE)


# rows with FEATURE but no VALUE (std of one value) are dropped, so a bin whose only aggregates are null disappears
HAS_VALUE = "NOT (FEATURE IS NOT NULL AND VALUE IS NULL)"


def attach_to_bins(bins: DataFrame, agg: DataFrame, keys: Sequence[str] = ("PID", "bin_counter")) -> DataFrame:
    """A10: every bin once (all-null row when empty) plus its aggregates;
    rows with FEATURE but no VALUE (std of one value) are dropped, so a bin
    whose only aggregates are null disappears."""
    return bins.join(agg, on=list(keys), how="left").where(HAS_VALUE)


def numeric_wide(long: DataFrame, concept: str, agg_funcs: Sequence[str] = WIDE_NUMERIC_AGGS,
                 features: Sequence[str] | None = None, id_col: str = "PID",
                 ts_col: str = "TIMESTAMP", hot_group: int = HOT_GROUP) -> tuple[DataFrame, list[str]]:
    """A1 + A2 + R4: per (PID, FEATURE) aggregates pivoted to
    ``{FEATURE}_{concept}_{agg}``; nulls -> 0.0 (so a single value's std is
    0.0).  Unknown agg names are ignored.  ``features`` is the pivot list
    (derived with one distinct job when omitted)."""
    aggs = [a for a in agg_funcs if a in WIDE_NUMERIC_AGGS]
    d = long.withColumn("__v", numeric_column(long, "VALUE")).where(F.col("__v").isNotNull())
    if features is None:
        features = _pivot_list(d, "FEATURE")
    order = F.struct(F.col(ts_col), F.col("__v"))
    names = {(i, a): f"{f}_{concept}_{a}" for i, f in enumerate(features) for a in aggs}
    wide = None
    for part in ([a for a in aggs if a != "median"], [a for a in aggs if a == "median"]):
        if not part:
            continue
        # the median of a hot group is selected by counting over all tasks; everything else combines map-side
        src = exact_median(d, [id_col, "FEATURE"], "__v", hot_group) if part == ["median"] else d
        exprs = [F.max("median").alias("median")] if part == ["median"] else \
            [_numeric_agg(a, F.col("__v"), order).cast("double").alias(a) for a in part]
        p = src.groupBy(id_col).pivot("FEATURE", list(features)).agg(*exprs)
        p = p.select(id_col, *[F.col(_quoted(f"{f}_{a}" if len(part) > 1 else f)).alias(f"__{i}_{a}")
                               for i, f in enumerate(features) for a in part])
        wide = p if wide is None else wide.join(p, id_col, "left")
    if wide is None:
        wide = d.select(id_col).distinct()
    return wide.select(id_col, *[F.coalesce(F.col(f"__{i}_{a}"), F.lit(0.0)).alias(dst) for (i, a), dst in names.items()]), \
        list(names.values())


def _quoted(name: str) -> str:
    """A column name that may hold dots and back-ticks."""
    return "`" + name.replace("`", "``") + "`"


MAX_PIVOT = 10_000  # columns of a derived pivot list; more raise, so nothing is left out unseen


def _pivot_list(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct values for a pivot that was given no list."""
    found = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(MAX_PIVOT + 1).collect()]
    if len(found) > MAX_PIVOT:
        raise ValueError(f"{col} has over {MAX_PIVOT} values: keep the long form or give the list of columns")
    return sorted(found)


def clean_name(v: str) -> str:
    """Column-name cleaning of categorical values."""
    return str(v).replace(" ", "_").replace("/", "_").replace("-", "_")


def categorical_wide(long: DataFrame, concept: str, values: Sequence[str] | None = None,
                     id_col: str = "PID") -> tuple[DataFrame, list[str], list[str]]:
    """A3: per (PID, VALUE) count and 0/1 given, pivoted to
    ``{clean(VALUE)}_{concept}_count`` / ``_given``.  Returns the frame and
    the given / count column lists."""
    d = long.where(F.col("VALUE").isNotNull()).withColumn("VALUE", F.col("VALUE").cast("string"))
    if values is None:
        values = _pivot_list(d, "VALUE")
    clash = [k for k, n in Counter(clean_name(v) for v in values).items() if n > 1]
    if clash:
        raise ValueError(f"values of {concept} share the column names {', '.join(sorted(clash))}")
    p = d.groupBy(id_col).pivot("VALUE", list(values)).agg(F.count(F.lit(1)).cast("bigint"))
    given, count = [], []
    sel = [F.col(id_col)]
    for v in values:
        c = F.coalesce(F.col(_quoted(v)), F.lit(0)).cast("bigint")
        g = f"{clean_name(v)}_{concept}_given"
        n = f"{clean_name(v)}_{concept}_count"
        sel += [(c > 0).cast("bigint").alias(g), c.alias(n)]
        given.append(g)
        count.append(n)
    return p.select(*sel), given, count


def first_non_null_per_column(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                              cols: Sequence[str]) -> DataFrame:
    """Per group, the first non-null value of each column in ``order``."""
    o = F.struct(*[F.col(c) for c in order])
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c) for c in cols]
    return df.groupBy(*keys).agg(*aggs)


def cohort_summary(df: DataFrame, target: str) -> DataFrame:
    """Rows, positives, positive rate."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                  F.sum(F.col(target)).cast("bigint").alias("n_positive"),
                  F.avg(F.col(target).cast("double")).alias("positive_rate"))
