"""Exact selection by rank for groups of any size (A1)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HOT_GROUP = 1 << 20    # rows of a group whose median one task may take


def _value_ranges(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the number of its value's range; ranges hold about equally many rows (their bounds need not be exact)."""
    n = max(2, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({q for q in df.approxQuantile(value, [i / n for i in range(1, n)], 0.0005) if q is not None and not math.isnan(q)})
    return Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=value, outputCol=out, handleInvalid="keep").transform(df)


def _large_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median of each group by counting: rows per value range, then ranks inside the one or two ranges that hold the middle.

    Every step is a map-side combined count: a range's rows of one value are
    one row, and no task sees more than a range's distinct values."""
    ranged = cut_lineage(_value_ranges(df.select(*keys, value), value, "__range"))
    per = ranged.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys).orderBy("__range")
    before = F.sum("__c").over(w) - F.col("__c")
    n = F.sum("__c").over(Window.partitionBy(*keys))
    per = per.select(*keys, "__range", "__c", before.alias("__before"), n.alias("__n"))
    lo, hi = F.expr("(__n - 1) div 2") - F.col("__before"), F.expr("__n div 2") - F.col("__before")
    holds = lambda r: (r >= 0) & (r < F.col("__c"))
    asked = per.where(holds(lo) | holds(hi)).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__asked"),
                                                    lo.alias("__lo"), hi.alias("__hi"))
    same = F.col("__range") == F.col("__asked")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    values = ranged.join(asked, same).groupBy(*keys, "__range", "__lo", "__hi", value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys, "__range").orderBy(value)
    values = values.withColumn("__before", F.sum("__c").over(w) - F.col("__c"))
    at = lambda rank: F.max(F.when((F.col(rank) >= F.col("__before")) & (F.col(rank) < F.col("__before") + F.col("__c")), F.col(value)))
    return values.groupBy(*keys).agg(((at("__lo") + at("__hi")) / 2).alias("median"))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, hot: int = HOT_GROUP) -> DataFrame:
    """``keys, median`` of the non-null numbers of ``value``.

    Groups of at most ``hot`` rows use the built-in aggregate, whose buffer
    holds a group's distinct values; larger ones are selected by counting
    over all tasks.  Both are exact."""
    keys = list(keys)
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value))
    large = cut_lineage(d.groupBy(*keys).count().where(F.col("count") > hot).select(*[F.col(k).alias(f"__l_{k}") for k in keys]))
    if large.isEmpty():
        return d.groupBy(*keys).agg(F.median(value).alias("median"))
    same = F.lit(True)
    for k in keys:
        same = same & d[k].eqNullSafe(large[f"__l_{k}"])
    small = d.join(large, same, "left_anti").groupBy(*keys).agg(F.median(value).alias("median"))
    return small.unionByName(_large_medians(d.join(large, same, "left_semi"), keys, value))
