"""Rank metrics without a global window.

Scores are first reduced to per-distinct-score label counts (partial
aggregation), then running sums over the score order are computed per
score-range bucket (range bounds from ``approxQuantile``; exactness does not
depend on them) with a carried offset per bucket -- never one task over all
scores.  AUROC averages ties; AP sums over distinct scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache
from hashlib import md5
from itertools import groupby
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..operators.ordered import ordered_scan
from ..session import cut_lineage, shuffle_partitions


def _score_bucket(df: DataFrame, score: str, n_buckets: int | None = None, out: str = "__sb") -> DataFrame:
    spark = df.sparkSession
    n = n_buckets or max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / n for i in range(1, n)]
    qs = df.approxQuantile(score, probs, 0.001) if probs else []
    splits = [-math.inf] + sorted({q for q in qs if q is not None and not math.isnan(q)}) + [math.inf]
    b = Bucketizer(splits=splits, inputCol=score, outputCol=out, handleInvalid="keep")
    return b.transform(df.withColumn(score, F.col(score).cast("double")))


def score_counts(df: DataFrame, label: str, score: str, keys: tuple[str, ...] = (),
                 weight: str | None = None) -> DataFrame:
    """Positives / negatives per distinct score (optionally weighted)."""
    w = F.col(weight) if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    return df.groupBy(*keys, F.col(score).cast("double").alias("__score")).agg(
        F.sum(w * y).alias("__np"), F.sum(w * (1 - y)).alias("__nn"))


def _running_desc(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Inclusive running sums from the highest score down: ``tp`` (positives
    with score >= s), ``fp_all`` (rows with score >= s), ``neg_ge``."""
    d = counts.withColumn("__neg_score", -F.col("__score"))
    b = _score_bucket(d, "__neg_score")
    return ordered_scan(b, list(keys), ["__neg_score"], "__sb",
                        cumsum={"__tp": "__np", "__neg_ge": "__nn", "__k": F.col("__np") + F.col("__nn")})


def _metric_aggs(keys: tuple[str, ...] = ()) -> list[F.Column]:
    """AUROC (ties averaged) and AP from the descending sums, no totals needed
    per row:  AUC*P*N = N*P - sum(np*neg_ge) + 0.5*sum(np*nn);
    AP*P = sum(np * tp / k)."""
    P, N = F.sum("__np"), F.sum("__nn")
    auc_num = N * P - F.sum(F.col("__np") * F.col("__neg_ge")) + 0.5 * F.sum(F.col("__np") * F.col("__nn"))
    ap_num = F.sum(F.when(F.col("__np") > 0, F.col("__np") * F.col("__tp") / F.col("__k")).otherwise(F.lit(0.0)))
    return [F.try_divide(auc_num, P * N).alias("auroc"), F.try_divide(ap_num, P).alias("ap"),
            P.alias("__P"), N.alias("__N")]


def auroc_ap(df: DataFrame, label: str, score: str, alpha: float = 0.95, keys: Sequence[str] = ()) -> DataFrame:
    """M2 + M3 point estimates in one pass: one row per ``keys`` (one in all
    without any) of ``auroc, auroc_var, auroc_ci_low, auroc_ci_high, ap, n,
    n_positive`` (metrics null when a class is missing).  AUROC variance is
    the closed form ``(A/(2-A) - A^2)/N_neg + (2A^2/(1+A) - A^2)/N_pos`` with
    a normal CI clipped to [0, 1].

    The running sums of all keys are one scan over (keys, score range), so
    99 cutoffs cost one job, and one hot key is many tasks."""
    keys = tuple(keys)
    r = _running_desc(score_counts(df, label, score, keys), keys)
    out = r.groupBy(*keys).agg(*_metric_aggs())
    z = NormalDist().inv_cdf(1 - (1 - alpha) / 2)
    a = F.col("auroc")
    var = F.try_divide(a / (2 - a) - a * a, F.col("__N")) + F.try_divide(2 * a * a / (1 + a) - a * a, F.col("__P"))
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    return out.select(*keys, "auroc", var.alias("auroc_var"),
                      F.greatest(F.lit(0.0), F.least(F.lit(1.0), a - z * sd)).alias("auroc_ci_low"),
                      F.greatest(F.lit(0.0), F.least(F.lit(1.0), a + z * sd)).alias("auroc_ci_high"),
                      "ap", (F.col("__P") + F.col("__N")).cast("bigint").alias("n"),
                      F.col("__P").cast("bigint").alias("n_positive"))


@cache
def _poisson_cdf(mean: int) -> list[float]:
    """Cumulative probabilities of Poisson(mean) up to the last one below 1 in double precision."""
    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        if total >= 1.0 or (k > mean and out and total <= out[-1]):
            return out
        out.append(total)
        k += 1


def poisson_draw(u: F.Column, mean: int = 1) -> F.Column:
    """Inverse CDF of Poisson(mean) for ``u`` in [0, 1): how many thresholds it has passed."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in _poisson_cdf(mean)]), lambda c: c <= u))


DRAW_BITS = 8          # counts below 2^8 are drawn exactly
_UNIT = float(1 << 52)


def _uniforms(names: Sequence[bytes], draws: Sequence[bytes]) -> np.ndarray:
    """The hash of every name and draw as a number in [0, 1): a row per name, a column per draw."""
    hashes = b"".join([md5(n + d, usedforsecurity=False).digest() for n in names for d in draws])
    return ((np.frombuffer(hashes, ">u8")[::2] >> 12) / _UNIT).reshape(len(names), len(draws))  # 13 hexadecimal digits


def _weights(n: np.ndarray, names: Sequence[bytes], draws: Sequence[bytes]) -> np.ndarray:
    """Poisson(n) of every row in every draw, from hashes of the row's name and the draw's: a row's n is its mean.

    Below 2^8 it is the sum of exact draws (inverse CDF) for the bits of ``n``; above, the normal quantile with the
    first correction term (off by O(1/n) in probability, far below the noise of 1000 resamples)."""
    def uniforms(rows: np.ndarray, part: str) -> np.ndarray:
        return _uniforms([names[i] for i in rows], [d + f"|{part}".encode() for d in draws])

    out, exact = np.zeros((len(n), len(draws)), "int64"), n < 1 << DRAW_BITS
    for j in range(DRAW_BITS):
        if len(rows := np.flatnonzero(exact & (n >> j & 1 == 1))):
            out[rows] += np.searchsorted(_poisson_cdf(1 << j), uniforms(rows, str(j)), side="right")
    if len(rows := np.flatnonzero(~exact)):
        mean = n[rows, None].astype("float64")
        z = np.sqrt(-2 * np.log(1 - uniforms(rows, "r"))) * np.cos(2 * math.pi * uniforms(rows, "a"))
        out[rows] = np.maximum(0.0, np.floor(mean + z * np.sqrt(mean) + (z * z - 1) / 6 + 0.5))
    return out


def poisson_weight(n: F.Column, name: F.Column) -> F.Column:
    """The sum of ``n`` independent Poisson(1) weights, drawn at once as Poisson(n) from hashes of ``name`` (see :func:`_weights`)."""
    @F.pandas_udf("bigint")
    def weight(n: pd.Series, name: pd.Series) -> pd.Series:
        known = n.notna() & name.notna()
        drawn = _weights(n[known].to_numpy("int64"), [x.encode() for x in name[known]], [b""])[:, 0]
        return pd.Series(drawn, n.index[known]).reindex(n.index).astype("Int64")
    return weight(n.cast("bigint"), name)


BLOCK = 200_000  # draws held at once


def _resampled_ap(batches: Iterator[pa.RecordBatch], keys: Sequence[str], step: int, n_bootstraps: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows ``keys, b, __name, __scored, __np, __nn``, those of one (keys, b) together and from the highest score down ->
    ``keys, b, ap`` of the ``step`` resamples from ``b`` on.  Only the running sums of the current group are held.

    Positives without a score (null) come first and count as positives, but add no precision of their own."""
    group, head, first = None, None, 0
    tp = k = ap = seen = np.zeros(0)

    def result() -> Iterator[pa.RecordBatch]:
        if head is not None and len(both := np.flatnonzero((tp > 0) & (k > tp))):
            yield pa.RecordBatch.from_arrays(
                [*head.take(pa.array(np.zeros(len(both), "int64"))).columns, pa.array((first + both).astype("int32")),
                 pa.array(ap[both] / tp[both], mask=seen[both] == 0)],
                [*keys, "b", "ap"])

    for batch in batches:
        n = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("__np", "__nn")]
        scored = batch.column("__scored").to_numpy(zero_copy_only=False)[:, None]
        names = [x.encode() for x in batch.column("__name").to_pylist()]
        of = [repr(x) for x in zip(*[batch.column(c).to_pylist() for c in (*keys, "b")])]
        for name, rows in groupby(range(len(of)), of.__getitem__):
            at = list(rows)
            if name != group:
                yield from result()
                group, head, first = name, batch.select(list(keys)).slice(at[0], 1), batch.column("b")[at[0]].as_py()
                bs = range(first, min(first + step, n_bootstraps))
                draws = [[f"{b}|{seed}|{y}".encode() for b in bs] for y in (1, 0)]
                tp, k, ap, seen = (np.zeros(len(bs)) for _ in range(4))
            size = max(1, BLOCK // len(draws[0]))
            for lo in range(at[0], at[-1] + 1, size):
                hi = min(lo + size, at[-1] + 1)
                pos, neg = (_weights(x[lo:hi], names[lo:hi], d) for x, d in zip(n, draws))
                tps, ks = tp + np.cumsum(pos, axis=0), k + np.cumsum(pos + neg, axis=0)
                ap = ap + np.divide(pos * tps, ks, out=np.zeros(pos.shape), where=(pos > 0) & scored[lo:hi]).sum(axis=0)
                seen = seen + ((pos + neg > 0) & (scored[lo:hi] | (pos == 0))).sum(axis=0)
                tp, k = tps[-1], ks[-1]
    yield from result()


def bootstrap_ap(df: DataFrame, label: str, score: str, n_bootstraps: int = 1000, seed: int = 42,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Average precision of each Poisson resample: ``keys, b, ap`` (resamples that hold both classes).

    A row's weight in a resample is Poisson(1); rows of one score and label are
    alike, and the sum of n such weights is Poisson(n), so a resample draws one
    weight per distinct score and label: the work is distinct scores times
    resamples, however many rows there are.  The draws are hashes of (keys,
    score, label, resample, seed).

    The counts, not the draws, are shuffled: a task goes down the sorted scores
    of its keys once for all resamples it has, and the resamples of few keys are
    dealt over many tasks."""
    keys, spark = tuple(keys), df.sparkSession
    counts = cut_lineage(score_counts(df, label, score, keys))
    parts = shuffle_partitions(spark)
    groups = counts.select(*keys).distinct().count() if keys else 1
    step = -(-n_bootstraps // min(n_bootstraps, -(-4 * parts // max(1, groups))))
    neg = -F.col("__score")
    rows = counts.where(F.col("__np").isNotNull() & F.col("__nn").isNotNull()).select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(n_bootstraps - 1), F.lit(step))).alias("b"),
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("__score").cast("string"), F.lit("")).alias("__name"),
        neg.alias("__neg_score"), neg.isNotNull().alias("__scored"),
        F.col("__np").cast("bigint").alias("__np"), F.col("__nn").cast("bigint").alias("__nn"))
    order = [*keys, "b"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "__neg_score")  # null, from the highest down, NaN
    types = [counts.schema[c] for c in keys] + [StructField("b", IntegerType()), StructField("ap", DoubleType())]
    return rows.select(*order, "__name", "__scored", "__np", "__nn").mapInArrow(
        lambda batches: _resampled_ap(batches, keys, step, n_bootstraps, seed), StructType(types))


def ap_interval(df: DataFrame, label: str, score: str, alpha: float = 0.95, n_bootstraps: int = 1000, seed: int = 42,
                keys: Sequence[str] = ()) -> DataFrame:
    """M3 interval: ``keys, ap_ci_low, ap_ci_high, n_resamples`` by the percentiles of :func:`bootstrap_ap`."""
    aps = bootstrap_ap(df, label, score, n_bootstraps, seed, keys)
    by = aps.groupBy(*keys).agg(F.array_sort(F.collect_list("ap")).alias("v"))  # at most ``n_bootstraps`` numbers
    n = F.size("v")

    def at(share: float) -> F.Column:
        return F.get("v", F.least(n - 1, F.floor(F.lit(share) * n).cast("int")))
    return by.select(*keys, at((1.0 - alpha) / 2).alias("ap_ci_low"), at((1.0 + alpha) / 2).alias("ap_ci_high"),
                     n.cast("bigint").alias("n_resamples"))


def bootstrap_ap_ci(df: DataFrame, label: str, score: str, alpha: float = 0.95, n_bootstraps: int = 1000,
                    seed: int = 42) -> tuple[float, float]:
    """The interval as two numbers; NaN when no resample holds both classes."""
    row = ap_interval(df, label, score, alpha, n_bootstraps, seed).first()
    if row is None or row["ap_ci_low"] is None:
        return float("nan"), float("nan")
    return row["ap_ci_low"], row["ap_ci_high"]
