"""Train / holdout split (K23) and stratified folds (M4)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan, range_buckets


def temporal_split(base: DataFrame, split_date: str, date_col: str = "ServiceDate") -> tuple[DataFrame, DataFrame]:
    """K23 temporal: train ``<= date``, holdout ``> date``; null dates in neither."""
    d = F.lit(split_date).cast("timestamp_ntz")
    return base.where(F.col(date_col) <= d), base.where(F.col(date_col) > d)


def _class_ranks(base: DataFrame, target: str, id_col: str, seed: int) -> DataFrame:
    """1-based rank inside each class in a seeded hash order (md5 of id and
    seed), computed with range buckets -- a class is never one task."""
    if not base.where(F.col(target).isNull()).isEmpty():
        raise ValueError(f"column {target!r} has null classes: drop or fill them before the split")
    h = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    keyed = base.select(id_col, target).withColumn("__h", h)
    ranged = range_buckets(keyed, [target, "__h", id_col])
    return ordered_scan(ranged.withColumn("__one", F.lit(1)), [target], ["__h", id_col], "__rb",
                        cumsum={"__rank": "__one"}).select(id_col, target, "__rank")


def stratified_split(base: DataFrame, target: str, id_col: str = "PID", fraction: float = 0.2,
                     seed: int = 2024) -> tuple[DataFrame, DataFrame]:
    """K23 random: per class the first ``ceil(fraction * n_class)`` ids of a
    seeded hash order go to holdout (exact stratum sizes)."""
    ranks = _class_ranks(base, target, id_col, seed)
    sizes = {r[0]: r[1] for r in base.groupBy(target).count().collect()}  # one row per class
    limits = F.create_map(*[x for k, n in sizes.items()
                            for x in (F.lit(k), F.lit(int(math.ceil(fraction * n))))])
    flagged = ranks.withColumn("__hold", F.col("__rank") <= limits[F.col(target)]).select(id_col, "__hold")
    j = base.join(flagged, id_col, "inner")
    return j.where(~F.col("__hold")).drop("__hold"), j.where(F.col("__hold")).drop("__hold")


def train_test_split(cfg: dict, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K23 dispatcher (+P11 exclusion)."""
    if cfg.get("dataset", {}).get("exclusion") == "lvl1tc":
        base = base.where(F.col("LVL1TC") == 1)
    kind = cfg.get("holdout_type", "temporal")
    if kind == "temporal":
        return temporal_split(base, cfg["holdout_split_date"])
    if kind == "random":
        return stratified_split(base, cfg["target"], cfg["dataset"]["id_col"],
                                cfg.get("holdout_fraction", 0.2), cfg.get("seed", 2024))
    raise ValueError(f"holdout_type is {kind!r}; a split is either 'temporal' or 'random'")


def stratified_folds(df: DataFrame, target: str, id_col: str = "PID", k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """M4: fold = (rank in class - 1) mod k over a seeded hash order."""
    ranks = _class_ranks(df, target, id_col, seed)
    folds = ranks.select(id_col, ((F.col("__rank") - 1) % k).cast("int").alias(out))
    return df.join(folds, id_col, "inner")
