"""Sinks (S8, S10, S11, S13).  Parquet with overwrite semantics, so a
re-run after a lost executor or a failed job rewrites the same output."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import drop_folder, table_exists


BINNED = ("PID long, bin_start timestamp_ntz, bin_end timestamp_ntz, bin_counter int, bin_freq string, FEATURE string, VALUE string, "
          "concept string, agg_func string")


def fingerprint(df: DataFrame) -> str:
    """Row count and order-free hash of a table's rows (one aggregate; map and variant columns as JSON)."""
    cols = [F.to_json(c) if t.startswith(("map", "variant")) else F.col(f"`{c}`") for c, t in df.dtypes]
    h = F.xxhash64(*cols)
    r = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h).cast("decimal(38,0)"))).first()
    return "-".join(str(v or 0) for v in (*r, *sorted(f"{c}:{t}" for c, t in df.dtypes)))


def _record(root: str, concept: str, agg: str) -> str:
    return f"{root}/_records/concept={concept}/agg_func={agg}"


def write_binned(df: DataFrame, root: str, concept: str, aggs: str | Sequence[str], mark: str = "") -> None:
    """The binned results of a concept, partitioned by concept and
    aggregate so a later load prunes to its partition; ``df`` has an
    ``agg_func`` column when there are several.  Dynamic partition overwrite
    keeps the other partitions.

    A commit record per aggregate is written last: a result counts as stored
    with its record only, so a write that broke off does not count, and an
    empty result does."""
    spark, aggs = df.sparkSession, [aggs] if isinstance(aggs, str) else list(aggs)
    if "agg_func" not in df.columns:
        df = df.withColumn("agg_func", F.lit(aggs[0]))
    for a in aggs:  # from here on the old result does not count; an empty new one would leave its files
        _commit(spark, root, concept, a, UNFINISHED)
        drop_folder(spark, f"{root}/concept={concept}/agg_func={a}")
    rows = df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in BINNED.split(", ")[:7]], F.lit(concept).alias("concept"), "agg_func")
    with unsorted_write(spark, len(set(aggs))):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**COMPACT).partitionBy("concept", "agg_func").parquet(root)
    for a in aggs:
        _commit(spark, root, concept, a, mark)


UNFINISHED = "unfinished"
# times and ids that go up by steps are stored as differences
COMPACT = {"compression": "zstd", "parquet.writer.version": "v2"}
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def unsorted_write(spark: SparkSession, folders: int) -> Iterator[None]:
    """Partitioned writes inside keep a file open per folder (of at most ``folders``) instead of sorting all rows by folder first."""
    old = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, str(folders))
    try:
        yield
    finally:
        spark.conf.set(WRITERS, old)


def _commit(spark: SparkSession, root: str, concept: str, agg: str, mark: str) -> None:
    spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("overwrite").parquet(_record(root, concept, agg))


def binned_exists(spark: SparkSession, root: str, concept: str, agg: str, mark: str = "") -> bool:
    """Whether the result is stored in full, for the input that ``mark`` names."""
    path = _record(root, concept, agg)
    return table_exists(spark, path) and [r[0] for r in spark.read.schema("mark string").parquet(path).collect()] == [mark]


def read_binned(spark: SparkSession, root: str) -> DataFrame:
    """The store of binned results; its partitions are ``concept`` and ``agg_func``."""
    return spark.read.schema(BINNED).parquet(root)


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Feature matrix as parquet (or header CSV)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Id, y_true, y_pred, masking point and time units, partitioned by
    the masking point (up to ``MASKING_POINTS`` are written without a sort)."""
    with unsorted_write(df.sparkSession, MASKING_POINTS):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**COMPACT).partitionBy("masking_point").parquet(path)


MASKING_POINTS = 128  # folders of predictions that a task keeps open; with more it sorts its remaining rows


def write_summary(spark: SparkSession, rows: list[dict], path: str) -> DataFrame:
    """One row per trained model (driver-sized list of metrics)."""
    df = spark.createDataFrame(rows)
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return df
