"""Windowing of every catalogued raw table to the cohort."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefns import ts_column
from ..operators.filters import preop_cutoff
from ..operators.joins import filter_by_time_window, window_join
from ..operators.ordered import time_bucket
from ..session import ensure_checkpoint_dir
from ..sources.readers import load_catalogue, read_table, table_exists


def window_table(base: DataFrame, raw: DataFrame, dt_name: str, offset_days: int,
                 end_col: str = "end") -> DataFrame:
    """One table: time column parsed, rows in ``[start - off, end + off]``
    of any window of the patient, with that window's PID (J2)."""
    raw = raw.withColumn(dt_name, ts_column(raw, dt_name))
    return filter_by_time_window(base, raw, dt_name, "start", end_col, offset_days)


def keyed_stream(tables: dict[str, DataFrame], catalogue: list, id_col: str = "CPR_hash") -> DataFrame:
    """All catalogued tables as one stream ``(filename, id, time, offset_days, one struct per table)``.

    A row has its own table's struct and nulls for the others, so that every
    table keeps its columns and types and a table is an equality filter away."""
    rows = {r.filename: r for r in catalogue}
    out = None
    for name, raw in tables.items():
        r = rows[name]
        raw = raw.withColumn(r.dt_colname, ts_column(raw, r.dt_colname))
        part = raw.select(F.lit(name).alias("filename"), F.col(id_col).cast("string").alias("__id"), F.col(r.dt_colname).alias("__t"),
                          F.lit(r.ts_offset).alias("__off"), F.struct(*[F.col(f"`{c}`") for c in raw.columns]).alias(f"t_{name}"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def window_stream(base: DataFrame, stream: DataFrame, start_col: str = "start", end_col: str = "end",
                  id_col: str = "CPR_hash", widest: int = 1) -> DataFrame:
    """Rows of the stream within ``[start - off, end + off]`` days of a window of their id (each table its own
    offset, at most ``widest``), with the window's PID: one join for all tables, duplicates dropped (J2)."""
    slack = F.make_interval(days=F.lit(widest))
    w = base.select(F.col(id_col).cast("string").alias("__id"), "PID", F.col(start_col).alias("__ws"), F.col(end_col).alias("__we"))
    joined = window_join(stream, w, "__id", "__t", F.col("__ws") - slack, F.col("__we") + slack, carry=["PID", "__ws", "__we"],
                         distinct=False)
    off = F.make_interval(days=F.col("__off"))
    inside = joined.where((F.col("__t") >= F.col("__ws") - off) & (F.col("__t") <= F.col("__we") + off)).drop("__ws", "__we")
    # the day of a row goes with its id, as the join has dealt them: duplicates meet without another shuffle
    return inside.withColumn("__b", time_bucket("__t")).distinct().drop("__b")


def split_stream(windowed: DataFrame, name: str) -> DataFrame:
    """One table's rows of a windowed stream, with the table's own columns and PID."""
    return windowed.where(F.col("filename") == name).select("PID", f"t_{name}.*")


def filter_tables(base: DataFrame, tables: dict[str, DataFrame], catalogue: list, end_col: str = "end",
                  id_col: str = "CPR_hash") -> DataFrame:
    """K17 / K18 core: every catalogued table's rows inside the cohort's windows, in one scan and one join."""
    widest = max((r.ts_offset for r in catalogue if r.filename in tables), default=0)
    return window_stream(base, keyed_stream(tables, catalogue, id_col), "start", end_col, id_col, widest)


def filter_subsets(spark: SparkSession, base: DataFrame, raw_root: str, out_root: str,
                   end_col: str = "end", names: list[str] | None = None, reset: bool = False) -> list[str]:
    """K17 core: the catalogue tables present under ``raw_root`` are windowed
    together in one scan, stored as one stage table partitioned by file name,
    and written to ``out_root`` table by table; existing outputs are skipped."""
    rows = load_catalogue(spark, configured=names or ()).collect()  # catalogue: a few dozen rows
    todo = [r for r in rows if (not names or r.filename in names) and table_exists(spark, f"{raw_root}/{r.filename}.parquet")
            and (reset or not table_exists(spark, f"{out_root}/{r.filename}.parquet"))]
    if not todo:
        return []
    windowed = filter_tables(base, {r.filename: read_table(spark, raw_root, r.filename) for r in todo}, todo, end_col)
    stage = f"{ensure_checkpoint_dir(spark)}/windowed-{uuid.uuid4().hex}"
    windowed.write.partitionBy("filename").parquet(stage)
    stored = spark.read.schema(windowed.schema).parquet(stage)
    for r in todo:  # each reads its own partition
        split_stream(stored, r.filename).write.mode("overwrite").parquet(f"{out_root}/{r.filename}.parquet")
    return [r.filename for r in todo]


def filter_subsets_inhospital(spark: SparkSession, base: DataFrame, raw_root: str, out_root: str, **kw) -> list[str]:
    """window = [start, end]."""
    return filter_subsets(spark, base, raw_root, out_root, "end", **kw)


def filter_subsets_preoperative(spark: SparkSession, base: DataFrame, raw_root: str, out_root: str,
                                **kw) -> list[str]:
    """window = [start, knife_time -> ServiceDatetime_1 -> ServiceDate]."""
    b = base.withColumn("preop_cutoff", preop_cutoff(base))
    return filter_subsets(spark, b, raw_root, out_root, "preop_cutoff", **kw)
