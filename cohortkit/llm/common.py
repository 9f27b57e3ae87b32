"""Shared helpers: stage tables in the shared checkpoint folder and text columns."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortkit.session import ensure_checkpoint_dir

# White space of the word patterns: space and \x09-\x0D (fixed values).
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, survives lost executors, and later
    reads are column-pruned and filter-pushed.
    """
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    while name in df.columns:
        name += "_"
    return name


FILE_BITS = 36  # bits of a row's number in its file


def with_row_ids(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a stable long id of each row, and the new column's name.

    A table read from Parquet names its rows itself: by the file's number and
    the row's place in it, the same in every reading, so no row is written
    again.  Any other plan, whose rows may differ or repeat from one reading
    to the next, is staged with numbers once."""
    name = new_name(df, "__row")
    if df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        try:
            placed = df.select("*", F.col("_metadata.file_path").alias(f"{name}f"), F.col("_metadata.row_index").alias(f"{name}i"))
        except AnalysisException:  # not Parquet
            placed = None
        if placed is not None:
            files = placed.select(F.col(f"{name}f").alias("__f")).distinct()
            numbers = stage(files.select("__f", F.row_number().over(Window.orderBy("__f")).cast("long").alias("__n")), "files")  # one row per file
            placed = placed.join(numbers, placed[f"{name}f"] == numbers["__f"])
            row = (F.shiftleft("__n", FILE_BITS) + F.col(f"{name}i")).alias(name)
            return placed.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], row), name
    return stage(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def text_or_empty(name: str = "text") -> Column:
    """The text as a string, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def shuffle_parts(spark: SparkSession) -> int:
    """Current number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
