"""Sources (S1-S7, S9, S12, S14): typed scans, population-restricted loads
and the event catalogue."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import numeric_or_null
from ..operators.joins import semi_join_ids
from . import schemas


def read_table(spark: SparkSession, root: str, name: str, schema: StructType | None = None,
               prefix: str = "") -> DataFrame:
    """Parquet scan of ``{root}/{prefix}{name}.parquet`` with a declared
    schema when one is known (no inference)."""
    schema = schema or schemas.RAW.get(name)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(f"{root}/{prefix}{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Header CSV with ids as text (explicit schema, or all-string)."""
    r = spark.read.option("header", True)
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", False).csv(path)


def sampled_fetch(df: DataFrame, n_take: int | None = None,
                  filter_function: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """S3 (+T2, F2): first ``n_take`` rows, *then* a caller predicate (the
    limit is the feature: a sample fetch)."""
    out = df.limit(n_take) if n_take else df
    return out.transform(filter_function) if filter_function else out


def population_filter(df: DataFrame, base: DataFrame, id_col: str = "CPR_hash") -> DataFrame:
    """Rows whose id is in the cohort.  Spark file splits replace
    the 4 M-row batch loop; only the needed columns are read."""
    return semi_join_ids(df, base, id_col)


def population_filter_parquet(spark: SparkSession, raw_root: str, name: str, base: DataFrame,
                              out_root: str, id_col: str = "CPR_hash", mode: str = "overwrite") -> str:
    """Load, restrict to the cohort, store as parquet."""
    out = f"{out_root}/{name}.parquet"
    population_filter(read_table(spark, raw_root, name), base, id_col).write.mode(mode).parquet(out)
    return out


def table_exists(spark: SparkSession, path: str) -> bool:
    """Skip-if-present check through the Hadoop file system of the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a stored folder that is about to be written anew, in whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def collect_subsets(spark: SparkSession, names: Sequence[str], raw_root: str, base: DataFrame,
                    out_root: str, reset: bool = False, id_col: str = "CPR_hash") -> list[str]:
    """Restrict every configured raw table to the cohort; tables already
    stored are skipped unless ``reset``.  Duplicated names run once."""
    done = []
    for name in dict.fromkeys(names):
        out = f"{out_root}/{name}.parquet"
        if not reset and table_exists(spark, out):
            continue
        population_filter_parquet(spark, raw_root, name, base, out_root, id_col)
        done.append(name)
    return done


def load_catalogue(spark: SparkSession, path: str | None = None, configured: Sequence[str] = ()) -> DataFrame:
    """Event catalogue (filename, dt_colname, value_colname,
    type_colname, ts_offset) + completeness check against the configured
    table names (raises on missing ones)."""
    if path is None:
        cat = spark.createDataFrame(schemas.CATALOGUE_ROWS, schemas.CATALOGUE)
    else:
        cat = read_csv(spark, path, schemas.CATALOGUE)
    if configured:
        want = spark.createDataFrame([(n,) for n in dict.fromkeys(configured)], "filename string")
        missing = [r[0] for r in want.join(cat, "filename", "left_anti").collect()]
        if missing:
            raise AssertionError(f"{missing} are not present in the catalogue")
    return cat


def get_concept(binned: DataFrame, concept: str, agg_funcs: Sequence[str],
                drop_features: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Per agg, the stored binned concept without dropped / null
    features and with VALUE as a number (partition filters prune the scan)."""
    out = {}
    for agg in agg_funcs:
        d = binned.where((F.col("concept") == concept) & (F.col("agg_func") == agg))
        d = d.where(F.col("FEATURE").isNotNull())
        if drop_features:
            d = d.where(~F.col("FEATURE").isin(list(drop_features)))
        out[agg] = d.withColumn("VALUE", numeric_or_null(F.col("VALUE")))
    return out


def read_base(spark: SparkSession, path: str) -> DataFrame:
    """Stored cohort table."""
    return spark.read.parquet(path)

