"""Reshape operators: numbered pivots (R1/R2), feature pivot (R3),
blood-pressure split (R5), list explode (R6), multi-hot encoding (R7-R9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def explode_values(df: DataFrame, col: str = "VALUE") -> DataFrame:
    """One row per element of a list cell; scalars pass through, empty
    or null lists keep one null row (``explode_outer``)."""
    if isinstance(df.schema[col].dataType, ArrayType):
        return df.withColumn(col, F.explode_outer(col))
    return df


def numbered_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "n") -> DataFrame:
    """R1/R2 long form: the rows of a group numbered 1..n in ``order``.

    Numbered over range buckets of (keys, order), so a hot group is split
    over many tasks like every ordered scan."""
    from .ordered import ordered_scan, range_buckets
    ranged = range_buckets(df.withColumn("__one", F.lit(1)), [*keys, *order])
    return ordered_scan(ranged, list(keys), list(order), "__rb", cumsum={out: "__one"}).drop("__rb", "__one")


def numbered_pivot(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """R1/R2 wide form: each of ``cols`` of :func:`numbered_rows` spread to
    ``{col}_{n}`` (first non-null); as wide as the largest group, no row is
    left out."""
    numbered = numbered_rows(df, keys, order, "__n")
    widest = numbered.agg(F.max("__n")).first()[0] or 0
    values = list(range(1, widest + 1))
    aggs = [F.first(F.col(c), ignorenulls=True).alias(c) for c in cols]
    p = numbered.groupBy(*keys).pivot("__n", values).agg(*aggs)
    for n in values:
        for c in cols:
            src = f"{n}_{c}" if len(cols) > 1 else f"{n}"
            p = p.withColumnRenamed(src, f"{c}_{n}")
    return p.select(*keys, *[f"{c}_{n}" for c in cols for n in values])


def numbered_collection(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                        out: str = "items") -> DataFrame:
    """R1/R2 nested form: per group its rows in ``order`` as an array of
    structs of ``cols``; the row numbered n is element n.

    The schema is the same whatever the data; :func:`flatten_numbered` makes
    it wide where a fixed number of columns is wanted."""
    item = F.struct(F.struct(*[F.col(c) for c in order]).alias("__o"), F.struct(*[F.col(c) for c in cols]).alias("__v"))
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["__v"]).alias(out))


def flatten_numbered(df: DataFrame, width: int, items: str = "items", cols: Sequence[str] | None = None) -> DataFrame:
    """The numbered columns ``{col}_1`` to ``{col}_{width}`` of a nested
    collection, in its place; a group with more items raises, so that none is
    left out unseen."""
    names = [f.name for f in df.schema[items].dataType.elementType.fields] if cols is None else list(cols)
    size = F.coalesce(F.size(items), F.lit(0))
    bad = F.raise_error(F.concat(F.lit(f"{items}: a group has "), size.cast("string"), F.lit(f" items, over the {width} columns given")))
    checked = df.withColumn(items, F.when(size > width, bad.cast(df.schema[items].dataType)).otherwise(F.col(items)))
    return checked.select(*[F.col(_quoted(c)) for c in df.columns if c != items],
                          *[F.get(items, F.lit(n))[c].alias(f"{c}_{n + 1}") for c in names for n in range(width)])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def feature_pivot(df: DataFrame, id_col: str, features: Sequence[str], value: str = "VALUE",
                  feature_col: str = "FEATURE") -> DataFrame:
    """FEATURE values to columns (explicit list), first value."""
    return df.groupBy(id_col).pivot(feature_col, list(features)).agg(F.first(value))


def split_blood_pressure(df: DataFrame, bp_types: Sequence[str], feature: str = "FEATURE",
                         value: str = "VALUE") -> DataFrame:
    """A ``sys/dia`` row of a BP type becomes an SBP and a DBP row;
    the halves are coerced to numbers (invalid -> null) and rendered back
    as text, like every VALUE of the long model."""
    from ..functions.numeric import numeric_or_null
    is_bp = F.col(feature).isin(list(bp_types))
    parts = F.split(F.col(value), "/", 2)

    def txt(c):
        return numeric_or_null(c).cast("string")
    other = df.where(~is_bp | is_bp.isNull())
    bp = df.where(is_bp)
    sbp = bp.withColumn(feature, F.lit("SBP")).withColumn(value, txt(parts.getItem(0)))
    dbp = bp.withColumn(feature, F.lit("DBP")).withColumn(value, txt(F.element_at(parts, 2)))
    return other.unionByName(sbp).unionByName(dbp)


def multi_hot_vocabulary(df: DataFrame, timestep_cols: Sequence[str], cat_col: str = "FEATURE",
                         feature_names: Sequence[str] | None = None) -> DataFrame:
    """Sorted distinct values per feature over scalar/list cells.

    Returns ``(feature, value, idx)`` with ``idx`` the position in the
    concatenated category axis (features in ``feature_names`` order, values
    sorted inside a feature).  The vocabulary is small (distinct values) and
    is materialised once, like a fitted model.
    """
    long = _melt(df, timestep_cols, cat_col, None)
    voc = long.select(F.col(cat_col).alias("feature"), "value").where(F.col("value").isNotNull()).distinct()
    if feature_names is not None:
        voc = voc.where(F.col("feature").isin(list(feature_names)))
        order = F.array_position(F.array(*[F.lit(f) for f in feature_names]), F.col("feature"))
    else:
        order = F.col("feature")
    # offsets of each feature block: one row per feature -> running sum
    # (the only global window runs over the feature list)
    counts = voc.groupBy("feature").agg(F.count(F.lit(1)).alias("__k")).withColumn("__f", order)
    counts = counts.withColumn("__off", F.coalesce(
        F.sum("__k").over(Window.orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    voc = voc.join(counts.select("feature", "__off"), "feature")
    voc = voc.withColumn("idx", (F.col("__off") + F.dense_rank().over(
        Window.partitionBy("feature").orderBy("value")) - 1).cast("int"))
    # the fitted vocabulary is reused by transform and labels: store it once
    from ..session import cut_lineage
    return cut_lineage(voc.select("feature", "value", "idx"))


def _melt(df: DataFrame, timestep_cols: Sequence[str], cat_col: str, sample_col: str | None) -> DataFrame:
    """(sample, feature, timestep, value) with list cells exploded."""
    steps = F.array(*[F.struct(F.lit(i).alias("t"),
                               (F.col(c) if isinstance(df.schema[c].dataType, ArrayType)
                                else F.array(F.col(c).cast("string"))).cast("array<string>").alias("v"))
                      for i, c in enumerate(timestep_cols)])
    keep = [cat_col] + ([sample_col] if sample_col else [])
    m = df.select(*keep, F.explode(steps).alias("__s"))
    m = m.select(*keep, F.col("__s.t").alias("timestep"), F.explode_outer("__s.v").alias("value"))
    return m


def multi_hot_transform(df: DataFrame, vocabulary: DataFrame, sample_col: str, timestep_cols: Sequence[str],
                        cat_col: str = "FEATURE") -> DataFrame:
    """R8 (sparse form): distinct ``(sample, idx, timestep)`` ones; unknown
    values are ignored; absent samples simply have no rows."""
    long = _melt(df, timestep_cols, cat_col, sample_col).where(F.col("value").isNotNull())
    j = long.join(vocabulary.withColumnRenamed("feature", cat_col), on=[cat_col, "value"], how="inner")
    return j.select(sample_col, "idx", "timestep").distinct()


def multi_hot_dense(ones: DataFrame, sample_col: str, n_categories: int, seq_len: int,
                    samples: DataFrame | None = None) -> DataFrame:
    """R8 (dense form): per sample an ``n_categories x seq_len`` 0/1 float
    matrix (one row per sample; size bounded by the vocabulary), filled from
    the sorted positions of its ones: the cost is the cells plus the ones.  With
    ``samples`` every one of them has a row, all zero if it has no ones."""
    cells = ones.groupBy(sample_col).agg(F.array_sort(F.collect_set((F.col("idx") * seq_len + F.col("timestep")).cast("int"))).alias("__on"))
    if samples is not None:
        cells = samples.select(sample_col).distinct().join(cells, sample_col, "left") \
                       .withColumn("__on", F.coalesce("__on", F.array().cast("array<int>")))
    # the ones scattered: zeros up to each position, then its one, then the zeros that are left
    n = n_categories * seq_len
    cells = cells.withColumn("__flat", F.expr(f"""concat(
        flatten(transform(__on, (p, i) -> concat(array_repeat(0F, p - if(i = 0, 0, __on[i - 1] + 1)), array(1F)))),
        array_repeat(0F, {n} - if(size(__on) = 0, 0, __on[size(__on) - 1] + 1)))"""))
    rows = F.expr(f"transform(sequence(0, {n_categories - 1}), i -> slice(__flat, i * {seq_len} + 1, {seq_len}))") if n \
        else F.array().cast("array<array<float>>")
    return cells.select(sample_col, rows.alias("multi_hot"))


def category_labels(vocabulary: DataFrame) -> DataFrame:
    """Per feature, its values in index order."""
    return vocabulary.groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("labels"))
