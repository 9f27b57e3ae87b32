from pyspark.sql import functions as F

from cohortkit.llm.common import with_row_ids


def test_a_parquet_table_names_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).withColumn("__row", F.lit("clash")).repartition(7).write.parquet(path)
    df = spark.read.parquet(path)
    rows, name = with_row_ids(df)
    assert rows.columns == [*df.columns, name] and rows.select(name).distinct().count() == 1000
    again = with_row_ids(spark.read.parquet(path))[0]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))


def test_other_plans_are_numbered_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50).write.parquet(path)
    for df in (spark.range(50), spark.read.parquet(path).withColumn("x", F.explode(F.array(F.lit(1), F.lit(1)))), spark.range(0)):
        rows, name = with_row_ids(df)
        ids = [r[name] for r in rows.collect()]
        assert len(ids) == len(set(ids)) == df.count() and sorted(ids) == sorted(r[name] for r in rows.collect())


def test_empty_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0).write.parquet(path)
    assert with_row_ids(spark.read.parquet(path))[0].count() == 0
