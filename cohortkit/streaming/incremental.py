"""Incremental population restriction of raw files (S5/S6, incremental form).

The batch operator (``sources.readers.population_filter_parquet``) rewrites
a table; for raw folders that keep receiving files this runs the same plan
as a Structured Streaming query with ``availableNow``: each new file is read
once, semi-joined to the cohort ids (a static, AQE-planned join) and
appended; the checkpoint records processed files, so a restart after a
failure neither skips nor duplicates input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def population_filter_stream(spark: SparkSession, raw_dir: str, schema: StructType, ids: DataFrame,
                             out_dir: str, checkpoint: str, id_col: str = "CPR_hash",
                             max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the incremental filter; call ``.awaitTermination()`` to drain."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(raw_dir)
    kept = src.join(ids.select(id_col).distinct(), on=id_col, how="left_semi")
    return (kept.writeStream.format("parquet").option("path", out_dir)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())
