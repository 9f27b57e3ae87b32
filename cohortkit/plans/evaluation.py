"""Evaluation of a scored cohort at many cutoffs.

The dataset of all cutoffs is scored in one pass, the predictions are stored
partitioned by masking point, and the metrics of every masking point are read
off the stored predictions in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG
from ..functions.timefns import time_to_step
from ..sources.sinks import write_predictions
from .metrics import ap_interval, auroc_ap

PREDICTION = "masking_point string, time_min double, y_true int, y_pred double, time_hours double, time_days double"


def point_label(minutes: Column) -> Column:
    """Text of a cutoff in its largest whole unit (``6h``, ``4D``, ``90min``), one per cutoff; P10 reads it back."""
    m = minutes.cast("bigint")
    return F.when(m % 1440 == 0, F.concat((m / 1440).cast("bigint").cast("string"), F.lit("D"))) \
            .when(m % 60 == 0, F.concat((m / 60).cast("bigint").cast("string"), F.lit("h"))) \
            .otherwise(F.concat(m.cast("string"), F.lit("min")))


def predictions(scored: DataFrame, target: str, id_col: str = "PID", score: str | Column = "y_pred",
                minutes: str = "masking_point") -> DataFrame:
    """S11 rows of a scored frame whose cutoff is in minutes: id, true and predicted value, the cutoff in all units."""
    m = F.col(minutes).cast("double")
    return scored.select(F.col(id_col), F.col(target).cast("int").alias("y_true"),
                         (F.col(score) if isinstance(score, str) else score).cast("double").alias("y_pred"),
                         point_label(m).alias("masking_point"), m.alias("time_min"), (m / 60.0).alias("time_hours"),
                         (m / 1440.0).alias("time_days"))


def store_predictions(rows: DataFrame, path: str) -> DataFrame:
    """Store prediction rows by masking point and read them back, so that metrics come from what is stored."""
    write_predictions(rows, path)
    kind = rows.schema[rows.columns[0]].dataType.simpleString()
    return rows.sparkSession.read.schema(f"{rows.columns[0]} {kind}, {PREDICTION}").parquet(path)


def metrics_by_cutoff(stored: DataFrame, n_bootstraps: int = 1000, bin_intervals: dict | None = None,
                      seed: int = 42) -> DataFrame:
    """One row per stored masking point: its time in all units, the step that
    holds it (-1 for none), AUROC with its interval, AP with the interval of
    ``n_bootstraps`` resamples (none for 0), rows and positives.

    Metrics are null where a masking point has one class."""
    keys = ["masking_point", "time_min"]
    m = auroc_ap(stored, "y_true", "y_pred", keys=keys)
    out = m.withColumn("time_hours", F.col("time_min") / 60.0).withColumn("time_days", F.col("time_min") / 1440.0).withColumn(
        "censor_step", F.coalesce(time_to_step(F.col("time_min"), "min", bin_intervals or DEFAULT_CONFIG["bin_intervals"]),
                                  F.lit(-1).cast("bigint")))
    if n_bootstraps:
        out = out.join(ap_interval(stored, "y_true", "y_pred", n_bootstraps=n_bootstraps, seed=seed, keys=keys), keys, "left")
    return out
