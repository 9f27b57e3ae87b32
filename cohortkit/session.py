"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on: NTZ wall-clock arithmetic (no DST), UTC
# rendering, AQE for runtime join strategy / skew splitting / coalescing.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "cohortkit", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (UI off, no extra ports)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g"))
    for k, v in {**SESSION_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, honouring ``spark.checkpoint.dir``.

    On a cluster the folder must be shared storage named by the cluster in
    ``spark.checkpoint.dir`` (an error otherwise); only a ``local[...]``
    session without a setting (tests, local bench) gets a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store): "
                               "stage outputs are checkpointed there")
        configured = tempfile.mkdtemp(prefix="cohortkit-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shuffle_partitions(spark: SparkSession) -> int:
    """Tasks of a shuffle as the session has it, for rows that become many more in the task that reads them: a
    shuffle without a number is cut by the size of what it moves."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worked_out_once(df: DataFrame, *names: str) -> DataFrame:
    """The frame with the columns ``names`` worked out once per row where they stand.

    A filter on a column that is worked out is otherwise pushed down with the
    column's expression put in its place, so that costly ones (texts, JSON, time
    differences) are worked out again for each mention, below a join for each of its
    pairs; it does not pass an ``explode``."""
    out = df.select(*[F.col(_quoted(c)) for c in df.columns if c not in names],
                    F.explode(F.array(F.struct(*[F.col(_quoted(c)) for c in names]))).alias("__once"))
    return out.select(*[F.col(f"__once.{_quoted(c)}" if c in names else _quoted(c)).alias(c) for c in df.columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never localCheckpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
