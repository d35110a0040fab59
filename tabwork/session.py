"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tabwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC times."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a spent round leaves the shared folder
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


SPREAD_ROWS = 1 << 16


def spread(df: DataFrame) -> DataFrame:
    """The rows of a large table in even partitions; a file of one row group is one task whatever its size.

    A table of at most SPREAD_ROWS rows stays as it is.
    """
    parts = -(-df.count() // SPREAD_ROWS)
    return df.repartition(parts) if parts > 1 else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir.

    A single-process local master without the setting (tests) gets a temporary
    folder; a cluster without it is an error, since executors must share the folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabwork-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, for tables between the steps of a job."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder, so lost executors re-read it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
