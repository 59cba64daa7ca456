"""Session helpers: table access and reliable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: spark.checkpoint.dir, or a temporary one on a local master.

    A cluster without the setting is an error, since a machine-local folder is lost with its machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="quorumlake-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder and read from there.

    Used where a plan is read more than once and must see the same rows each time
    (range partitioning samples its input), or where recomputing is costly.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
