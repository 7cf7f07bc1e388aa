"""Reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of `spark.checkpoint.dir`; a local one only where none is set and the master is local."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="textloom-checkpoint-")
    sc.setCheckpointDir(where)


def checkpoint(df: DataFrame) -> DataFrame:
    """Lineage and plan are cut and the rows survive the loss of executors. Plans stay short, which nested caches,
    printed inside each other on every adaptive step, do not."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
