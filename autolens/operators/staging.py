"""Materialise an intermediate table that several passes read."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def _shared_folder(spark: SparkSession) -> str | None:
    return spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str | None:
    """A new folder name in the shared folder, or None where there is no such folder."""
    folder = _shared_folder(spark)
    return f"{folder.rstrip('/')}/autolens-{uuid.uuid4().hex}" if folder else None


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once as parquet in the cluster's shared folder and read it back.

    The folder is the session's `spark.checkpoint.dir`. A written table cuts the
    lineage, survives lost executors and lets later passes read only their
    columns. Without the setting the frame is persisted on the executors, and Spark
    rebuilds from the lineage what is lost.
    """
    path = scratch_path(df.sparkSession)
    if path is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
