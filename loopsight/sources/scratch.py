"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local session gets a new one; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = folder.get() if folder.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Spark's cleaner doesn't know it: the folder's owner clears it after the job."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage so that a lost executor costs no recomputation. folders: columns whose values get a folder each."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*folders).parquet(path) if folders else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
