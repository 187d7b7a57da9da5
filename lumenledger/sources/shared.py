"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where that is unset, a folder beside the warehouse, or a temporary one if that can't be written.

    On a cluster there is no default: a folder of the driver's own would lose what executors write.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # One machine, so a folder of its own is shared.
    at = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:").rstrip("/") + "/.checkpoints"
    try:
        os.makedirs(at, exist_ok=True)
    except OSError:
        at = tempfile.mkdtemp(prefix="checkpoints-")
    return at


def shared_folder(spark: SparkSession) -> str:
    """This session's folder in the shared one, which checkpoints use too."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(spark))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own in the shared folder. Loops use it: what a checkpoint's plan still knows of its columns grows with each round."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
