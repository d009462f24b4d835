"""Results that are computed once and kept where all machines can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or (on one machine without one, as in tests) a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="flintframe-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
