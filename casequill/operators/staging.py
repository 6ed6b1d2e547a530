"""Intermediate results that several branches of a plan read.

They are written as a table to the folder the cluster shares, so a lost executor costs a
re-read and not a second pass over the texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: used by single-machine sessions that name no folder, as tests do
LOCAL_MODE_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode a fixed one where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"file://{LOCAL_MODE_FOLDER}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str = "stage") -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write the frame once and read it back; the schema is kept."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
