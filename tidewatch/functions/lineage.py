"""Cutting the lineage of iterative plans in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of each application, which can go when it has ended.
_folders: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set, a private folder
    is taken on a single machine; on a cluster that is an error, as executors
    would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tidewatch-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written under ``checkpoint_dir`` and read again: one job, after which
    its plan is a scan of known size and a lost executor costs nothing before it."""
    spark = df.sparkSession
    if not (folder := _folders.get(spark.sparkContext.applicationId)):
        folder = _folders[spark.sparkContext.applicationId] = f"{checkpoint_dir(spark)}/tidewatch-{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
