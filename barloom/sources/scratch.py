"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; what is put there goes when the session ends.

    A local session without that setting has a folder of this machine's; a cluster must set it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "barloom-scratch")
    path = f"{where.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in a folder() and read again: cuts lineage, and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[made] = path
    return made


#: Where tables that written() made stand.
_PATHS: WeakKeyDictionary = WeakKeyDictionary()


def discard(table: DataFrame) -> None:
    """Deletes a table that written() made, once nothing that is still to be computed reads it."""
    spark, path = table.sparkSession, _PATHS.pop(table)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
