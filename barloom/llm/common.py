"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are neither a blank nor \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session has one
    of this machine's; a cluster must set it, since its executors don't see the driver's folders.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "barloom-shared")
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, and survives lost executors.

    The files go when the session ends, or when discard() is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    made = spark.read.schema(df.schema).parquet(path)
    _PATHS[made] = path
    return made


#: Where tables that written() made stand.
_PATHS: WeakKeyDictionary = WeakKeyDictionary()


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that written() made, once nothing that is still to be computed reads them; others are left alone."""
    for table in tables:
        path = _PATHS.pop(table, None) if table is not None else None
        if path is not None:
            spark = table.sparkSession
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def word_count(text: Column) -> Column:
    """Number of words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of ids that may be broadcast: some tens of megabytes at most.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame) -> DataFrame:
    """df, a written table of narrow rows, to be broadcast if it has at most BROADCAST_ROWS rows, else to be shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def without_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of df whose id is not among `ids` (one column, the id's; nulls match nothing)."""
    gone = written(ids.distinct(), "dropped-ids")
    return df.join(bounded(gone.withColumnRenamed(gone.columns[0], id_col)), id_col, "left_anti")


#: Rows that share a key beyond which the key is looked up by broadcast.
HOT_ROWS = 100_000


def joined_by_class(rows: DataFrame, classes: DataFrame, key: str, copies: str) -> DataFrame:
    """rows with the columns of their class (a table of written(), one row per key; null where there is none).

    copies: a column of classes, how many rows have the key. Few classes are broadcast. Of many, those with more than
    HOT_ROWS rows are, since there are at most rows / HOT_ROWS of them: their rows stay where they are. The others'
    rows are shuffled, and none of these keys is large.
    """
    found = classes.drop(copies)
    if classes.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), key, "left")
    often = classes.where(F.col(copies) > HOT_ROWS).drop(copies)
    rest = classes.where(F.col(copies) <= HOT_ROWS).drop(copies)
    hot = rows.join(bounded(often), key)
    cold = rows.join(bounded(often.select(key)), key, "left_anti").join(rest, key, "left")
    return hot.unionByName(cold)
