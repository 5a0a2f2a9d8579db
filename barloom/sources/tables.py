"""Partitioned Parquet tables: replaced by partition, never row by row."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def replace_partitions(df: DataFrame, path: str, keys: list[str], sort: list[str] | None = None) -> None:
    """Writes df so that exactly the partitions that it holds are replaced.

    Rows are first brought together by partition and a hash of the rest, in as
    many files as the shuffle has partitions at most, and sorted within files.
    """
    made = df.repartition(*keys, F.pmod(F.hash(*(sort or keys)), F.lit(16)))
    if sort:
        made = made.sortWithinPartitions(*keys, *sort)
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_ticks(ticks: DataFrame, path: str) -> None:
    """By symbol and month, in tape order."""
    month = F.date_format("ts", "yyyy-MM").alias("month")
    replace_partitions(ticks.select("*", month), path, ["symbol", "month"], ["ts", "agg_id"])


def add_ticks(ticks: DataFrame, path: str, months: list[str] | None = None) -> None:
    """Adds ticks to the table at path, but for those whose symbol, id and time it has already; of repeated ones, one.

    months (yyyy-MM) that all ticks lie in, if known, keep the other partitions from being read. A run that fails adds
    nothing, and may be repeated.
    """
    key = ["symbol", "agg_id", "ts"]
    known = ticks.sparkSession.read.parquet(path)
    if months is not None:
        known = known.where(F.col("month").isin(months))
    fresh = ticks.dropDuplicates(key).join(known.select(*key), key, "left_anti").withColumn("month", F.date_format("ts", "yyyy-MM"))
    made = fresh.repartition("symbol", "month", F.pmod(F.hash("ts"), F.lit(16))).sortWithinPartitions("symbol", "month", "ts", "agg_id")
    made.write.mode("append").partitionBy("symbol", "month").parquet(path)


def write_bars(bars: DataFrame, path: str) -> None:
    replace_partitions(bars, path, ["symbol", "threshold_bp"], ["bar_close_ts", "seq"])


def read_bars(spark: SparkSession, path: str, symbol: str, threshold_bp: int, month: str | None = None) -> DataFrame:
    """Bars of one symbol and threshold, of those that close in the month that begins at `month` if there is one."""
    bars = spark.read.parquet(path).where((F.col("symbol") == symbol) & (F.col("threshold_bp") == threshold_bp))
    if month is None:
        return bars
    first = F.lit(month).cast("date")
    return bars.where((F.col("bar_close_ts") >= first.cast("timestamp")) & (F.col("bar_close_ts") < F.add_months(first, 1).cast("timestamp")))


def write_features(features: DataFrame, path: str, feature_set: str) -> None:
    """base, tier1 and v2 matrices differ by a partition column, not by file name."""
    replace_partitions(features.withColumn("feature_set", F.lit(feature_set)), path, ["feature_set", "symbol"], ["bar_close_ts", "bar_id"])


def read_features(spark: SparkSession, path: str, tier1: bool = False, v2: bool = False) -> DataFrame:
    if tier1 and v2:
        raise ValueError("tier1 and v2 exclude each other")
    chosen = "tier1" if tier1 else "v2" if v2 else "base"
    return spark.read.parquet(path).where(F.col("feature_set") == chosen).drop("feature_set")


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def append_audit(events: DataFrame, path: str) -> None:
    """Audit events (ts, session_id, event, payload as JSON text) in a folder per day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def stream_audit(events: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Appends a stream of audit events (ts, session_id, event, payload) as JSON lines, in a folder per event day.

    The sink's own log names the files that count, so a batch that is repeated after a restart adds no line twice: read
    the folder with spark.read.json. Events without a time are in the folder of none.
    """
    writer = events.withColumn("day", F.to_date("ts")).writeStream.format("json").partitionBy("day")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def read_report(spark: SparkSession, path: str, exploded: str | None = None) -> DataFrame:
    """A JSON report's rows; with `exploded`, a row for each element of that array, whose fields (or itself) are columns."""
    rows = spark.read.option("multiLine", "true").json(path)
    if exploded is None:
        return rows
    kind = rows.schema[exploded].dataType.elementType
    kept = [c for c in rows.columns if c != exploded and not (isinstance(kind, StructType) and c in kind.names)]
    each = rows.select(*kept, F.explode_outer(exploded).alias("_one"))
    return each.select(*kept, *(["_one.*"] if isinstance(kind, StructType) else [F.col("_one").alias(exploded)]))


def read_ticks(
    spark: SparkSession, path: str, symbol: str, start: str | None = None, end: str | None = None, limit: int | None = None
) -> DataFrame:
    """A symbol's ticks in order of (ts, agg_id), from `start` on and before `end`, the first `limit` of them; each bound is optional.

    Bounds are times (`2024-01-05 10:00`) and prune the months that lie outside them.
    """
    rows = spark.read.parquet(path).where(F.col("symbol") == symbol)
    if start is not None:
        at = F.lit(start).cast("timestamp")
        rows = rows.where((F.col("ts") >= at) & (F.col("month") >= F.date_format(at, "yyyy-MM")))
    if end is not None:
        at = F.lit(end).cast("timestamp")
        rows = rows.where((F.col("ts") < at) & (F.col("month") <= F.date_format(at, "yyyy-MM")))
    rows = rows.orderBy("ts", "agg_id")
    return rows if limit is None else rows.limit(limit)


def save_model(model: PipelineModel, folder: str, versions: list[str]) -> str:
    """Saves a fitted pipeline as the version after those that there are, and returns its name."""
    name = next_version(versions)
    model.write().save(f"{folder}/{name}")
    return name


def next_version(versions: list[str]) -> str:
    last = latest_version(versions)
    return f"v{int(last[len(last.rstrip('0123456789')) :] or 0) + 1 if last else 1}"


def load_model(folder: str, versions: list[str], name: str | None = None) -> PipelineModel:
    """A saved pipeline: the latest version, or the one named."""
    return PipelineModel.load(f"{folder}/{name or latest_version(versions)}")


def latest_version(names: list[str]) -> str | None:
    """Of names that end in a number, the one of the highest: v10 is after v9."""

    def number(name: str) -> int:
        digits = name[len(name.rstrip("0123456789")) :]
        return int(digits) if digits else -1

    return max(names, key=number, default=None)
