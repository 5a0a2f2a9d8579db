"""Archives of tick files: checksums, zip members, lines, and months already loaded."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.ticks import parse_line


def files(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """path, file, content of the files below a folder of any store that Spark reads."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return found.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def verified(archives: DataFrame, checksums: DataFrame) -> DataFrame:
    """archives (file, content) with sha256; fails where it is not what checksums (content "<sha256>  <file>") say.

    Archives without a checksum fail as well. Both the sum and the content pass through the check, so whatever is read
    of a wrong archive fails, its lines too.
    """
    line = F.split(F.trim(F.col("content").cast("string")), r"\s+")
    told = checksums.select(F.get(line, F.lit(1)).alias("file"), F.lower(F.get(line, F.lit(0))).alias("told"))
    made = archives.withColumn("sha256", F.sha2("content", 256)).join(told, "file", "left")
    wrong = F.raise_error(F.concat(F.lit("checksum mismatch: "), F.col("file")))
    right = F.col("sha256") == F.col("told")
    return made.withColumns(
        {
            "content": F.when(right, F.col("content")).otherwise(wrong.cast("binary")),
            "sha256": F.when(right, F.col("sha256")).otherwise(wrong.cast("string")),
        }
    ).drop("told")


def member(names: list[str]) -> str:
    """The CSV at the archive's root, or else the first one in a folder."""
    csv = sorted((n.count("/"), n) for n in names if n.lower().endswith(".csv"))
    if not csv:
        raise ValueError(f"no CSV among {names}")
    return csv[0][1]


def lines(archives: DataFrame, batch: int = 20_000) -> DataFrame:
    """file, line: the lines of each archive's CSV, a batch at a time."""

    def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["file"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member(z.namelist())) as raw:
                    held: list[str] = []
                    for text in io.TextIOWrapper(raw, "utf-8"):
                        held.append(text.rstrip("\r\n"))
                        if len(held) == batch:
                            yield pd.DataFrame({"file": name, "line": held})
                            held = []
                    if held:
                        yield pd.DataFrame({"file": name, "line": held})

    return archives.select("file", "content").mapInPandas(unzip, "file string, line string")


def ticks(rows: DataFrame, symbol: str) -> DataFrame:
    """Ticks of lines; header lines have no number first, and go."""
    return rows.select(F.lit(symbol).alias("symbol"), *[c.alias(n) for n, c in parse_line(F.col("line")).items()]).where(
        "agg_id IS NOT NULL"
    )


def csv_ticks(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Ticks of plain or gzipped CSV files, with or without header lines."""
    return ticks(spark.read.text(path).withColumnRenamed("value", "line"), symbol)


def first_of_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the first in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def to_load(published: DataFrame, log: DataFrame) -> DataFrame:
    """Published (symbol, month, sha256) that the log doesn't have with this very sum."""
    return published.join(log.select("symbol", "month", "sha256"), ["symbol", "month", "sha256"], "left_anti")


def upsert(log: DataFrame, news: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """Both tables' rows, of each key the newest one; news win ties."""
    both = log.withColumn("_new", F.lit(0)).unionByName(news.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(newest), F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")
