"""Registered queries that run a stream over the tape to its end."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.scratch import folder, written
from barloom.streaming import live
from barloom.streaming.bars import stream_bars

from .base import CUSUM, THRESHOLD, TICKS, query, ticks

#: State with lists and several variables needs this store.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Files that arrive one after another, and by how many minutes a tick may be overtaken; fixed values.
PARTS, OVERTAKEN = 4, 20


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """The tape as a stream of PARTS triggers in order of arrival, in which ticks overtake each other. price is the log price."""
    utc = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("ts")))
    tape = ticks(spark, d).select("symbol", "agg_id", utc.alias("ts"), F.col("lp").cast("double").alias("price"), "qty")
    # read once for the cuts and once for each part
    tape = written(tape.withColumn("arrival", F.unix_micros("ts") + F.pmod(F.xxhash64("agg_id"), F.lit(OVERTAKEN * 60_000_000))), "overtaken")
    cuts = tape.agg(F.percentile_approx("arrival", [i / PARTS for i in range(1, PARTS)], 10_000)).first()[0]
    path, rest = folder(spark, "arrivals"), tape
    for i in range(PARTS):
        # each part's files are newer than the last one's: that is the order in which the stream reads them
        low, high = (cuts[i - 1] if i else None), (cuts[i] if i < len(cuts) else None)
        part = rest if low is None else rest.where(F.col("arrival") > low)
        part = part if high is None else part.where(F.col("arrival") <= high)
        part.drop("arrival").write.mode("append").parquet(path)
    files = math.ceil(len(spark.read.parquet(path).inputFiles()) / PARTS)
    return spark.readStream.schema(tape.drop("arrival").schema).option("maxFilesPerTrigger", max(1, files)).parquet(path)


def finished(spark: SparkSession, source: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that a stream has made of all that its source has now."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    try:
        out = folder(spark, "stream")
        writer = make(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, "stream-state"))
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(out)


@query(f"""
WITH RECURSIVE {CUSUM}, told AS (SELECT symbol, max(ts) - INTERVAL 30 MINUTE AS passed FROM t GROUP BY symbol)
SELECT symbol, seq, bar_open_ts, bar_close_ts, open, high, low, close, round(volume, 6) AS volume, n_trades, cusum_pos, cusum_neg
FROM cbars JOIN told USING (symbol) WHERE bar_close_ts < passed
""")
def s07_reordered_bars(spark: SparkSession, d: str) -> DataFrame:
    """CUSUM bars of a stream whose ticks overtake each other, put in order by waiting for half an hour: those of the tape in order."""
    made = finished(
        spark, arrivals(spark, d), lambda t: stream_bars(live.reordered(t, "30 minutes").where("NOT late").drop("late"), THRESHOLD, 168.0, F.col("price"))
    )
    zone = [F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr("timestamp_ntz'1970-01-01'")).alias(c) for c in ("bar_open_ts", "bar_close_ts")]
    names = ["open", "high", "low", "close"]
    return made.select("symbol", "seq", *zone, *names, F.round("volume", 6).alias("volume"), "n_trades", "cusum_pos", "cusum_neg")


@query(f"""
WITH {TICKS}
SELECT symbol, count(*) AS n_ticks, round(sum(lp), 6) AS lp_sum, round(sum(qty), 6) AS volume, 0 AS n_late
FROM t JOIN (SELECT symbol, max(ts) - INTERVAL 30 MINUTE AS passed FROM t GROUP BY symbol) USING (symbol) WHERE ts < passed GROUP BY symbol
""")
def s07_reordered_ticks(spark: SparkSession, d: str) -> DataFrame:
    """What the reorder buffer has handed on, and how much of it late, by symbol."""
    made = finished(spark, arrivals(spark, d), lambda t: live.reordered(t, "30 minutes"))
    own = ~F.col("late")
    return made.groupBy("symbol").agg(
        F.count_if(own).alias("n_ticks"),
        F.round(F.sum(F.when(own, F.col("price"))), 6).alias("lp_sum"),
        F.round(F.sum(F.when(own, F.col("qty"))), 6).alias("volume"),
        F.count_if("late").cast("int").alias("n_late"),
    )
