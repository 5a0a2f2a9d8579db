"""The stream's source: how often the tape is made for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.plans import stream_queries


def test_the_tape_is_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    count = F.udf(counted, "long").asNondeterministic()
    ts = F.timestamp_add("SECOND", F.col("id"), F.expr("timestamp_ntz'2024-01-01'"))
    tape = spark.range(200).select(F.lit("S").alias("symbol"), count("id").alias("agg_id"), ts.alias("ts"), F.col("id").alias("lp"), F.lit(1.0).alias("qty"))
    monkeypatch.setattr(stream_queries, "ticks", lambda *_: tape)
    assert stream_queries.arrivals(spark, "").isStreaming
    assert made.value == 200
