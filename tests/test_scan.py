"""The two-level scan equals window functions, over one range and over many, with null keys, ties and nulls."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators.bars import index_percentiles, ordered_digest
from barloom.operators.scan import positions, running


def made(spark, n, seed=3):
    rng = random.Random(seed)
    rows = [
        (rng.choice(["a", "a", "a", "a", "b", None]), rng.randrange(n // 3 + 1), i, rng.choice([None, 1.5, -2.0, 3.25, 0.5]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "k string, t long, id long, v double").repartition(5)


@pytest.mark.parametrize("n", [0, 1, 2, 700])
@pytest.mark.parametrize("keys", [["k"], []])
def test_positions(spark, n, keys):
    rows = made(spark, n)
    w = Window.partitionBy(*keys).orderBy(F.desc("t"), "id")
    want = rows.withColumn("n", F.row_number().over(w).cast("long"))
    got = positions(rows, keys, [F.desc("t"), F.col("id")])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("bucket", [None, "floor(t / 10)", "cast(null as int)"])
@pytest.mark.parametrize("n", [0, 1, 700])
def test_running(spark, n, bucket):
    rows = made(spark, n)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("v")
    want = rows.select("*", F.sum(v).over(w).alias("s"), F.max(v).over(w).alias("hi"), F.min(v).over(w).alias("lo"))
    got = running(rows, ["k"], [F.col("t"), F.col("id")], {"s": ("sum", v), "hi": ("max", v), "lo": ("min", v)}, bucket=bucket and F.expr(bucket))
    assert got.columns == want.columns
    # multiples of a quarter: sums are exact
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("bucket", [None, "floor(t / 3)"])
def test_peers_share_a_value(spark, bucket):
    rows = made(spark, 500).withColumn("t", F.col("t") % 7)
    want = rows.withColumn("v", F.sum("v").over(Window.partitionBy("k").orderBy("t")))
    got = running(rows, ["k"], [F.col("t")], {"v": ("sum", F.col("v"))}, peers=True, bucket=bucket and F.expr(bucket))
    key = lambda r: (str(r.k), r.id, r.v)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_one_key_is_many_ranges(spark):
    rows = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    got = positions(rows, ["k"], [F.col("t")])
    assert got.where("n != t + 1").count() == 0 and got.count() == 20_000
    by_bucket = running(rows, ["k"], [F.col("t")], {"n": ("sum", F.lit(1))}, bucket=F.floor(F.col("t") / 500))
    assert by_bucket.where("n != t + 1").count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "row_number" not in plan and "Window [" not in plan.split("== Physical Plan ==")[1].split("Scan parquet")[0]


def test_order_statistics_of_groups(spark):
    rows = made(spark, 400).withColumn("v", F.col("v") + F.col("t"))
    got = {r.k: (r.p50, r.p95, r.top) for r in index_percentiles(rows, ["k"], "v", {"p50": 0.5, "p95": 0.95, "top": 1.0}).collect()}
    lists = {}
    for r in rows.collect():
        if r.v is not None:
            lists.setdefault(r.k, []).append(r.v)
    want = {k: (sorted(v)[int(len(v) * 0.5)], sorted(v)[int(len(v) * 0.95)], None) for k, v in lists.items()}
    assert got == want and None in got


def test_digests_of_chunks(spark):
    rows = spark.createDataFrame([(k, i, f"{k}{i}") for k, n in (("a", 1), ("b", 3), ("c", 4), ("d", 40)) for i in range(n)], "k string, i long, s string")
    got = {r.k: r.print for r in ordered_digest(rows, ["k"], F.col("s"), [F.col("i")], chunk=3).collect()}

    def md5(parts):
        return hashlib.md5("|".join(parts).encode(), usedforsecurity=False).hexdigest()

    def digest(parts):
        parts = [md5(parts[i : i + 3]) for i in range(0, len(parts), 3)]
        while len(parts) > 1:
            parts = [md5(parts[i : i + 3]) for i in range(0, len(parts), 3)]
        return parts[0]

    assert got == {k: digest([f"{k}{i}" for i in range(n)]) for k, n in (("a", 1), ("b", 3), ("c", 4), ("d", 40))}
    assert ordered_digest(rows.where("false"), ["k"], F.col("s"), [F.col("i")]).collect() == []
