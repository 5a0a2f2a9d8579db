"""The CUSUM filter, in a table and as a stream."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators.bars import Cusum, close_reason, count_bars, cusum_bars, index_percentile
from barloom.streaming.bars import counts_per_window, first_arrivals, stream_bars

T0 = datetime(2020, 1, 1)
HOUR = 3_600_000_000


def walk(prices, qty=None, step=1_000_000, threshold=0.02, hours=168.0):
    state = Cusum(threshold, hours)
    return state, state.feed([i * step for i in range(len(prices))], [math.log(p) for p in prices], prices, qty or [1.0] * len(prices))


def test_no_bar_without_moves():
    assert walk([])[1] == [] and walk([100.0])[1] == []


@pytest.mark.parametrize(("move", "n"), [(0.02 + 1e-12, 1), (0.02 - 1e-6, 0)])
def test_threshold_edge(move, n):
    assert len(walk([100.0, 100.0 * math.exp(move)])[1]) == n


@pytest.mark.parametrize("sign", [1, -1])
def test_monotone(sign):
    bars = walk([100.0 * math.exp(sign * 0.0202 * i) for i in range(11)])[1]
    assert len(bars) == 10
    assert all((b[9] >= 0.02) == (sign > 0) and (-b[10] >= 0.02) == (sign < 0) for b in bars)


def test_force_close_at_a_tick():
    prices = [100.0 * (1 + 0.005 * (-1) ** i) for i in range(170)]
    bars = walk(prices, step=HOUR)[1]
    assert 168 * HOUR <= bars[0][2] - bars[0][1] < 169 * HOUR and max(bars[0][9], -bars[0][10]) < 0.02


def test_state_starts_anew():
    state, bars = walk([100.0, 100.0 * math.exp(0.03)])
    assert len(bars) == 1 and state.bar is None and state.spos == state.sneg == 0
    state.feed([2_000_000], [math.log(100.0) + 0.035], [100.0 * math.exp(0.035)], [1.0])
    assert state.bar is not None and 0 < state.spos < 0.02


def test_ohlcv():
    prices = [100.0, 100.5, 99.5, 100.0 * math.exp(0.025)]
    (bar,) = walk(prices, [1.0, 0.5, 2.0, 0.3])[1]
    assert bar[3:9] == (100.0, max(prices), 99.5, prices[3], pytest.approx(3.8), 4)


def tape(n=2000, seed=20260507, symbols=("A", "B")):
    rng, rows = random.Random(seed), []
    for s in symbols:
        p = 100.0
        for i in range(n):
            p *= math.exp(rng.gauss(0, 0.003))
            rows.append((s, i, T0 + timedelta(seconds=10 * (i // 2)), p, rng.uniform(0.001, 5), rng.random() < 0.5))
    return rows


COLUMNS = "symbol string, agg_id long, ts timestamp, price double, qty double, is_buyer_maker boolean"


def loop(rows):
    out = {}
    for s in sorted({r[0] for r in rows}):
        part = [r for r in rows if r[0] == s]
        state = Cusum(0.02, 168.0)
        out[s] = state.feed([int((r[2] - T0).total_seconds() * 1e6) for r in part], [math.log(r[3]) for r in part], [r[3] for r in part], [r[4] for r in part])
    return out


def test_table_equals_loop(spark):
    rows = tape()
    want = loop(rows)
    shuffled = random.Random(1).sample(rows, len(rows))
    made = cusum_bars(spark.createDataFrame(shuffled, COLUMNS).repartition(7), 0.02)
    got = {}
    for r in made.orderBy("symbol", "seq").collect():
        assert r["high"] >= max(r["open"], r["close"]) and r["low"] <= min(r["open"], r["close"]) and r["volume"] > 0
        got.setdefault(r["symbol"], []).append((r["seq"], r["close"], r["n_trades"], r["volume"]))
    assert got == {s: [(b[0], b[6], b[8], b[7]) for b in bars] for s, bars in want.items()}
    assert {r[0] for r in made.select(close_reason(0.02)).distinct().collect()} == {"cusum"}


def test_stream_equals_table(spark, tmp_path):
    rows = tape(600)
    for i in range(3):
        part = [r for r in rows if r[1] // 200 == i]
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        stream_bars(source, 0.02)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(180)
    got = {(r["symbol"], r["seq"], r["close"], r["n_trades"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(s, b[0], b[6], b[8]) for s, bars in loop(rows).items() for b in bars}


def test_stream_windows_and_duplicates(spark, tmp_path):
    rows = [("A", i, T0 + timedelta(minutes=i), 1.0, 2.0, True) for i in range(200)]
    spark.createDataFrame(rows + rows[:50], COLUMNS).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in"))
    for frame, name in ((first_arrivals(source), "once"), (counts_per_window(source, "1 hour", "10 minutes"), "hours")):
        query = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("once").count() == 200
    assert spark.table("hours").where("window_start < timestamp'2020-01-01 03:00:00'").agg(F.sum("n_ticks")).first()[0] == 230


def test_count_bars_and_percentile(spark):
    made = count_bars(spark.createDataFrame(tape(23), COLUMNS), 5)
    assert made.count() == 8 and made.agg(F.min("n_trades")).first()[0] == 5
    one = spark.range(1, 11).agg(index_percentile(F.col("id"), 0.5).alias("m"), index_percentile(F.col("id"), 0.95).alias("p")).first()
    assert (one["m"], one["p"]) == (6, 10)


def tick_by_tick(rows, threshold, hours):
    """The filter tick by tick, as it is told: (open, close, n, sums) of each bar."""
    out, spos, sneg, last, bar = [], 0.0, 0.0, None, None
    for t, lp in rows:
        bar = bar or [t, 0]
        bar[1] += 1
        if last is not None:
            spos, sneg = max(0.0, spos + lp - last), min(0.0, sneg + lp - last)
        last = lp
        if spos >= threshold or -sneg >= threshold or t - bar[0] >= hours * HOUR:
            out.append((bar[0], t, bar[1], spos, sneg))
            spos, sneg, bar = 0.0, 0.0, None
    return out


@pytest.mark.parametrize(("threshold", "hours"), [(40, 168.0), (900, 168.0), (10**9, 0.05), (5000, 2.0)])
def test_stretches_equal_the_loop(threshold, hours):
    """Bars of a few ticks and of thousands, fed in parts."""
    rng = random.Random(threshold)
    t, lp, rows = 0, 0, []
    for _ in range(20_000):
        t += rng.randrange(1, 2_000_000)
        lp += rng.randrange(-20, 21)
        rows.append((t, lp))
    state, got, i = Cusum(threshold, hours), [], 0
    while i < len(rows):
        part = rows[i : i + rng.randrange(1, 3000)]
        got += state.feed([r[0] for r in part], [r[1] for r in part], [float(r[1]) for r in part], [1.0] * len(part))
        i += len(part)
    assert [(b[1], b[2], b[8], b[9], b[10]) for b in got] == tick_by_tick(rows, threshold, hours) and got


@pytest.mark.parametrize(("threshold", "chunk_hours"), [(60, 1.0), (400, 1.0), (2500, 2.0), (2500, 0.2), (10**9, 5.0)])
def test_chunks_equal_one_walk(spark, threshold, chunk_hours):
    """Chunks with many bars, few, or none that both walks close."""
    rng = random.Random(5)
    rows = []
    for s in ("A", "B", None):
        t, lp = 0, 0
        for i in range(3000):
            t += rng.randrange(1, 20)
            lp += rng.randrange(-20, 21)
            rows.append((s, i, T0 + timedelta(seconds=t), math.exp(lp / 1e5), float(i % 7), lp))
    rng.shuffle(rows)
    ticks = spark.createDataFrame(rows, "symbol string, agg_id long, ts timestamp, price double, qty double, lp long").repartition(3)
    made = cusum_bars(ticks, threshold, 3.0, F.col("lp"), chunk_hours=chunk_hours).orderBy("symbol", "seq").collect()
    whole = cusum_bars(ticks, threshold, 3.0, F.col("lp"), chunk_hours=None).orderBy("symbol", "seq").collect()
    assert [tuple(r) for r in made] == [tuple(r) for r in whole] and {r["symbol"] for r in whole} == {"A", "B"}
