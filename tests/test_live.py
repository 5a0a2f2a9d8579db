"""The live loop: ticks in any order give the bars of ticks in order, and the stream's features the batch's, over restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import indicators as I
from barloom.operators.bars import cusum_bars
from barloom.streaming import live
from barloom.streaming.bars import stream_bars

T0 = datetime(2024, 1, 1)
KIND = "symbol string, agg_id long, ts timestamp, price double, qty double"


def tape(n, seed=4):
    """Ticks of two symbols, some at the same time, and a last one far ahead, which lets all others go."""
    rng, rows = random.Random(seed), []
    for s in ("A", "B"):
        price, t = 100.0, T0
        for i in range(n):
            t += timedelta(minutes=rng.choice([0, 1, 2, 9]))
            price *= 1 + rng.gauss(0, 0.012)
            rows.append((s, i, t, price, rng.randrange(1, 9) / 4))
        rows.append((s, n, t + timedelta(days=1), price, 1.0))
    return rows


def shuffled(rows, minutes=20, seed=1):
    """rows in order of arrival: none comes more than so many minutes after a later one."""
    rng = random.Random(seed)
    return [r for _, r in sorted(((r[2] + timedelta(minutes=rng.random() * minutes), r) for r in rows), key=lambda x: x[0])]


def write(spark, folder, rows, name):
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(folder / f"{name}"))


def run(spark, tmp_path, make, parts, out="out"):
    """Feeds parts one after another, each by a query of its own from the same checkpoint."""
    (tmp_path / "in").mkdir(exist_ok=True)
    for i, part in enumerate(parts):
        write(spark, tmp_path / "in", part, f"d={i}")
        source = spark.readStream.schema(KIND + ", d int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("d")
        query = make(source).writeStream.format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / f"k-{out}"))
        query.trigger(availableNow=True).start().awaitTermination(240)
    return spark.read.parquet(str(tmp_path / out))


def thirds(rows):
    k = len(rows) // 3
    return [rows[:k], rows[k : 2 * k], rows[2 * k :]]


def test_shuffled_ticks_come_out_in_order(spark, tmp_path):
    rows = tape(150)
    arrived = shuffled(rows)
    # a repeat of a waiting tick, one of a passed tick, and a tick that comes far too late
    parts = thirds(arrived)
    parts[1] = [*parts[1], parts[1][-1], ("A", 10_000, T0, 1.0, 1.0), rows[0]]
    made = run(spark, tmp_path, lambda t: live.reordered(t, "30 minutes"), parts)
    late = [(r.symbol, r.agg_id) for r in made.where("late").collect()]
    assert sorted(late) == [("A", 0), ("A", 10_000)]
    got = made.where("NOT late").collect()
    # the last tick of each symbol still waits
    want = [r for r in rows if r[1] < 150]
    assert sorted((r.symbol, r.agg_id) for r in got) == sorted((r[0], r[1]) for r in want)


def test_bars_and_features_equal_the_batch(spark, tmp_path):
    rows = tape(420)
    made = run(spark, tmp_path, lambda t: live.stream_features(stream_bars(live.reordered(t, "30 minutes").drop("late"), 0.02)), thirds(shuffled(rows)))
    assert made.columns == ["symbol", "bar_id", "bar_close_ts", "high", "low", "close", *I.FEATURES]
    batch = cusum_bars(spark.createDataFrame([r for r in rows if r[1] < 420], KIND), 0.02)
    want = {(r.symbol, r.bar_id): r for r in I.build_features(batch.withColumnRenamed("seq", "bar_id")).collect()}
    got = {(r.symbol, r.bar_id): r for r in made.collect()}
    assert set(got) == set(want) and len(got) > 120
    for key, r in got.items():
        assert r.bar_close_ts == want[key].bar_close_ts
        for f in I.FEATURES:
            a, b = r[f], want[key][f]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9)), (key, f, a, b)


def test_a_silent_symbol_hands_on_what_waits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("A", i, T0 + timedelta(seconds=i), 1.0, 1.0) for i in (3, 1, 2)]
    write(spark, tmp_path / "in", rows, "d=0")
    source = spark.readStream.schema(KIND + ", d int").parquet(str(tmp_path / "in")).drop("d")
    query = live.reordered(source, "1 hour", idle="3 seconds").writeStream.format("memory").queryName("idle_ticks")
    query = query.option("checkpointLocation", str(tmp_path / "k")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            got = spark.table("idle_ticks").collect()
            if got:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert [(r.agg_id, r.late) for r in got] == [(1, False), (2, False), (3, False)]


def score(rows):
    k = (F.col("bar_id") * 37) % 10
    p = {"p_long": F.when(k < 4, 0.7).otherwise(0.1), "p_short": F.when((k >= 4) & (k < 8), 0.7).otherwise(0.1), "p_neutral": F.lit(0.2)}
    return rows.withColumns(p)


def by_hand(bars, tp, sl, vertical, cost, limit):
    """A session's events, bar after bar."""
    events, open_, day, pnl = [], {"A": [], "B": []}, None, 0.0
    for t, s, i, high, low, close in sorted(bars):
        if t.date() != day:
            day, pnl = t.date(), 0.0
        busy = len(open_[s])
        for p in list(open_[s]):
            p[3] += 1
            up, down = p[1] * (1 + p[2] * tp), p[1] * (1 - p[2] * sl)
            lost = low <= down if p[2] == 1 else high >= down
            won = high >= up if p[2] == 1 else low <= up
            if lost or won or p[3] >= vertical:
                price = down if lost else up if won else close
                net = p[2] * (price / p[1] - 1) * 1e4 - cost
                pnl += net
                events.append((s, p[0], "exit", round(net, 6)))
                open_[s].remove(p)
        k = (i * 37) % 10
        if k < 8:
            halted = pnl <= -100 * limit
            events.append((s, i, "halted" if halted else "passed" if busy else "entry", None))
            if not halted and not busy:
                open_[s].append([i, close, 1 if k < 4 else -1, 0])
    return events


def test_ticks_to_trades_over_restarts(spark, tmp_path):
    rows = tape(300)
    loop = lambda t: live.trading_loop(t, score, 7, F.lit(0.6), 0.02, 0.03, 0.02, 4, delay="30 minutes", max_loss_pct=1.5)
    # a session's symbols are decided in order of time within a trigger: one trigger a restart
    made = run(spark, tmp_path, loop, [shuffled(rows)])
    got = sorted((r.symbol, r.bar_id, r.event, None if r.pnl_bps_net is None else round(r.pnl_bps_net, 6)) for r in made.collect())
    batch = cusum_bars(spark.createDataFrame([r for r in rows if r[1] < 300], KIND), 0.02)
    bars = [(r.bar_close_ts, r.symbol, r.seq, r.high, r.low, r.close) for r in batch.collect()]
    want = by_hand(bars, 0.03, 0.02, 4, 11.0, 1.5)
    assert got == sorted(want, key=lambda e: e[:3]) and {e[2] for e in want} == {"entry", "exit", "passed", "halted"}


def test_positions_and_the_days_loss_outlive_a_restart(spark, tmp_path):
    one = [r for r in tape(300) if r[0] == "A"]
    loop = lambda t: live.trading_loop(t, score, 7, F.lit(0.6), 0.02, 0.03, 0.02, 4, delay="30 minutes", max_loss_pct=1.5)
    made = run(spark, tmp_path, loop, thirds(shuffled(one)))
    got = sorted((r.symbol, r.bar_id, r.event, None if r.pnl_bps_net is None else round(r.pnl_bps_net, 6)) for r in made.collect())
    batch = cusum_bars(spark.createDataFrame([r for r in one if r[1] < 300], KIND), 0.02)
    bars = [(r.bar_close_ts, r.symbol, r.seq, r.high, r.low, r.close) for r in batch.collect()]
    assert got == sorted(by_hand(bars, 0.03, 0.02, 4, 11.0, 1.5), key=lambda e: e[:3])


def test_windowed_of_few_bars():
    import pandas as pd

    bars = pd.DataFrame({c: np.arange(1.0, 4.0) for c in live._BARS})
    made = live.windowed(bars)
    assert set(made) == set(live._WINDOWED) and all(len(v) == 3 for v in made.values())
    assert np.isnan(made["std_5"]).all() and np.isnan(made["ret_1"][0]) and made["ret_1"][1] == pytest.approx(np.log(2))
