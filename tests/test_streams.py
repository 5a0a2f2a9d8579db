"""Trades and recursive indicators go through a key's rows batch by batch, never as one array or frame."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from barloom.config import EMA_PERIODS, RSI_PERIODS
from barloom.functions import indicators as I
from barloom.operators import backtest as X

T0 = datetime(2024, 1, 1)
WHOLE_GROUPS = ("collect_list", "CollectList", "FlatMapGroups")


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("slots", [1, 3])
def test_trades_over_many_batches(small_batches, slots):
    rng = random.Random(5)
    rows = []
    for k in ("a", "b", None):
        for p in (0.5, float("nan")):
            rows += [(i, k, p, T0 + timedelta(hours=rng.randrange(90)), T0 + timedelta(hours=rng.randrange(90, 99)) if rng.random() < 0.1 else None) for i in range(80)]
    rows = [(i, k, p, a, b or a + timedelta(hours=rng.randrange(1, 9)), f"x{i}") for i, k, p, a, b in rows]
    rng.shuffle(rows)
    frame = small_batches.createDataFrame(rows, "bar_id long, k string, p double, entry_ts timestamp, exit_ts timestamp, extra string").repartition(3)
    made = X.select_trades(frame, ["k", "p"], slots)
    assert made.columns == ["k", "p", "entry_ts", "bar_id", "exit_ts", "extra"] and not any(x in plan(made) for x in WHOLE_GROUPS)
    want, open_ = [], {}
    for i, k, p, a, b, x in sorted(rows, key=lambda r: (r[3], r[0])):
        still = [t for t in open_.get((k, str(p)), []) if t > a]
        if len(still) < slots:
            still.append(b)
            want.append((k, str(p), a, i, b, x))
        open_[k, str(p)] = still
    assert sorted(((r[0], str(r[1]), *r[2:]) for r in made.collect()), key=str) == sorted(want, key=str)


def test_recursive_columns_over_many_batches(small_batches):
    rng = np.random.default_rng(6)
    rows = []
    for s, n in (("a", 200), ("b", 5), ("c", 61), ("d", 1)):
        close = 100 + rng.normal(size=n).cumsum()
        rows += [(s, i, T0 + timedelta(hours=i // 2), None if s == "c" and i in (0, 30, 31, 40) else float(c), f"x{i}") for i, c in enumerate(close)]
    frame = small_batches.createDataFrame(rows, "symbol string, bar_id long, bar_close_ts timestamp, close double, extra string").repartition(5)
    made = I.with_recursive(frame)
    assert made.columns == [*frame.columns, *I.RECURSIVE] and not any(x in plan(made) for x in WHOLE_GROUPS)
    got = made.collect()
    assert sorted(tuple(r[:5]) for r in got if r["close"] is not None) == sorted(r for r in rows if r[3] is not None) and len(got) == len(rows)
    assert not any(v != v for r in got for v in r[5:] if v is not None)
    for symbol in "abcd":
        mine = sorted((r for r in got if r["symbol"] == symbol), key=lambda r: r["bar_id"])
        close = pd.Series([r["close"] for r in mine], dtype=float)

        def ema(x, n):
            return x.ewm(span=n, adjust=False).mean()

        def same(name, want):
            assert np.allclose(np.array([r[name] for r in mine], float), want, rtol=1e-12, atol=1e-12, equal_nan=True), (symbol, name)

        line = ema(close, 12) - ema(close, 26)
        for n in EMA_PERIODS:
            same(f"ema_{n}", ema(close, n))
        same("macd_line", line)
        same("macd_signal", ema(line, 9))
        same("macd_hist", line - ema(line, 9))
        move = close.diff()[1:]
        for n in RSI_PERIODS:
            want = np.full(len(close), np.nan)
            if len(move) >= n:
                up, down = (pd.Series([np.mean(x[:n].to_numpy()), *x[n:]]).ewm(alpha=1 / n, adjust=False).mean().to_numpy() for x in (move.clip(lower=0), (-move).clip(lower=0)))
                want[n:] = 100 - 100 / (1 + up / down)
            same(f"rsi_{n}", want)
