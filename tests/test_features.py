"""Indicators, events and higher time frames against pandas and plain loops."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import indicators as I
from barloom.operators import tier1
from barloom.operators.asof import asof_backward, assign_to_bars
from barloom.operators.orderflow import order_flow

T0 = datetime(2024, 1, 1)
BARS = "symbol string, bar_id long, bar_open_ts timestamp, bar_close_ts timestamp, open double, high double, low double, close double, volume double, n_trades int, cusum_pos double, cusum_neg double"


def bars(spark, closes, every=timedelta(minutes=30), **over):
    rows = [("A", i + 1, T0 + every * i, T0 + every * (i + 1), c, over.get("high", c * 1.001), over.get("low", c * 0.999), c, 1.0, 1, 0.02, 0.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


def column(df, name):
    return [r[0] for r in df.orderBy("bar_id").select(name).collect()]


def test_contract(spark):
    made = I.build_features(bars(spark, [100 + 0.5 * i + 0.1 * (i % 3) for i in range(60)]))
    assert made.columns == ["symbol", "bar_id", "bar_close_ts", *I.FEATURES] and len(I.FEATURES) == 33
    assert all(made.schema[f].dataType.typeName() == "double" for f in I.FEATURES)
    frame = made.orderBy("bar_id").toPandas()
    assert frame[:5][I.FEATURES].isna().any().any() and not frame[50:][I.FEATURES].isna().any().any()
    for f in ("hour_sin", "hour_cos", "dow_sin", "dow_cos"):
        assert frame[f].between(-1, 1).all()


def test_bounds_and_symmetry(spark):
    frame = I.build_features(bars(spark, [100 + 10 * math.sin(i / 5) for i in range(80)])).orderBy("bar_id").toPandas()
    for f in ("rsi_6", "rsi_10", "rsi_14"):
        assert frame[f].dropna().between(0, 100).all() and frame[f].isna().sum() == int(f[4:])
    assert frame["williams_r"].dropna().between(-100, 0).all()
    assert np.allclose(frame["macd_hist"], frame["macd_line"] - frame["macd_signal"])
    close = pd.Series([100 + 10 * math.sin(i / 5) for i in range(80)])
    mid = close.rolling(5).mean()
    assert np.allclose((frame["bb_upper"] + frame["bb_lower"])[5:] / 2, mid[5:], atol=1e-9)
    assert np.allclose(frame["std_20"][20:], close.rolling(20).std()[20:])


def test_ema_recurrence(spark):
    closes = [100.0 + i for i in range(60)]
    made = column(I.with_recursive(bars(spark, closes)), "ema_20")
    y = closes[0]
    for i, c in enumerate(closes):
        y = c if i == 0 else y * (1 - 2 / 21) + c * 2 / 21
        assert made[i] == pytest.approx(y, abs=1e-9)


def test_rsi_recurrence():
    close = np.array([44.0 + 3 * math.sin(i) + 0.1 * i for i in range(40)])
    made, move = I.wilder_rsi(close, 14), np.diff(close)
    up, down = np.maximum(move, 0)[:14].mean(), np.maximum(-move, 0)[:14].mean()
    for i in range(14, 40):
        if i > 14:
            up, down = (up * 13 + max(move[i - 1], 0)) / 14, (down * 13 + max(-move[i - 1], 0)) / 14
        assert made[i] == pytest.approx(100 - 100 / (1 + up / down), abs=1e-9)
    assert I.wilder_rsi(np.arange(20.0), 14)[-1] == 100 and np.isnan(I.wilder_rsi(np.ones(20), 14)[-1])


def test_decay_through_missing():
    made = I.decayed_mean(pd.Series([1, np.nan, 2, 3.0]), 3, 1)
    assert made.tolist() == pytest.approx([1, 1, 5 / 3, 7 / 3])


def test_bars_since(spark):
    events = [False, False, True, False, False, True, False, False]
    rows = spark.createDataFrame([("A", T0 + timedelta(hours=i), i, e) for i, e in enumerate(events)], "symbol string, bar_close_ts timestamp, bar_id int, e boolean")
    made = rows.withColumn("n", F.row_number().over(I.bar_order())).withColumn("s", I.bars_since(F.col("e"), F.col("n"), I.bar_order()))
    assert column(made, "s") == [None, None, 0, 1, 2, 0, 1, 2]


def test_higher_frames(spark):
    made = tier1.higher_frames(bars(spark, [100 * math.exp(0.01 * i) for i in range(12)], timedelta(hours=4)))
    got = column(made, "htf_4h")
    assert got[0] is None and all(x == pytest.approx(0.01, abs=1e-9) for x in got[1:])
    assert column(made, "htf_1d")[:6] == [None] * 6


def test_atr(spark):
    made = tier1.atr_rank(bars(spark, [101.0] * 40, high=102.0, low=100.0))
    assert column(made, "atr") == [None] * 13 + [2.0] * 27


def test_pivot(spark):
    closes = [100.0] * 48 + [110.0] * 10
    made = tier1.pivot_distances(bars(spark, closes, high=101.0, low=99.0))
    got = column(made, "dist_pivot")
    assert got[0] is None and got[-1] == pytest.approx(math.log(1.10), abs=1e-9)


def test_week_position_and_day_return(spark):
    rng = np.random.default_rng(3)
    closes = (100 + rng.normal(0, 1, 120).cumsum()).tolist()
    made = tier1.week_position(tier1.day_return(bars(spark, closes, timedelta(hours=5)))).orderBy("bar_id").toPandas()
    for i in range(120):
        ts = made["bar_close_ts"][i]
        week = [j for j in range(i + 1) if made["bar_close_ts"][j] >= ts - pd.Timedelta(days=7)]
        top, bottom = max(made["high"][j] for j in week), min(made["low"][j] for j in week)
        assert made["weekly_range_pos"][i] == pytest.approx((closes[i] - bottom) / (top - bottom))
        before = [j for j in range(i) if made["bar_close_ts"][j] < ts.normalize()]
        got = made["daily_ret_pct"][i]
        assert pd.isna(got) if not before else got == pytest.approx(closes[i] / closes[before[-1]] - 1)


def test_tick_assignment_with_ties(spark):
    closes = [10, 20, 20, 30]
    made = spark.createDataFrame([("A", i, T0, T0 + timedelta(seconds=c)) for i, c in enumerate(closes)], "symbol string, bar_id long, bar_open_ts timestamp, bar_close_ts timestamp")
    ticks = spark.createDataFrame([("A", t, T0 + timedelta(seconds=t), 1.0, t % 2 == 0) for t in (0, 1, 10, 11, 20, 21, 30, 31)], "symbol string, agg_id long, ts timestamp, qty double, is_buyer_maker boolean")
    got = {r["agg_id"]: r["bar_id"] for r in assign_to_bars(ticks, made).collect()}
    assert got == {1: 0, 10: 0, 11: 1, 20: 1, 21: 3, 30: 3}
    flow = {r["bar_id"]: (r["taker_buy_vol"], r["taker_sell_vol"], r["n_ticks"]) for r in order_flow(ticks, made).collect()}
    assert flow == {0: (1.0, 1.0, 2), 1: (1.0, 1.0, 2), 3: (1.0, 1.0, 2)}


def test_asof(spark):
    left = spark.createDataFrame([("A", 5), ("A", 1), ("B", 9)], "k string, t int")
    right = spark.createDataFrame([("A", 2, "x"), ("A", 5, "y"), ("B", 10, "z")], "k string, t int, v string")
    got = {(r["k"], r["t"]): r["v"] for r in asof_backward(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("A", 5): "y", ("A", 1): None, ("B", 9): None}
