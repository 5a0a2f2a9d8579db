"""Triple-barrier labels against a loop, live exits, and later touches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.config import LabelParams
from barloom.operators.labels import live_exits, touched_after, triple_barrier

T0 = datetime(2024, 1, 1)
BARS = "symbol string, bar_id long, bar_close_ts timestamp, close double, high double, low double"


def bars(spark, closes, highs=None, lows=None):
    rows = [("A", i, T0 + timedelta(hours=i), float(c), float((highs or closes)[i]), float((lows or closes)[i])) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


def labels(df, tp=0.05, sl=0.05, vertical=24):
    made = triple_barrier(df, tp, sl, vertical).orderBy("bar_id")
    return [(r["label"], r["exit_reason"], r["holding_bars"], r["exit_bar_id"], r["exit_price"]) for r in made.collect()]


def test_golden(spark):
    closes = [100] * 5 + [110, 85] + [100] * 23
    got = labels(bars(spark, closes))
    assert [g[:3] for g in got[:6]] == [(0, "tp", 5), (0, "tp", 4), (0, "tp", 3), (0, "tp", 2), (0, "tp", 1), (1, "sl", 1)]
    assert all(g == (-1, None, None, None, None) for g in got[6:])


@pytest.mark.parametrize(("touches", "want"), [({1: "h"}, (0, "tp", 1)), ({24: "l"}, (1, "sl", 24)), ({3: "h", 5: "l"}, (0, "tp", 3)), ({3: "l", 5: "h"}, (1, "sl", 3)), ({4: "hl"}, (2, "ambiguous", 4)), ({}, (2, "timeout", 24)), ({25: "h"}, (2, "timeout", 24))])
def test_first_touch(spark, touches, want):
    closes = [100] * 30
    highs = [106 if "h" in touches.get(i, "") else 100 for i in range(30)]
    lows = [94 if "l" in touches.get(i, "") else 100 for i in range(30)]
    assert labels(bars(spark, closes, highs, lows))[0][:3] == want


def loop(closes, highs, lows, tp, sl, vertical):
    out = []
    for i, c in enumerate(closes):
        if i + vertical >= len(closes):
            out.append((-1, None, None, None, None))
            continue
        found = (2, "timeout", vertical)
        for h in range(1, vertical + 1):
            up, down = highs[i + h] >= c * (1 + tp), lows[i + h] <= c * (1 - sl)
            if up or down:
                found = (2, "ambiguous", h) if up and down else (0, "tp", h) if up else (1, "sl", h)
                break
        out.append((*found, i + found[2], closes[i + found[2]]))
    return out


def test_random_walk(spark):
    rng, closes = random.Random(5), [100.0]
    for _ in range(400):
        closes.append(closes[-1] * (1 + rng.gauss(0, 0.015)))
    highs, lows = [c * (1 + rng.random() * 0.02) for c in closes], [c * (1 - rng.random() * 0.02) for c in closes]
    assert labels(bars(spark, closes, highs, lows), 0.04, 0.03, 12) == loop(closes, highs, lows, 0.04, 0.03, 12)


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        LabelParams(tp=0.0)


def test_later_touch(spark):
    df = bars(spark, [100] * 30, [106 if i == 2 else 100 for i in range(30)], [94 if i == 7 else 100 for i in range(30)])
    made = touched_after(df, triple_barrier(df, 0.05, 0.05, 24), 0.05, 0.05, 24)
    first = {r["bar_id"]: r["later_touch"] for r in made.collect()}
    assert first[0] is True and first[4] is False


def test_live_exits(spark):
    df = bars(spark, [100] * 30, [106 if i == 3 else 100 for i in range(30)])
    entries = spark.createDataFrame([("A", 0, 1), ("A", 1, -1), ("A", 4, 1), ("A", 20, 1)], "symbol string, bar_id long, direction int")
    got = {r["bar_id"]: (r["exit_reason"], r["holding_bars"], r["exit_price"]) for r in live_exits(entries, df, 0.05, 0.05, 24).collect()}
    assert got[0] == ("tp", 3, 105.0) and got[1] == ("sl", 2, 105.0) and got[4] == ("timeout", 24, 100.0) and got[20] == (None, None, None)


def test_barriers_as_columns(spark):
    df = bars(spark, [100] * 30, [104 if i == 3 else 100 for i in range(30)])
    many = df.crossJoin(spark.createDataFrame([(0.03,), (0.05,)], "b double"))
    made = triple_barrier(many, F.col("b"), F.col("b"), 24, ("symbol", "b")).where("bar_id = 0")
    assert {r["b"]: r["exit_reason"] for r in made.collect()} == {0.03: "tp", 0.05: "timeout"}
