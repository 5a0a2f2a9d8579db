"""Decayed means against pandas, through missing values, keys and batches; and the assembled matrices' columns."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from barloom.functions import indicators as I
from barloom.operators import matrices as M

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_decayed_means_are_those_of_pandas(spark, batch):
    rng = random.Random(3)
    rows = [(k, i, T0 + timedelta(hours=i // 2), None if rng.random() < 0.3 else rng.gauss(0, 1), "x") for k in ("a", "b", None) for i in range(60)]
    rows += [("c", i, T0, None, "x") for i in range(4)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        made = I.with_decayed(spark.createDataFrame(rows, "symbol string, bar_id long, bar_close_ts timestamp, v double, other string").repartition(5), "v", {"e5": (5, 5), "e20": (20, 20)})
        assert made.columns == ["symbol", "bar_id", "bar_close_ts", "v", "other", "e5", "e20"]
        got = made.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for k in ("a", "b", None, "c"):
        own = sorted((r for r in got if r.symbol == k), key=lambda r: r.bar_id)
        values = pd.Series([r.v for r in own], dtype=float)
        for name, n in (("e5", 5), ("e20", 20)):
            assert np.allclose(np.array([r[name] for r in own], float), I.decayed_mean(values, n, n), equal_nan=True)


def test_matrices_have_a_row_for_each_bar(spark):
    rng, rows, price = random.Random(5), [], 100.0
    for i in range(130):
        price *= 1 + rng.gauss(0, 0.01)
        a = T0 + timedelta(hours=7 * i)
        rows.append(("A", i, a, a + timedelta(hours=6), price, price * 1.01, price * 0.99, price, 5.0, 3, 0.02, 0.0))
    kind = "symbol string, bar_id long, bar_open_ts timestamp_ntz, bar_close_ts timestamp_ntz, open double, high double, low double, close double, volume double, n_trades long, cusum_pos double, cusum_neg double"
    bars = spark.createDataFrame(rows, kind)
    # the first forty bars have no ticks
    ticks = [("A", j, rows[i][2] + timedelta(hours=1 + j % 3), 1.0, 1.0 + j % 2, j % 3 == 0) for i in range(40, 130) for j in range(3 * i, 3 * i + 3)]
    tape = spark.createDataFrame(ticks, "symbol string, agg_id long, ts timestamp_ntz, price double, qty double, is_buyer_maker boolean")
    one, two = M.tier1_matrix(bars), M.v2_matrix(bars, tape)
    assert one.columns == ["symbol", "bar_id", "bar_close_ts", *I.FEATURES, *M.TIER1] and len(M.TIER1) == 15
    assert two.columns == ["symbol", "bar_id", "bar_close_ts", *I.FEATURES, *M.V2] and len(M.V2) == 8
    assert all(t == "double" for _, t in [*one.dtypes[3:], *two.dtypes[3:]])
    a, b = one.orderBy("bar_id").collect(), two.orderBy("bar_id").collect()
    assert [r.bar_id for r in a] == [r.bar_id for r in b] == list(range(130))
    assert all(r.taker_buy_ratio is None for r in b[:40]) and all(r.taker_buy_ratio is not None for r in b[40:])
    assert b[43].taker_buy_ratio_ema5 is None and b[44].taker_buy_ratio_ema5 is not None and b[58].taker_buy_ratio_ema20 is None and b[59].taker_buy_ratio_ema20 is not None
    assert a[0].dist_pivot is None and a[-1].dist_pivot is not None and a[-1].atr_rank is not None
