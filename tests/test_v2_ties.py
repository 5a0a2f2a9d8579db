"""The v2 matrix's week with bars that close at the same time, and the regime's median of whole windows."""

from __future__ import annotations

from datetime import datetime, timedelta
from statistics import median, stdev

import numpy as np
import pytest

from barloom.operators import matrices as M
from barloom.operators import tier1


def test_the_week_has_the_bars_of_the_same_time(spark):
    t = datetime(2024, 1, 1)
    rows = [("A", i, t, t + timedelta(hours=1), c, c, c, c, 5.0, 5, 0.02, 0.0) for i, c in enumerate((100.0, 104.0, 101.0))]
    bars = spark.createDataFrame(rows, "symbol string, bar_id long, bar_open_ts timestamp_ntz, bar_close_ts timestamp_ntz, open double, high double, low double, close double, volume double, n_trades long, cusum_pos double, cusum_neg double")
    ticks = spark.createDataFrame([("A", 1, t + timedelta(minutes=9), 100.0, 1.0, True)], "symbol string, agg_id long, ts timestamp_ntz, price double, qty double, is_buyer_maker boolean")
    got = M.v2_matrix(bars, ticks, peers=True).orderBy("bar_id").collect()
    assert [r["weekly_range_pos"] for r in got] == [0.0, 1.0, 0.25]


@pytest.mark.parametrize("long", [6, 7])
def test_regime_ratio_by_hand(spark, long):
    close = np.exp(np.random.default_rng(1).normal(0, 0.1, 30).cumsum()).tolist()
    rows = [("A", i, datetime(2024, 1, 1) + timedelta(hours=i), c) for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "symbol string, bar_id long, bar_close_ts timestamp_ntz, close double")
    got = [r["regime_vol_ratio"] for r in tier1.regime_ratio(bars, 4, long).orderBy("bar_id").collect()]
    ret = [None, *np.diff(np.log(close)).tolist()]
    vol = [stdev(ret[i - 3 : i + 1]) if i >= 4 else None for i in range(30)]
    want = [vol[i] / median(vol[i - long + 1 : i + 1]) if i >= 4 + long - 1 else None for i in range(30)]
    assert got == pytest.approx(want)
