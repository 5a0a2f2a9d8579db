"""Losses of all and of more than all in the equity curve and in what is reckoned from it."""

from __future__ import annotations

import math
from datetime import datetime

import pytest

from barloom.operators import backtest as X


def _trades(spark, *pnl):
    rows = [("A", i, datetime(2024, 1, 1 + i), datetime(2024, 1, 2 + i), float(p), 1) for i, p in enumerate(pnl)]
    return spark.createDataFrame(rows, "k string, bar_id long, entry_ts timestamp, exit_ts timestamp, pnl_bps_net double, holding_bars int")


def test_more_than_all_is_nan_from_there_on(spark):
    trades = _trades(spark, 1000, -12_000, 500)
    curve = X.equity_curve(trades, ["k"])
    equity = [r["equity"] for r in curve.orderBy("n").collect()]
    assert equity[:2] == pytest.approx([10_000, 11_000]) and all(map(math.isnan, equity[2:])) and len(equity) == 4
    fallen = [r["drawdown"] for r in X.drawdown(curve, ["k"]).orderBy("n").collect()]
    assert fallen[:2] == [0, 0] and all(map(math.isnan, fallen[2:]))
    returns = [r["ret"] for r in X.daily_returns(curve, ["k"]).orderBy("day").collect()]
    assert returns[0] == pytest.approx(math.log(1.1)) and all(map(math.isnan, returns[1:])) and len(returns) == 3
    made = X.metrics(trades, ["k"]).first()
    assert math.isnan(made["annual_return"]) and math.isnan(made["sharpe"]) and made["n_trades"] == 3 and made["max_dd"] == 0


def test_all_is_zero_from_there_on(spark):
    trades = _trades(spark, -10_000, 500)
    curve = X.equity_curve(trades, ["k"])
    assert [r["equity"] for r in curve.orderBy("n").collect()] == [10_000, 0, 0]
    returns = [r["ret"] for r in X.daily_returns(curve, ["k"]).orderBy("day").collect()]
    assert returns[0] == -math.inf and math.isnan(returns[1]) and len(returns) == 2
    assert X.metrics(trades, ["k"]).first()["max_dd"] == -1


def test_a_day_that_loses_more_than_its_log_return_holds(spark):
    """Log returns below -1, compounded as they are, give nan and don't drop out."""
    assert math.isnan(X.metrics(_trades(spark, 100, -8000, 300), ["k"]).first()["annual_return"])
