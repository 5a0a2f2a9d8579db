"""Folds, splits, gates, trades, equity and metrics."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.config import FoldParams
from barloom.operators import backtest as X
from barloom.operators import models as L
from barloom.operators import sessions as S
from barloom.operators import validation as V

T0 = datetime(2024, 1, 1)


def test_folds(spark):
    made = [tuple(map(str, r)) for r in V.folds(spark, "2019-01-01", "2026-05-01").orderBy("fold_id").collect()]
    assert 18 <= len(made) <= 20
    assert made[0] == ("1", "2019-01-01", "2021-01-01", "2021-04-01", "2021-07-01")
    assert made[1][1:3] == ("2019-01-01", "2021-04-01")


def hourly(spark, n=264):
    return spark.createDataFrame([(i, datetime(2020, 1, 1) + timedelta(hours=i)) for i in range(n)], "bar_id long, ts timestamp")


FOLD = "fold_id int, train_start timestamp, val_start timestamp, oot_start timestamp, oot_end timestamp"


def parts(spark, p):
    fold = spark.createDataFrame([(1, *(datetime(2020, 1, d) for d in (1, 5, 8, 12)))], FOLD)
    rows = V.split(hourly(spark), fold, "ts", "bar_id", p).groupBy("role").agg(F.count("*").alias("n"), F.min("bar_id").alias("a"), F.max("bar_id").alias("b"))
    return {r["role"]: (r["n"], r["a"], r["b"]) for r in rows.collect()}


def test_purge_and_embargo(spark):
    got = parts(spark, FoldParams(purge=24, embargo=24))
    assert {k: v[0] for k, v in got.items()} == {"train": 72, "val": 72, "oot": 72}
    assert got["val"][1] - got["train"][2] == 25 and got["oot"][1] - got["val"][2] == 25
    assert parts(spark, FoldParams(purge=500, embargo=24))["train"][0] == 96


@pytest.mark.parametrize(("classes", "want"), [([0, 1, 2], math.log(3)), ([0, 0, 0, 0, 1, 2], 0.867563), ([1, 1], 0.0)])
def test_entropy(spark, classes, want):
    made = V.entropy(spark.createDataFrame([(c,) for c in classes], "label int"), "label")
    assert made.first()[0] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("ratios", "want"), [([0.95, 0.97, 0.95, 0.99, 0.98, 1.01], (4, True)), ([0.95, 0.97, 0.95, 1.0, 1.01, 1.02, 0.5], (3, False))])
def test_pre_gate(spark, ratios, want):
    made = V.pre_gate(spark.createDataFrame([(i, r) for i, r in enumerate(ratios)], "fold_id int, ratio double"))
    assert tuple(made.first()) == want


def test_log_loss(spark):
    rows = spark.createDataFrame([([0.7, 0.2, 0.1], 0), ([0.0, 1.0, 0.0], 0)], "p array<double>, y int")
    assert rows.agg(V.log_loss(F.col("p"), F.col("y"))).first()[0] == pytest.approx((-math.log(0.7) - math.log(1e-15)) / 2)


SIGNALS = "k string, bar_id long, entry_ts timestamp, exit_ts timestamp, entry_price double, exit_price double, holding_bars int, direction int"


def signals(spark, spans, price=105.0):
    return spark.createDataFrame([("A", i, T0 + timedelta(hours=a), T0 + timedelta(hours=b), 100.0, price, b - a, 1) for i, (a, b) in enumerate(spans)], SIGNALS)


@pytest.mark.parametrize("slots", [1, 2])
def test_non_overlap(spark, slots):
    rng = random.Random(3)
    spans = [(i, i + rng.randrange(1, 9)) for i in range(60)]
    got = sorted(r["bar_id"] for r in X.select_trades(signals(spark, spans), ["k"], slots).collect())
    want, open_ = [], []
    for i, (a, b) in enumerate(spans):
        open_ = [t for t in open_ if t > a]
        if len(open_) < slots:
            open_.append(b)
            want.append(i)
    assert got == want


def test_signal_rules(spark):
    rows = spark.createDataFrame([(0.7, 0.8, 0.0), (0.5, 0.7, 0.0), (0.6, 0.3, 0.1), (0.2, 0.1, 0.7)], "p_long double, p_short double, p_neutral double")
    made = rows.select(X.signal(F.lit(0.6)).alias("s"), X.live_decision(F.lit(0.6))[0].alias("d"))
    assert [tuple(r) for r in made.collect()] == [(1, "short"), (-1, "short"), (0, "long"), (0, "skip")]


def test_equity_and_metrics(spark):
    trades = X.with_pnl(signals(spark, [(0, 30), (40, 80)]), F.lit(11.0))
    assert [r["pnl_bps_net"] for r in trades.collect()] == pytest.approx([489.0, 489.0])
    curve = [r["equity"] for r in X.equity_curve(trades, ["k"]).orderBy("n").collect()]
    assert curve == pytest.approx([10_000.0, 10_489.0, 10_489.0 * 1.0489])
    m = X.metrics(trades, ["k"], spark.createDataFrame([("A", 140)], "k string, n_bars int")).first()
    eq = {0: 1.0, 1: 1.0489, 2: 1.0489, 3: 1.0489**2}
    ret = np.log([eq[i + 1] / eq[i] for i in range(3)])
    assert m["n_trades"] == 2 and m["win_pct"] == 100 and m["pct_time_in_market"] == pytest.approx(50.0)
    assert m["sharpe"] == pytest.approx(ret.mean() / ret.std(ddof=1) * math.sqrt(252)) and m["sortino"] == 0 and m["max_dd"] == 0
    assert m["annual_return"] == pytest.approx(np.prod(1 + ret) ** (252 / 3) - 1)


def test_cost_can_turn_a_winner(spark):
    t = X.with_pnl(signals(spark, [(0, 5)], 100.05), F.lit(11.0))
    assert t.first()["pnl_bps_gross"] == pytest.approx(5.0) and X.metrics(t, ["k"]).first()["win_pct"] == 0


def test_models_and_calibration(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(900, 2))
    y = np.where(x[:, 0] > 0.4, 0, np.where(x[:, 0] < -0.4, 1, 2))
    rows = spark.createDataFrame([(i, float(a), float(b) if i % 50 else None, int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "bar_id long, f1 double, f2 double, label int")
    model = L.fit_classifier(rows.where("bar_id < 600"), ["f1", "f2"], kind="forest")
    made = L.predict(model, rows.where("bar_id >= 600"))
    assert made.select(F.abs(F.col("p_long") + F.col("p_short") + F.col("p_neutral") - 1).alias("d")).agg(F.max("d")).first()[0] < 1e-9
    assert L.importance(model, ["f1", "f2"], 1)[0][0] == "f1"
    fitted = L.fit_platt(made)
    cal = L.apply_platt(made, fitted)
    assert cal.select(F.abs(F.col("p_long") + F.col("p_short") + F.col("p_neutral") - 1).alias("d")).agg(F.max("d")).first()[0] < 1e-9
    loss = [d.agg(V.log_loss(F.array("p_long", "p_short", "p_neutral"), F.col("label"))).first()[0] for d in (made, cal)]
    assert loss[0] < 0.6 and loss[1] < 0.8
    assert L.fit_platt(made.withColumn("label", F.lit(0))) == {"p_long": None, "p_short": None, "p_neutral": None}


def test_leak_is_seen(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 600)
    rows = spark.createDataFrame([(i, float(rng.normal()), float(c) + 0.01 * float(rng.normal()), int(c)) for i, c in enumerate(y)], "bar_id long, noise double, leak double, label int")
    loss = {}
    for f in (["noise"], ["noise", "leak"]):
        made = L.predict(L.fit_classifier(rows.where("bar_id < 400"), f, kind="logistic"), rows.where("bar_id >= 400"))
        loss[len(f)] = made.agg(V.log_loss(F.array("p_long", "p_short", "p_neutral"), F.col("label"))).first()[0] / math.log(3)
    assert loss[1] > 0.7 and loss[2] < 0.5


def test_meta_label_and_splits(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([("A", i, 1 + i // 40, T0 + timedelta(hours=i), float(v), int(v > 0)) for i, v in enumerate(rng.normal(size=240))], "symbol string, bar_id long, fold_id int, bar_close_ts timestamp, f double, win int")
    assert {r[0] for r in L.meta_label(rows, ["f"], 2).select("meta_proba").collect()} == {1.0}
    late = L.meta_label(rows, ["f"], 5)
    right = late.agg(F.avg(((F.col("meta_proba") > 0.5).cast("int") == F.col("win")).cast("int"))).first()[0]
    assert right > 0.9
    assert L.time_split(rows, "bar_close_ts", "bar_id").where("is_train").count() == 192
    z = L.standardised(rows, rows, ["f"]).agg(F.avg("f"), F.stddev_pop("f")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)


def test_sessions(spark):
    sessions = spark.createDataFrame([(1, "a"), (2, "b")], "session_id long, name string")
    trades = spark.createDataFrame([(1, 1, "open", None, None), (2, 1, "exited", 50.0, T0), (3, 1, "exited", -20.0, T0)], "trade_id long, session_id long, status string, pnl_bps double, exit_ts timestamp")
    got = {r["session_id"]: (r["n_trades"], r["n_open"], r["n_winners"], r["total_pnl_bps"]) for r in S.session_overview(sessions, trades).collect()}
    assert got == {1: (3, 1, 1, 30.0), 2: (0, 0, 0, 0.0)}
    ties = S.running_pnl(trades.where("status = 'exited'"), "session_id").select("cum_pnl_bps").collect()
    assert [r[0] for r in ties] == [30.0, 30.0]
