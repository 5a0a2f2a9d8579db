"""Walk-forward runs, the regression, ablation and saved models, end to end on a small tape."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.config import BacktestParams, FoldParams
from barloom.operators import models, study
from barloom.operators.validation import data_range, folds
from barloom.sources import tables

T0 = datetime(2024, 1, 1)
PARAMS = FoldParams(train_months=2, val_months=1, oot_months=1, step_months=1, purge=3, embargo=3, min_rows=20)


@pytest.fixture(scope="module")
def rows(spark):
    """Six months of six-hourly bars whose label follows one feature; another is noise."""
    rng, made = random.Random(18), []
    for i in range(6 * 122):
        t, x = T0 + timedelta(hours=6 * i), rng.gauss(0, 1)
        label = (0 if x > 0.6 else 1 if x < -0.6 else 2) if rng.random() < 0.85 else rng.randrange(3)
        move = {0: 0.05, 1: -0.05, 2: 0.0}[label]
        made.append(("A", i, t, x, rng.gauss(0, 1), label, t + timedelta(hours=3), 100.0, 100.0 * (1 + move), "tp", 1))
    kind = "symbol string, bar_id long, bar_close_ts timestamp, x double, noise double, label int, exit_ts timestamp, entry_price double, exit_price double, exit_reason string, holding_bars int"
    return spark.createDataFrame(made, kind).cache()


@pytest.fixture(scope="module")
def predicted(spark, rows):
    span = data_range(rows, "bar_close_ts").first()
    calendar = folds(spark, str(span["data_start"]), str(span["data_end"]), PARAMS)
    return study.walk_forward(rows, calendar, ["x", "noise"], PARAMS, kind="logistic", first_n=2).cache()


def test_predictions_of_later_folds(rows, predicted):
    got = predicted.groupBy("fold_id").agg(F.min("bar_close_ts").alias("a"), F.max("bar_close_ts").alias("b"), F.count("*").alias("n")).orderBy("fold_id").collect()
    assert [(r["a"].month, r["b"].month) for r in got] == [(4, 4), (5, 5)]
    # the embargo takes each fold's first rows
    assert [r["a"].replace(tzinfo=None) for r in got] == [datetime(2024, 4, 1, 18), datetime(2024, 5, 1, 18)]
    sums = predicted.select((F.col("p_long") + F.col("p_short") + F.col("p_neutral")).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)
    right = predicted.where((F.col("p_long") > 0.6) & (F.col("label") == 0)).count() / max(predicted.where("p_long > 0.6").count(), 1)
    assert right > 0.6


def test_trades_of_predictions(predicted):
    trades = study.backtested(predicted, BacktestParams(threshold=0.6)).collect()
    assert trades and sum(t["pnl_bps_net"] for t in trades) > 0
    per_key = {}
    for t in sorted(trades, key=lambda t: (t["fold_id"], t["entry_ts"])):
        assert t["entry_ts"] >= per_key.get(t["fold_id"], t["entry_ts"])
        per_key[t["fold_id"]] = t["exit_ts"]


def test_no_usable_fold(spark, rows):
    calendar = folds(spark, "2030-01-01", "2031-01-01", PARAMS)
    made = study.walk_forward(rows, calendar, ["x"], PARAMS)
    assert made.count() == 0 and {"fold_id", "p_long"} <= set(made.columns)


def test_ablation_of_columns(rows):
    made = study.ablation(lambda columns: rows.agg(F.lit(len(columns)).alias("n")), ["x"], ["noise", "label"])
    assert {r["variant"]: r["n"] for r in made.collect()} == {"base": 1, "full": 3, "without noise": 2, "without label": 2}


def test_regression_and_saved_models(rows, tmp_path):
    target = rows.withColumn("target", 0.5 * F.col("x") + 0.001 * F.col("noise"))
    model = models.fit_return(target, ["x", "noise"], "target")
    versions = []
    for _ in range(2):
        versions.append(tables.save_model(model, str(tmp_path), versions))
    assert versions == ["v1", "v2"]
    made = tables.load_model(str(tmp_path), versions).transform(target)
    assert made.agg(F.max(F.abs(F.col("prediction") - F.col("target")))).first()[0] < 0.05


def test_z_scores_of_training_rows(rows):
    train = rows.where("bar_id < 300")
    made = models.standardised(rows, train, ["x"]).where("bar_id < 300").agg(F.avg("x"), F.stddev_pop("x")).first()
    assert made[0] == pytest.approx(0, abs=1e-9) and made[1] == pytest.approx(1)
