"""Registered queries that fit models; SQL cannot, so tests compare the fits with loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import FoldParams
from barloom.functions import indicators as I
from barloom.operators import models, study
from barloom.operators.boosting import BoostParams
from barloom.operators.labels import triple_barrier
from barloom.operators.validation import data_range, folds

from .base import bars, days, query
from .report_queries import _matrix

#: Trees of the registered queries: fewer and smaller than the library's defaults.
TREES = BoostParams(rounds=12, patience=4, rate=0.2, leaves=8, depth=3, bins=32, min_rows=20)


@query()
def m05_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Chances of each labelled bar's three classes, by trees fitted to the first 80 % in time and stopped by the rest."""
    rows = study.training_rows(_matrix(spark, d), triple_barrier(bars(spark, d), 0.05, 0.05, 24))
    placed = models.time_split(rows, "bar_close_ts", "bar_id", 0.8)
    model = models.fit_classifier(placed.where("is_train"), I.FEATURES, kind="boosted", held=placed.where("NOT is_train"), boost=TREES)
    return models.predict(model, placed).select("symbol", "bar_id", "is_train", "label", *[F.round(c, 6).alias(c) for c in models.CLASSES])


@query()
def m20_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-time predictions of yearly folds over one bar per day, by a logistic regression with calibration."""
    day = F.col("d").cast("timestamp")
    made = days(spark, d).select(
        F.lit("D").alias("symbol"),
        F.datediff("d", F.lit("1970-01-01").cast("date")).cast("long").alias("bar_id"),
        day.alias("bar_open_ts"),
        (day + F.expr("interval 23 hours")).alias("bar_close_ts"),
        "open", "high", "low", "close", "volume", "n_trades",
        F.lit(0.0).alias("cusum_pos"),
        F.lit(0.0).alias("cusum_neg"),
    )
    rows = study.training_rows(I.build_features(made), triple_barrier(made, 0.05, 0.05, 24))
    p = FoldParams(train_months=24, val_months=6, oot_months=12, step_months=12)
    span = data_range(rows, "bar_close_ts").first()
    calendar = folds(spark, str(span["data_start"]), str(span["data_end"]), p)
    out = study.walk_forward(rows, calendar, ["ret_1", "rsi_14", "stoch_k", "williams_r", "mfi_14"], p, kind="logistic")
    return out.select("fold_id", "bar_id", "label", *[F.round(c, 6).alias(c) for c in models.CLASSES])
