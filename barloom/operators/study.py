"""Studies: training rows, walk-forward runs, joint sweeps, ablations and reports on them."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import BacktestParams, FoldParams
from barloom.sources.scratch import written
from barloom.sources.tables import next_version

from . import backtest as X
from . import models
from .boosting import Boosted, BoostParams
from .labels import triple_barrier
from .validation import split, usable_folds


def training_rows(features: DataFrame, labels: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Features of labelled bars with what the label says."""
    wanted = ["label", "exit_bar_id", "exit_ts", "exit_reason", "holding_bars", "exit_price"]
    own = labels.where(F.col("label") != -1).select(*keys, "bar_id", *wanted, F.col("close").alias("entry_price"))
    return features.join(own, [*keys, "bar_id"])


def feature_checks(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, lowest, highest, n_null, degenerate: one wide aggregate over all rows, then a row per feature."""
    wide = rows.agg(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.min(f).alias("lowest"),
                F.max(f).alias("highest"),
                F.count_if(F.col(f).isNull()).alias("n_null"),
                # degenerate: one value or none
                (F.coalesce(F.min(f) == F.max(f), F.lit(True))).alias("degenerate"),
            ).alias(f"of_{f}")
            for f in features
        ]
    )
    return wide.select(F.explode(F.array(*[f"of_{f}" for f in features])).alias("x")).select("x.*")


def _reported(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    net = F.col("pnl_bps_net")
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), (100.0 * F.count_if(net > 0) / F.count(F.lit(1))).alias("win_pct"), F.sum(net).alias("total_pnl")
    )


def joint_sweep(bars: DataFrame, grid: DataFrame, vertical: int, cost_bps: float) -> DataFrame:
    """Per symbol and (barrier, threshold) of a grid: trades of bars that have probabilities. Labels are made once for each barrier."""
    barriers = grid.select("barrier").distinct()
    labelled = triple_barrier(bars.join(F.broadcast(barriers), F.lit(True)), F.col("barrier"), F.col("barrier"), vertical, ("symbol", "barrier"))
    signals = labelled.where("label <> -1").withColumnsRenamed({"bar_close_ts": "entry_ts", "close": "entry_price"}).join(F.broadcast(grid), "barrier")
    signals = signals.withColumn("direction", X.signal(F.col("threshold"))).where("direction <> 0")
    columns = ["symbol", "barrier", "threshold", "bar_id", "entry_ts", "exit_ts", "entry_price", "exit_price", "direction"]
    taken = X.select_trades(signals.select(*columns), ["symbol", "barrier", "threshold"])
    return _reported(X.with_pnl(taken, F.lit(cost_bps)), ["symbol", "barrier", "threshold"])


def magnitude_sweep(rows: DataFrame, magnitudes: DataFrame, cost_bps: float) -> DataFrame:
    """Per symbol and magnitude: trades of rows with predicted returns beyond it."""
    made = rows.join(F.broadcast(magnitudes), F.lit(True))
    made = made.withColumns(X.pseudo_probabilities(F.col("predicted"), F.col("magnitude")))
    made = made.withColumn("direction", X.signal(F.lit(0.5))).where("direction <> 0")
    return _reported(X.with_pnl(X.select_trades(made, ["symbol", "magnitude"]), F.lit(cost_bps)), ["symbol", "magnitude"])


def signal_extract(trades: DataFrame) -> DataFrame:
    """Trades with win (1 if it paid after costs) and the label as it was."""
    return trades.withColumn("win", (F.col("pnl_bps_net") > 0).cast("int")).withColumnRenamed("label", "true_label")


def fold_trades(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per fold: counts, winners' shares of longs and of shorts (null without any), mean and median result."""
    net, side = F.col("pnl_bps_net"), F.col("direction")

    def share(of: int) -> Column:
        return 100.0 * F.try_divide(F.count_if((side == of) & (net > 0)), F.count_if(side == of))

    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(side == 1).alias("n_long"),
        F.count_if(side == -1).alias("n_short"),
        share(1).alias("long_win_pct"),
        share(-1).alias("short_win_pct"),
        F.avg(net).alias("mean_pnl"),
        F.median(net).alias("median_pnl"),
    )


def meta_report(per_fold: DataFrame, n_folds: int | None = None) -> DataFrame:
    """Of (fold_id, n_trades, n_won, total, sharpe): one row over all folds. n_folds: the mean's denominator; default those there are."""
    count = F.lit(n_folds) if n_folds else F.count(F.lit(1))
    return per_fold.agg(
        (F.sum("sharpe") / count).alias("mean_sharpe"),
        F.avg(F.when(F.col("n_trades") > 0, F.col("sharpe"))).alias("mean_active"),
        F.avg(F.when(F.col("sharpe") != 0, F.col("sharpe"))).alias("mean_nonzero"),
        F.count_if(F.col("n_trades") > 0).alias("n_active"),
        F.sum("n_trades").alias("n_trades"),
        (100.0 * F.sum("n_won") / F.sum("n_trades")).alias("win_pct"),
        F.sum("total").alias("total_pnl"),
    )


def verdict(sharpe: Column, needed: float) -> Column:
    return F.when(sharpe > needed, "holds").when(sharpe > 0, "weak").otherwise("fails")


def walk_forward(
    rows: DataFrame,
    folds: DataFrame,
    features: Sequence[str],
    p: FoldParams = FoldParams(),
    kind: str = "forest",
    first_n: int | None = None,
    boost: BoostParams = BoostParams(),
) -> DataFrame:
    """Out-of-time predictions of every usable fold: the rows with fold_id and calibrated p_long, p_short, p_neutral.

    rows: training_rows. A fold's model learns from its purged training part (boosted ones stop by its validation part), its
    calibration from its validation part, and what follows the embargo is predicted. Only the fits are a loop, over a calendar of some folds; predictions stay tables.
    """
    placed = written(split(rows, folds, "bar_close_ts", "bar_id", p), "walk-forward")
    usable = [r["fold_id"] for r in usable_folds(placed, p.min_rows).orderBy("fold_id").collect()]
    out = None
    for fold in usable[:first_n]:
        own = placed.where(F.col("fold_id") == fold)
        model = models.fit_classifier(own.where("role = 'train'"), features, kind=kind, held=own.where("role = 'val'"), boost=boost)
        platt = models.fit_platt(models.predict(model, own.where("role = 'val'")))
        made = models.apply_platt(models.predict(model, own.where("role = 'oot'")), platt).drop("role")
        out = made if out is None else out.unionByName(made)
    return out if out is not None else placed.limit(0).drop("role").withColumns({c: F.lit(None).cast("double") for c in models.CLASSES})


def train_and_save(
    rows: DataFrame, features: Sequence[str], folder: str, versions: list[str], share: float = 0.8, boost: BoostParams = BoostParams()
) -> dict:
    """Fits boosted trees on the first `share` of the labelled rows in time, calibrates on the rest, and saves both as the next version.

    Returns the version, the rows on both sides, the rounds kept, the rest's log-loss, and the ten most important features. A failed step
    leaves no version that load_trained() would take: the calibration, which is written last, makes it one.
    """
    placed = written(models.time_split(rows.where(F.col("label") != -1), "bar_close_ts", "bar_id", share, keys=()), "train-and-save")
    train, held = placed.where("is_train"), placed.where("NOT is_train")
    model = models.fit_classifier(train, features, kind="boosted", held=held, boost=boost)
    platt = models.fit_platt(models.predict(model, held))
    name, spark = next_version(versions), rows.sparkSession
    model.save(spark, f"{folder}/{name}/model")
    spark.createDataFrame([(json.dumps(platt),)], "platt string").coalesce(1).write.text(f"{folder}/{name}/calibration")
    return {
        "version": name,
        "n_train": train.count(),
        "n_held": held.count(),
        "rounds": len(model.trees),
        "loss": model.losses[len(model.trees)] if model.losses else None,
        "top": model.importance(10),
    }


def load_trained(spark: SparkSession, folder: str, name: str) -> Callable[[DataFrame], DataFrame]:
    """What train_and_save() saved, as a function from rows to rows with calibrated probabilities."""
    platt = {c: ab and tuple(ab) for c, ab in json.loads(spark.read.text(f"{folder}/{name}/calibration").first()[0]).items()}
    model = Boosted.load(spark, f"{folder}/{name}/model")
    return lambda rows: models.apply_platt(models.predict(model, rows), platt)


def backtested(predictions: DataFrame, p: BacktestParams = BacktestParams(), keys: Sequence[str] = ("symbol", "fold_id")) -> DataFrame:
    """Trades of walk_forward's predictions, each fold for itself."""
    made = predictions.withColumn("direction", X.signal(F.lit(p.threshold))).where("direction <> 0").withColumnRenamed("bar_close_ts", "entry_ts")
    columns = [*keys, "bar_id", "entry_ts", "exit_ts", "entry_price", "exit_price", "exit_reason", "holding_bars", "direction", "label", *models.CLASSES]
    return X.with_pnl(X.select_trades(made.select(*columns), list(keys), p.max_concurrent), F.lit(p.cost_bps))


def ablation(run: Callable[[list[str]], DataFrame], base: Sequence[str], added: Sequence[str]) -> DataFrame:
    """run's one-row report for the base features, with all added ones, and with each of these left out: with `variant`."""
    variants = {"base": list(base), "full": [*base, *added]} | {f"without {a}": [*base, *(x for x in added if x != a)] for a in added}
    out = None
    for name, columns in variants.items():
        made = run(columns).withColumn("variant", F.lit(name))
        out = made if out is None else out.unionByName(made)
    return out
