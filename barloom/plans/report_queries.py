"""Registered queries over the whole feature matrix, joint sweeps and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import indicators as I
from barloom.operators import backtest as X
from barloom.operators import sessions as S
from barloom.operators import study
from barloom.operators import tier1
from barloom.operators.labels import triple_barrier

from .bar_queries import _ema_sql, _rsi_sql, _std
from .base import BARS, LABEL_NUMBER, ORACLE_SQL, QUERIES, bars, labels_sql, predicted, query, r6
from .study_queries import _SESSIONS, _SIGNALS, _SWEEP, _paper, _signals, _trades, _trades_sql

_W = "OVER (PARTITION BY symbol ORDER BY bar_id)"
_PERIODS = (5, 10, 15, 20, 50)

_MATRIX = f"""WITH {BARS}, base AS (
  SELECT symbol, bar_id, bar_close_ts, round(ln(close / lag(close) {_W}), 6) AS ret_1,
         round(sin(2 * pi() * hour(bar_close_ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(bar_close_ts) / 24), 6) + 0.0 AS hour_cos,
         round(sin(2 * pi() * (isodow(bar_close_ts) - 1) / 7), 6) + 0.0 AS dow_sin, round(cos(2 * pi() * (isodow(bar_close_ts) - 1) / 7), 6) + 0.0 AS dow_cos,
         round((epoch_us(bar_close_ts) - epoch_us(bar_open_ts)) / 1e6, 6) AS bar_duration_sec, CAST(n_trades AS DOUBLE) AS n_trades, round(volume, 6) AS volume,
         CAST(0.02 AS DOUBLE) AS cusum_pos, CAST(0.0 AS DOUBLE) AS cusum_neg, {", ".join(map(_std, _PERIODS))} FROM bars
)
SELECT * FROM base JOIN ({ORACLE_SQL["w02_ema"]}) USING (symbol, bar_id) JOIN ({ORACLE_SQL["w03_macd"]}) USING (symbol, bar_id)
JOIN ({ORACLE_SQL["w07_stochastic"]}) USING (symbol, bar_id) JOIN ({ORACLE_SQL["w06_bollinger"]}) USING (symbol, bar_id) JOIN ({ORACLE_SQL["w10_money_flow"]}) USING (symbol, bar_id)
""" + "".join(f"JOIN (SELECT symbol, bar_id, rsi AS rsi_{n} FROM ({_rsi_sql(n)})) USING (symbol, bar_id)\n" for n in (6, 10, 14))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    made = bars(spark, d).withColumns({"cusum_pos": F.lit(0.02), "cusum_neg": F.lit(0.0)})
    return I.build_features(made)


@query(_MATRIX)
def w01_feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """All 33 features of every bar."""
    return _matrix(spark, d).select("symbol", "bar_id", "bar_close_ts", *r6(*I.FEATURES))


_EVENTS = f"""WITH {BARS}, l AS (SELECT symbol, bar_id, close, volume, {_ema_sql("close", 12)} - {_ema_sql("close", 26)} AS line, {_ema_sql("close", 50)} AS ema_50 FROM bars),
g AS (SELECT *, {_ema_sql("line", 9)} AS signal FROM l), r AS ({_rsi_sql(14)}),
s AS (SELECT g.*, r.rsi, sign(line - signal) AS side, row_number() OVER (PARTITION BY g.symbol ORDER BY g.bar_id) AS n FROM g JOIN r ON g.symbol = r.symbol AND g.bar_id = r.bar_id),
e AS (SELECT *, coalesce(rsi > 70, false) AS rsi_high, coalesce(rsi < 30, false) AS rsi_low, coalesce(side <> lag(side) {_W}, false) AS macd_cross,
  volume > 3 * median(volume) OVER (PARTITION BY symbol ORDER BY bar_id ROWS 49 PRECEDING) AS volume_spike, close > ema_50 AS above_ema, close < ema_50 AS below_ema FROM s)
SELECT symbol, bar_id, """ + ", ".join(
    f"n - max(CASE WHEN {e} THEN n END) OVER (PARTITION BY symbol ORDER BY bar_id ROWS UNBOUNDED PRECEDING) AS bars_since_{e}"
    for e in ("rsi_high", "rsi_low", "macd_cross", "volume_spike", "above_ema", "below_ema")
) + " FROM e"


@query(_EVENTS)
def w13_events(spark: SparkSession, d: str) -> DataFrame:
    """Bars since each of the six events."""
    made = tier1.since_events(I.with_recursive(bars(spark, d)))
    names = [c for c in made.columns if c.startswith("bars_since_")]
    return made.select("symbol", "bar_id", *[F.col(c).cast("bigint").alias(c) for c in names])


@query(f"""
WITH f AS ({_MATRIX}), u AS (SELECT name, value FROM (SELECT {", ".join(f"coalesce({c}, 'nan'::DOUBLE) AS {c}" for c in I.FEATURES)} FROM f) UNPIVOT (value FOR name IN ({", ".join(I.FEATURES)})))
SELECT name AS feature, min(value) FILTER (WHERE NOT isnan(value)) AS lowest, max(value) FILTER (WHERE NOT isnan(value)) AS highest, count(*) FILTER (WHERE isnan(value)) AS n_null,
       count(DISTINCT value) FILTER (WHERE NOT isnan(value)) <= 1 AS degenerate FROM u GROUP BY 1
""")
def e21_feature_checks(spark: SparkSession, d: str) -> DataFrame:
    """Range, missing values and degeneracy of every feature, in one wide aggregate."""
    return study.feature_checks(_matrix(spark, d).select(*r6(*I.FEATURES)), I.FEATURES)


_SOME = ("ret_1", "std_5", "cmf_21", "hour_sin")


@query(f"""
WITH f AS ({_MATRIX}), l AS (WITH {BARS}, {labels_sql("0.05", "0.05", 24)} SELECT symbol, bar_id, {LABEL_NUMBER} AS label FROM labels WHERE exit_reason IS NOT NULL)
SELECT symbol, bar_id, label, {", ".join(_SOME)} FROM f JOIN l USING (symbol, bar_id)
""")
def c01_features_labels(spark: SparkSession, d: str) -> DataFrame:
    """Features joined with the labels of labelled bars: what a model is trained on."""
    labels = triple_barrier(bars(spark, d), 0.05, 0.05, 24)
    return study.training_rows(_matrix(spark, d), labels).select("symbol", "bar_id", "label", *r6(*_SOME))


@query(f"""
WITH f AS ({_MATRIX}), t AS (WITH {_SIGNALS}, {_trades_sql()} SELECT symbol, bar_id, direction FROM trades)
SELECT symbol, bar_id, direction, {", ".join(_SOME)} FROM t LEFT JOIN f USING (symbol, bar_id)
""")
def c05_signals_features(spark: SparkSession, d: str) -> DataFrame:
    """Taken signals with the features of their bars, missing or not: what a meta-label model reads."""
    taken = _trades(spark, d).select("symbol", "bar_id", "direction")
    return taken.join(_matrix(spark, d), ["symbol", "bar_id"], "left").select("symbol", "bar_id", "direction", *r6(*_SOME))


def _sweep_sql(barrier: str) -> str:
    swept = _SWEEP.replace("(1 + 0.05)", f"(1 + {barrier})").replace("(1 - 0.05)", f"(1 - {barrier})")
    return f"""SELECT CAST({barrier} AS DOUBLE) AS barrier, * FROM ({swept} SELECT symbol, CAST(threshold AS DOUBLE) AS threshold, count(*) AS n_trades,
      round(100.0 * count(*) FILTER (WHERE gross > 11) / count(*), 6) AS win_pct, round(sum(gross - 11), 6) AS total_pnl FROM taken GROUP BY ALL)"""


@query(" UNION ALL ".join(map(_sweep_sql, ("0.03", "0.05"))))
def m16_joint_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Barriers by thresholds in one job: both are columns, and keys of the trades' selection."""
    grid = spark.createDataFrame([(b, t) for b in (0.03, 0.05) for t in (0.45, 0.5, 0.55, 0.6)], "barrier double, threshold double")
    return study.joint_sweep(predicted(bars(spark, d)), grid, 24, 11.0).select("barrier", "symbol", "threshold", "n_trades", *r6("win_pct", "total_pnl"))


_MAGNITUDES = (0.05, 0.1, 0.2)


@query(" UNION ALL ".join(f"""
SELECT CAST({m} AS DOUBLE) AS magnitude, * FROM (WITH {_SIGNALS}, certain AS (SELECT * REPLACE (CAST(p_long - 0.4 > {m} AS INT)::DOUBLE AS p_long, CAST(p_long - 0.4 < -{m} AS INT)::DOUBLE AS p_short) FROM joined),
{_trades_sql("0.5", "symbol", "certain")} SELECT symbol, count(*) AS n_trades, round(sum(pnl_bps_net), 6) AS total_pnl FROM trades GROUP BY symbol)""" for m in _MAGNITUDES))
def m18_magnitude_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A regression's predictions as signals, for several magnitudes in one job."""
    rows = _signals(spark, d).withColumn("predicted", F.col("p_long") - 0.4)
    sizes = spark.createDataFrame([(m,) for m in _MAGNITUDES], "magnitude double")
    return study.magnitude_sweep(rows, sizes, 11.0).select("magnitude", "symbol", "n_trades", *r6("total_pnl"))


@query(f"""
WITH {_SIGNALS}, {_trades_sql()}
SELECT symbol, bar_id, entry_ts, exit_ts, direction, round(p_long, 6) AS p_long, round(p_short, 6) AS p_short, round(p_neutral, 6) AS p_neutral, exit_reason,
       CAST(holding_bars AS BIGINT) AS holding_bars, round(pnl_bps_gross, 6) AS pnl_bps_gross, round(pnl_bps_net, 6) AS pnl_bps_net, CAST(pnl_bps_net > 0 AS INTEGER) AS win, label AS true_label FROM trades
""")
def m21_signal_extract(spark: SparkSession, d: str) -> DataFrame:
    """Taken signals with their outcome and true label, as meta-labelling reads them."""
    made = study.signal_extract(_trades(spark, d))
    return made.select(
        "symbol", "bar_id", "entry_ts", "exit_ts", "direction", *r6("p_long", "p_short", "p_neutral"), "exit_reason",
        F.col("holding_bars").cast("bigint").alias("holding_bars"), *r6("pnl_bps_gross", "pnl_bps_net"), "win", "true_label",
    )


@query(f"""
WITH {_SIGNALS}, {_trades_sql()}
SELECT symbol, CAST(week(entry_ts) AS INTEGER) AS fold_id, count(*) AS n_trades, count(*) FILTER (WHERE direction = 1) AS n_long, count(*) FILTER (WHERE direction = -1) AS n_short,
       round(100.0 * count(*) FILTER (WHERE direction = 1 AND pnl_bps_net > 0) / nullif(count(*) FILTER (WHERE direction = 1), 0), 6) AS long_win_pct,
       round(100.0 * count(*) FILTER (WHERE direction = -1 AND pnl_bps_net > 0) / nullif(count(*) FILTER (WHERE direction = -1), 0), 6) AS short_win_pct,
       round(avg(pnl_bps_net), 6) AS mean_pnl, round(median(pnl_bps_net), 6) AS median_pnl FROM trades GROUP BY ALL
""")
def e25_fold_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trade statistics per fold (here a week), long and short apart."""
    made = study.fold_trades(_trades(spark, d).withColumn("fold_id", F.weekofyear("entry_ts")), ["symbol", "fold_id"])
    return made.select("symbol", "fold_id", "n_trades", "n_long", "n_short", *r6("long_win_pct", "short_win_pct", "mean_pnl", "median_pnl"))


_FOLDED = f"""{_SESSIONS}, m AS (SELECT fold_id, count(*) AS n_trades, count(*) FILTER (WHERE pnl > 0) AS n_won, sum(pnl) AS total, avg(pnl) / stddev_samp(pnl) AS sharpe FROM trades WHERE status = 'exited' GROUP BY 1)"""


def _folded(spark: SparkSession, d: str) -> DataFrame:
    done = _paper(spark, d)[1].where("status = 'exited'")
    return done.groupBy("fold_id").agg(
        F.count(F.lit(1)).alias("n_trades"), F.count_if(F.col("pnl_bps") > 0).alias("n_won"), F.sum("pnl_bps").alias("total"),
        (F.avg("pnl_bps") / F.stddev_samp("pnl_bps")).alias("sharpe"),
    )


@query(f"""
WITH {_FOLDED}
SELECT round(sum(sharpe) / 18, 9) AS mean_sharpe, round(avg(sharpe) FILTER (WHERE n_trades > 0), 9) AS mean_active, round(avg(sharpe) FILTER (WHERE sharpe <> 0), 9) AS mean_nonzero,
       count(*) FILTER (WHERE n_trades > 0) AS n_active, CAST(sum(n_trades) AS BIGINT) AS n_trades, round(100.0 * sum(n_won) / sum(n_trades), 6) AS win_pct, CAST(sum(total) AS DOUBLE) AS total_pnl FROM m
""")
def e26_meta_report(spark: SparkSession, d: str) -> DataFrame:
    """Over folds, with the fixed denominator that published reports have."""
    made = study.meta_report(_folded(spark, d), 18)
    return made.withColumns({c: F.round(c, 9) for c in ("mean_sharpe", "mean_active", "mean_nonzero")}).withColumn("win_pct", F.round("win_pct", 6))


@query(f"""
WITH {_SESSIONS}, n AS (SELECT session_id, count(*) AS n_trades FROM trades GROUP BY 1)
SELECT session_id AS run_id, name, coalesce(n_trades, 0) AS n_trades FROM sessions LEFT JOIN n USING (session_id)
""")
def c12_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with the number of their trades, 0 where there are none."""
    sessions, trades = _paper(spark, d)
    return S.runs_with_counts(sessions.withColumnRenamed("session_id", "run_id"), trades.withColumnRenamed("session_id", "run_id"))


@query(f"""
WITH {_FOLDED}, e AS (SELECT CASE WHEN fold_id <= 6 THEN 'early' WHEN fold_id <= 14 THEN 'middle' ELSE 'late' END AS era, avg(sharpe) AS sharpe FROM m GROUP BY 1)
SELECT era, CASE WHEN sharpe > 0.05 THEN 'holds' WHEN sharpe > 0 THEN 'weak' ELSE 'fails' END AS verdict FROM e
""")
def m25_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A word on each era's mean Sharpe ratio."""
    per = _folded(spark, d).groupBy(S.era(F.col("fold_id")).alias("era")).agg(F.avg("sharpe").alias("sharpe"))
    return per.select("era", study.verdict(F.col("sharpe"), 0.05).alias("verdict"))
