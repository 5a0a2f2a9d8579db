"""What the dashboard asks of sessions, trades, decisions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.scan import running


def session_overview(sessions: DataFrame, trades: DataFrame) -> DataFrame:
    """Every session with counts and results of its trades; 0 where it has none."""
    done = F.col("status") == "exited"
    won = done & (F.col("pnl_bps") > 0)
    per = trades.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(F.col("status") == "open").alias("n_open"),
        F.count_if(won).alias("n_winners"),
        F.sum(F.when(done, F.col("pnl_bps"))).alias("total_pnl_bps"),
        F.avg(F.when(done, F.col("pnl_bps"))).alias("mean_pnl_bps"),
    )
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n_trades", "n_open", "n_winners")}
    zero |= {c: F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total_pnl_bps", "mean_pnl_bps")}
    return sessions.join(per, "session_id", "left").select(*sessions.columns, *zero.values())


def runs_with_counts(runs: DataFrame, trades: DataFrame, key: str = "run_id") -> DataFrame:
    """Every run with n_trades, 0 where it has none."""
    counts = trades.groupBy(key).agg(F.count(F.lit(1)).alias("n_trades"))
    return runs.join(counts, key, "left").select(*runs.columns, F.coalesce("n_trades", F.lit(0)).alias("n_trades"))


def where_all(*conditions: tuple[str, object | None]) -> Column:
    """AND of column = value; a value of None or "all" asks nothing."""
    out = F.lit(True)
    for name, value in conditions:
        if value is not None and value != "all":
            out = out & (F.col(name) == F.lit(value))
    return out


def running_pnl(trades: DataFrame, *keys: str) -> DataFrame:
    """Sum of PnL up to each exit; exits at the same time share it."""
    return running(trades, keys, [F.col("exit_ts")], {"cum_pnl_bps": ("sum", F.col("pnl_bps"))}, peers=True, bucket=F.to_date("exit_ts"))


def newest_first(rows: DataFrame, ts: str, tie: str, n: int) -> DataFrame:
    return rows.orderBy(F.col(ts).desc_nulls_last(), F.col(tie).desc()).limit(n)


def fold_summary(trades: DataFrame) -> DataFrame:
    return trades.groupBy("fold_id").agg(
        F.count(F.lit(1)).alias("n_trades"),
        (100.0 * F.count_if(F.col("pnl_bps") > 0) / F.count(F.lit(1))).alias("win_pct"),
        F.avg("pnl_bps").alias("mean_pnl_bps"),
        F.sum("pnl_bps").alias("total_pnl_bps"),
        F.min("entry_ts").alias("first_entry"),
        F.max("exit_ts").alias("last_exit"),
    )


def era(fold_id: Column) -> Column:
    """Folds 1-6, 7-14 and 15-20."""
    return F.when(fold_id <= 6, "early").when(fold_id <= 14, "middle").when(fold_id <= 20, "late")


def across_folds(metrics: DataFrame, *keys: str) -> DataFrame:
    """Mean and sample deviation of the Sharpe ratio over folds (0 for one fold), over active folds, and counts."""
    active = F.col("n_trades") > 0
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.count_if(active).alias("n_active"),
        F.avg("sharpe").alias("mean_sharpe"),
        F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("std_sharpe"),
        F.coalesce(F.avg(F.when(F.col("sharpe") != 0, F.col("sharpe"))), F.lit(0.0)).alias("mean_nonzero_sharpe"),
        F.sum("n_trades").alias("n_trades"),
    )
