"""Signals, non-overlapping trades, equity and risk metrics, for all parameters of a sweep at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.streams import runs, streamed
from barloom.operators.scan import running
from barloom.sources.scratch import written


#: Rows of an equity curve that one task runs through.
_CURVE_ROWS = 100_000


def signal(threshold: Column) -> Column:
    """Backtest rule: 1 if p_long is above the threshold, else -1 if p_short is, else 0."""
    return F.when(F.col("p_long") > threshold, 1).when(F.col("p_short") > threshold, -1).otherwise(0)


def live_decision(threshold: Column) -> tuple[Column, Column]:
    """Live rule and its reason: the likeliest class, if it is at least the threshold and not neutral."""
    best = F.greatest("p_long", "p_short", "p_neutral")
    verdict = (
        F.when(best < threshold, "skip")
        .when((F.col("p_long") < best) & (F.col("p_short") < best), "skip")
        .when(F.col("p_long") == best, "long")
        .otherwise("short")
    )
    reason = (
        F.when(best < threshold, F.format_string("max prob %.3f below %.2f", best, threshold))
        .when((F.col("p_long") < best) & (F.col("p_short") < best), "neutral")
        .otherwise(F.format_string("prob %.3f", best))
    )
    return verdict, reason


def pseudo_probabilities(predicted: Column, magnitude: Column) -> dict[str, Column]:
    """A regression's prediction as certainties: beyond +-magnitude long or short."""
    long_, short = (predicted > magnitude).cast("double"), (predicted < -magnitude).cast("double")
    return {"p_long": long_, "p_short": short, "p_neutral": 1.0 - long_ - short}


def select_trades(signals: DataFrame, keys: Sequence[str], max_concurrent: int = 1) -> DataFrame:
    """The signals that find a free slot, in order of entry.

    signals: rows with the keys, entry_ts, bar_id, exit_ts. A position frees its
    slot at the entry that is not before its exit. Each key (symbol, fold,
    parameters) streams through one task, batch by batch: memory is one batch
    and the open exits, however many signals there are.
    """
    keys = list(keys)
    first = ["entry_ts", "bar_id", "exit_ts"]
    columns = [*keys, *first, *[c for c in signals.columns if c not in keys and c not in first]]
    rows = streamed(signals.select(*columns), keys, [F.col(c) for c in columns[len(keys) :]])

    def walk(batches):
        key, open_ = None, []
        for batch in batches:
            entries, exits = (_comparable(batch.column(c)) for c in ("entry_ts", "exit_ts"))
            taken = []
            for own, begin, end in runs(batch, keys):
                if own != key:
                    key, open_ = own, []
                for i in range(begin, end):
                    entry = entries[i]
                    open_ = [t for t in open_ if t is not None and entry is not None and t > entry]
                    if len(open_) < max_concurrent:
                        open_.append(exits[i])
                        taken.append(i)
            if taken:
                yield batch.take(pa.array(taken, pa.int64()))

    return rows.mapInArrow(walk, rows.schema)


def _comparable(times: pa.Array) -> list:
    return (times.cast(pa.int64()) if pa.types.is_timestamp(times.type) else times).to_pylist()


def with_pnl(trades: DataFrame, cost_bps: Column) -> DataFrame:
    gross = F.col("direction") * (F.col("exit_price") / F.col("entry_price") - 1) * 10_000.0
    return trades.withColumn("pnl_bps_gross", gross).withColumn("pnl_bps_net", gross - cost_bps)


def _ln(x: Column) -> Column:
    """The logarithm, of zero minus infinity and of less nan, where Spark has null: a loss of all or more must not drop out of a sum."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan))


def _over(a: Column, b: Column) -> Column:
    """a over b, where b may be 0: infinite, or nan for nothing over nothing."""
    rest = F.when(F.isnan(a) | (a == 0), math.nan).when(a > 0, math.inf).when(a < 0, -math.inf)
    return F.when(b != 0, a / b).when(b == 0, rest)


def equity_curve(trades: DataFrame, keys: Sequence[str], start: float = 10_000.0) -> DataFrame:
    """keys, ts, n, equity: the start at the entry of the trade that exits first, then compounded after each exit.

    A trade that loses all that there is makes the equity 0 from there on; one that loses more (a short whose price has more than doubled)
    makes it nan, and with it what is reckoned from it.
    """
    order = [F.col("exit_ts"), F.col("bar_id")]
    sums = {"n": ("sum", F.lit(1)), "growth": ("sum", _ln(1 + F.col("pnl_bps_net") / 10_000.0))}
    grown = running(trades.select(*keys, "exit_ts", "bar_id", "pnl_bps_net"), list(keys), order, sums, bucket=F.to_date("exit_ts"))
    grown = grown.select(*keys, F.col("exit_ts").alias("ts"), F.col("n").cast("int").alias("n"), (start * F.exp("growth")).alias("equity"))
    first = trades.groupBy(*keys).agg(F.min_by("entry_ts", F.struct("exit_ts", "bar_id")).alias("ts"))
    return grown.unionByName(first.select(*keys, "ts", F.lit(0).alias("n"), F.lit(start).alias("equity")))


def drawdown(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """curve with `drawdown`: how far the equity is below its highest value so far."""
    made = running(curve, list(keys), [F.col("n")], {"drawdown": ("max", F.col("equity"))}, bucket=F.floor(F.col("n") / _CURVE_ROWS))
    return made.withColumn("drawdown", F.col("equity") / F.col("drawdown") - 1)


def daily_returns(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, day, ret: log returns of the equity at the ends of all calendar days between the first and the last."""
    last = curve.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.max_by("equity", F.struct("ts", "n")).alias("equity"))
    span = last.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    w = Window.partitionBy(*keys).orderBy("day")
    filled = days.join(last, [*keys, "day"], "left").withColumn(
        "equity", F.last("equity", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return filled.withColumn("ret", _ln(_over(F.col("equity"), F.lag("equity").over(w)))).where("ret IS NOT NULL").select(*keys, "day", "ret")


def metrics(trades: DataFrame, keys: Sequence[str], n_bars: DataFrame | None = None, start: float = 10_000.0) -> DataFrame:
    """Per key: Sharpe, Sortino, maximal drawdown, time in market, trades, winners' share, annual return.

    n_bars: (keys.., n_bars) of the period; without it the time in market is null.
    Ratios over fewer than two days, or without variation, are 0. Log returns
    are compounded as they are, and a year has 252 days, as published figures have it; a day with one below -1 makes the annual return nan.
    """
    keys = list(keys)
    # read three times below: trades are few, what they are made of is not
    trades = written(trades, "trades")
    curve = written(drawdown(equity_curve(trades, keys, start), keys), "curve")
    falls = curve.groupBy(*keys).agg(F.min("drawdown").alias("max_dd"))
    r, neg = F.col("ret"), F.when(F.col("ret") < 0, F.col("ret"))
    year = math.sqrt(252)
    per_day = daily_returns(curve, keys).groupBy(*keys).agg(
        F.coalesce(F.when(F.stddev_samp(r) > 0, F.avg(r) / F.stddev_samp(r) * year), F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.when(F.stddev_samp(neg) > 0, F.avg(r) / F.stddev_samp(neg) * year), F.lit(0.0)).alias("sortino"),
        (F.pow(F.exp(F.sum(_ln(1 + r))), 252.0 / F.count(r)) - 1).alias("annual_return"),
    )
    counts = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        (100.0 * F.count_if(F.col("pnl_bps_net") > 0) / F.count(F.lit(1))).alias("win_pct"),
        F.sum("holding_bars").alias("held"),
    )
    out = counts.join(per_day, keys, "left").join(falls, keys, "left")
    share = F.lit(None).cast("double")
    if n_bars is not None:
        out = out.join(n_bars, keys, "left")
        share = 100.0 * F.col("held") / F.greatest(F.col("n_bars"), F.lit(1))
    zero = F.lit(0.0)
    return out.select(
        *keys,
        "n_trades",
        "win_pct",
        share.alias("pct_time_in_market"),
        F.coalesce("sharpe", zero).alias("sharpe"),
        F.coalesce("sortino", zero).alias("sortino"),
        F.coalesce("max_dd", zero).alias("max_dd"),
        F.coalesce("annual_return", zero).alias("annual_return"),
    )
