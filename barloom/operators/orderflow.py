"""Order flow per bar, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import assign_to_bars


def order_flow(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, bar_id, taker volumes, largest trade and count of the ticks of each bar that has some."""
    maker, qty = F.col("is_buyer_maker"), F.col("qty")
    return assign_to_bars(ticks, bars).groupBy("symbol", "bar_id").agg(
        F.sum(F.when(~maker, qty).otherwise(0.0)).alias("taker_buy_vol"),
        F.sum(F.when(maker, qty).otherwise(0.0)).alias("taker_sell_vol"),
        F.sum(qty).alias("total_vol"),
        F.max(qty).alias("max_trade"),
        F.count(F.lit(1)).alias("n_ticks"),
    )


def taker_ratio() -> Column:
    return F.try_divide("taker_buy_vol", "total_vol")


def max_trade_share() -> Column:
    return F.try_divide("max_trade", "total_vol")


def trade_intensity(n_trades: Column, seconds: Column, order: Window, span: int = 50) -> Column:
    """Trades per second over its trailing median; 1 while that is missing or not positive."""
    rate = F.when(seconds > 0, n_trades / seconds).otherwise(0.0)
    frame = order.rowsBetween(-(span - 1), 0)
    median = F.when(F.count(rate).over(frame) == span, F.percentile(rate, 0.5).over(frame))
    return F.when(median > 0, rate / median).otherwise(1.0)
