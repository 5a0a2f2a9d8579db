"""The assembled feature matrices: the base one with the tier-1 columns, or with those of days, regimes and order flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.indicators import bar_order, build_features, with_decayed, with_recursive

from . import tier1
from .bars import seconds
from .orderflow import max_trade_share, order_flow, taker_ratio, trade_intensity

#: The columns that each matrix adds to the base one, in order; fixed values.
TIER1 = [
    "bars_since_rsi_high", "bars_since_rsi_low", "bars_since_macd_cross", "bars_since_volume_spike", "bars_since_above_ema", "bars_since_below_ema",
    "htf_4h", "htf_1d", "htf_5d", "atr", "atr_rank", "dist_pivot", "dist_r1", "dist_s1", "dist_fib",
]
V2 = [
    "daily_ret_pct", "weekly_range_pos", "regime_vol_ratio",
    "taker_buy_ratio", "taker_buy_ratio_ema5", "taker_buy_ratio_ema20", "max_trade_share", "trade_intensity",
]

_KEY = ["symbol", "bar_id"]


def _joined(bars: DataFrame, added: DataFrame, names: list[str]) -> DataFrame:
    own = added.select(*_KEY, *[F.col(n).cast("double").alias(n) for n in names])
    return build_features(bars).join(own, _KEY, "left")


def tier1_matrix(bars: DataFrame) -> DataFrame:
    """symbol, bar_id, bar_close_ts, the base features and the 15 of TIER1, all double; missing ones are null. A row for each bar."""
    made = tier1.since_events(with_recursive(bars))
    made = tier1.pivot_distances(tier1.atr_rank(tier1.higher_frames(made)))
    return _joined(bars, made, TIER1)


def v2_matrix(bars: DataFrame, ticks: DataFrame, peers: bool = False) -> DataFrame:
    """symbol, bar_id, bar_close_ts, the base features and the 8 of V2, all double. A row for each bar.

    Bars without ticks have null ratios, through which the exponential means decay; these need 5 and 20 ratios.
    peers: whether a bar's week has all bars that close with it; see tier1.week_position.
    """
    made = tier1.regime_ratio(tier1.week_position(tier1.day_return(bars), peers)).withColumn("_sec", seconds())
    made = made.withColumn("trade_intensity", trade_intensity(F.col("n_trades"), F.col("_sec"), bar_order()))
    flow = order_flow(ticks, bars).select(*_KEY, taker_ratio().alias("taker_buy_ratio"), max_trade_share().alias("max_trade_share"))
    made = made.join(flow, _KEY, "left")
    made = with_decayed(made, "taker_buy_ratio", {"taker_buy_ratio_ema5": (5, 5), "taker_buy_ratio_ema20": (20, 20)})
    return _joined(bars, made, V2)
