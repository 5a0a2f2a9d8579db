"""Registered queries over the assembled feature matrices, and the decayed means that one of them has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import indicators as I
from barloom.operators import matrices as M
from barloom.operators.orderflow import order_flow, taker_ratio

from .base import ORACLE_SQL, bars, query, r6, ticks
from .report_queries import _MATRIX
from .tape_queries import _FLOW


def _sql(name: str) -> str:
    return f"({ORACLE_SQL[name]})"


def _decayed(name: str, source: str, span: int) -> str:
    """CTEs that walk the rows of `source` (symbol, k, x) one by one; `name` has the mean m and the number of values seen."""
    rest, alpha = f"w.wt * {1 - 2 / (span + 1)!r}", f"{2 / (span + 1)!r}"
    return f"""{name} AS (
  SELECT symbol, k, x AS m, CAST(1 AS DOUBLE) AS wt, CASE WHEN x IS NULL THEN 0 ELSE 1 END AS seen FROM {source} WHERE k = 1
  UNION ALL
  SELECT v.symbol, v.k, CASE WHEN w.m IS NULL THEN v.x WHEN v.x IS NULL THEN w.m ELSE ({rest} * w.m + {alpha} * v.x) / ({rest} + {alpha}) END,
         CASE WHEN w.m IS NOT NULL AND v.x IS NULL THEN {rest} ELSE 1 END, w.seen + CASE WHEN v.x IS NULL THEN 0 ELSE 1 END
  FROM {name} w JOIN {source} v ON v.symbol = w.symbol AND v.k = w.k + 1
)"""


#: Ratios that are not rounded, for what goes on computing with them.
_RATIO = f"""(WITH {_FLOW}, f AS (SELECT symbol, bar_id, sum(qty) FILTER (WHERE NOT is_buyer_maker) AS buy, sum(qty) AS total FROM assigned GROUP BY ALL)
SELECT b.symbol, b.bar_id, coalesce(f.buy, 0) / f.total AS taker_ratio FROM bars b LEFT JOIN f USING (symbol, bar_id))"""

_RATIOS = f"""v AS (
  SELECT symbol, bar_id, row_number() OVER (PARTITION BY symbol ORDER BY bar_id) AS k, CASE WHEN bar_id % 7 <> 3 THEN taker_ratio END AS x FROM {_RATIO}
)"""


@query(f"""
WITH RECURSIVE {_RATIOS}, {_decayed("short", "v", 5)}, {_decayed("long", "v", 20)}
SELECT v.symbol, v.bar_id, round(CASE WHEN s.seen >= 5 THEN s.m END, 6) AS ema5, round(CASE WHEN l.seen >= 20 THEN l.m END, 6) AS ema20
FROM v JOIN short s USING (symbol, k) JOIN long l USING (symbol, k)
""")
def w19_decayed_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Exponential means of the taker ratio, of which every seventh is missing."""
    made = bars(spark, d)
    flow = order_flow(ticks(spark, d), made).select("symbol", "bar_id", taker_ratio().alias("ratio"))
    rows = made.select("symbol", "bar_id", "bar_close_ts").join(flow, ["symbol", "bar_id"], "left")
    rows = rows.withColumn("ratio", F.when(F.col("bar_id") % 7 != 3, F.col("ratio")))
    return I.with_decayed(rows, "ratio", {"ema5": (5, 5), "ema20": (20, 20)}).select("symbol", "bar_id", *r6("ema5", "ema20"))


#: Columns whose own queries, on which the matrices' SQL stands, round to nine digits first.
_NINE = ["htf_4h", "htf_1d", "htf_5d", "atr_rank", "dist_pivot", "dist_fib", "daily_ret_pct", "weekly_range_pos", "max_trade_share"]


def _rounded(name: str) -> Column:
    column = F.round(name, 9) if name in _NINE else F.col(name)
    return F.round(column, 6).alias(name)


_T1 = [c for c in M.TIER1 if c not in ("dist_r1", "dist_s1")]


@query(f"""
SELECT m.*, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _T1 if c.startswith("bars_since"))}, round(htf_4h, 6) AS htf_4h, round(htf_1d, 6) AS htf_1d, round(htf_5d, 6) AS htf_5d,
       atr, round(atr_rank, 6) AS atr_rank, round(dist_pivot, 6) AS dist_pivot, round(dist_fib, 6) AS dist_fib
FROM ({_MATRIX}) m LEFT JOIN {_sql("w13_events")} USING (symbol, bar_id) LEFT JOIN {_sql("c06_higher_frames")} USING (symbol, bar_id)
LEFT JOIN {_sql("w16_atr_rank")} USING (symbol, bar_id) LEFT JOIN {_sql("w17_pivot_distances")} USING (symbol, bar_id)
""")
def c03_tier1_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The base features of every bar with the tier-1 columns."""
    made = bars(spark, d).withColumns({"cusum_pos": F.lit(0.02), "cusum_neg": F.lit(0.0)})
    return M.tier1_matrix(made).select("symbol", "bar_id", "bar_close_ts", *map(_rounded, [*I.FEATURES, *_T1]))


@query(f"""
WITH RECURSIVE v AS (SELECT symbol, bar_id, row_number() OVER (PARTITION BY symbol ORDER BY bar_id) AS k, taker_ratio AS x FROM {_RATIO}),
{_decayed("short", "v", 5)}, {_decayed("long", "v", 20)}
SELECT m.*, round(daily_ret_pct, 6) AS daily_ret_pct, round(weekly_range_pos, 6) AS weekly_range_pos, regime_vol_ratio, round(v.x, 6) AS taker_buy_ratio,
       round(CASE WHEN s.seen >= 5 THEN s.m END, 6) AS taker_buy_ratio_ema5, round(CASE WHEN l.seen >= 20 THEN l.m END, 6) AS taker_buy_ratio_ema20,
       round(max_trade_share, 6) AS max_trade_share, trade_intensity
FROM ({_MATRIX}) m LEFT JOIN {_sql("w22_day_return")} USING (symbol, bar_id) LEFT JOIN {_sql("w23_week_position")} USING (symbol, bar_id)
LEFT JOIN {_sql("w24_regime_ratio")} USING (symbol, bar_id) LEFT JOIN {_sql("c04_flow_ratios")} USING (symbol, bar_id)
LEFT JOIN {_sql("w21_trade_intensity")} USING (symbol, bar_id) LEFT JOIN v USING (symbol, bar_id) LEFT JOIN short s USING (symbol, k) LEFT JOIN long l USING (symbol, k)
""")
def c03_v2_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The base features of every bar with those of days, regimes and order flow."""
    made = bars(spark, d).withColumns({"cusum_pos": F.lit(0.02), "cusum_neg": F.lit(0.0)})
    return M.v2_matrix(made, ticks(spark, d), peers=True).select("symbol", "bar_id", "bar_close_ts", *map(_rounded, [*I.FEATURES, *M.V2]))
