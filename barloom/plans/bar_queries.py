"""Registered queries over bars: indicators, events, higher time frames, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import indicators as I
from barloom.operators import labels as L
from barloom.operators import tier1
from barloom.operators.orderflow import trade_intensity
from barloom.operators.validation import entropy

from .base import BARS, LABEL_NUMBER, bars, labels_sql, query, r6

def W() -> Window:
    return I.bar_order()


def _std(n: int) -> str:
    frame = f"(PARTITION BY symbol ORDER BY bar_id ROWS {n - 1} PRECEDING)"
    return f"round(CASE WHEN count(close) OVER {frame} = {n} THEN stddev_samp(close) OVER {frame} END, 6) AS std_{n}"


@query(f"WITH {BARS} SELECT symbol, bar_id, {', '.join(map(_std, (5, 10, 50)))} FROM bars")
def w05_rolling_std(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("close")
    return bars(spark, d).select("symbol", "bar_id", *[F.round(I.rolling(F.stddev_samp, c, W(), n), 6).alias(f"std_{n}") for n in (5, 10, 50)])


@query(f"""
WITH {BARS}, f AS (SELECT *, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s, count(*) OVER w AS k FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_id ROWS 4 PRECEDING))
SELECT symbol, bar_id, CASE WHEN k = 5 THEN round(m + 2 * s, 6) END AS bb_upper, CASE WHEN k = 5 THEN round(m - 2 * s, 6) END AS bb_lower FROM f
""")
def w06_bollinger(spark: SparkSession, d: str) -> DataFrame:
    upper, lower = I.bollinger(F.col("close"), W())
    return bars(spark, d).select("symbol", "bar_id", F.round(upper, 6).alias("bb_upper"), F.round(lower, 6).alias("bb_lower"))


def _ema_sql(x: str, n: int, order: str = "bar_id") -> str:
    a = 2 / (n + 1)
    return f"list_reduce(list({x}) OVER (PARTITION BY symbol ORDER BY {order} ROWS UNBOUNDED PRECEDING), lambda y, v: y * {1 - a!r} + v * {a!r})"


@query(f"WITH {BARS} SELECT symbol, bar_id, {', '.join(f'round({_ema_sql("close", n)}, 6) AS ema_{n}' for n in (5, 10, 15, 20, 50))} FROM bars")
def w02_ema(spark: SparkSession, d: str) -> DataFrame:
    return I.with_recursive(bars(spark, d)).select("symbol", "bar_id", *r6(*[f"ema_{n}" for n in (5, 10, 15, 20, 50)]))


@query(f"""
WITH {BARS}, l AS (SELECT symbol, bar_id, {_ema_sql("close", 12)} - {_ema_sql("close", 26)} AS line FROM bars), g AS (SELECT *, {_ema_sql("line", 9)} AS signal FROM l)
SELECT symbol, bar_id, round(line, 6) AS macd_line, round(signal, 6) AS macd_signal, round(line - signal, 6) AS macd_hist FROM g
""")
def w03_macd(spark: SparkSession, d: str) -> DataFrame:
    return I.with_recursive(bars(spark, d)).select("symbol", "bar_id", *r6("macd_line", "macd_signal", "macd_hist"))


def _rsi_sql(n: int) -> str:
    frame = "OVER (PARTITION BY symbol ORDER BY bar_id ROWS UNBOUNDED PRECEDING)"
    fold = f"list_reduce(list_concat([list_avg(%s[1:{n}])], %s[{n + 1}:]), lambda y, v: (y * {n - 1} + v) / {n})"
    return f"""
WITH {BARS}, m AS (SELECT symbol, bar_id, close - lag(close) OVER (PARTITION BY symbol ORDER BY bar_id) AS mv FROM bars),
g AS (SELECT symbol, bar_id, list(greatest(mv, 0)) FILTER (WHERE mv IS NOT NULL) {frame} AS gains, list(greatest(-mv, 0)) FILTER (WHERE mv IS NOT NULL) {frame} AS losses FROM m),
s AS (SELECT symbol, bar_id, CASE WHEN len(gains) >= {n} THEN {fold % ("gains", "gains")} END AS up, CASE WHEN len(losses) >= {n} THEN {fold % ("losses", "losses")} END AS down FROM g)
SELECT symbol, bar_id, round(CASE WHEN down > 0 THEN 100 - 100 / (1 + up / down) WHEN up > 0 THEN 100 END, 6) AS rsi FROM s"""


@query(_rsi_sql(14))
def w04_rsi(spark: SparkSession, d: str) -> DataFrame:
    return I.with_recursive(bars(spark, d)).select("symbol", "bar_id", F.round("rsi_14", 6).alias("rsi"))


@query(f"""
WITH {BARS}, a AS (SELECT *, CASE WHEN count(*) OVER w = 14 THEN 100 * (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w) END AS raw,
  CASE WHEN count(*) OVER w = 14 THEN -100 * (max(high) OVER w - close) / (max(high) OVER w - min(low) OVER w) END AS williams
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_id ROWS 13 PRECEDING)),
b AS (SELECT *, CASE WHEN count(raw) OVER w = 3 THEN avg(raw) OVER w END AS k FROM a WINDOW w AS (PARTITION BY symbol ORDER BY bar_id ROWS 2 PRECEDING))
SELECT symbol, bar_id, round(k, 6) AS stoch_k, round(CASE WHEN count(k) OVER w = 3 THEN avg(k) OVER w END, 6) AS stoch_d, round(williams, 6) AS williams_r
FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_id ROWS 2 PRECEDING)
""")
def w07_stochastic(spark: SparkSession, d: str) -> DataFrame:
    h, low, c = (F.col(x) for x in ("high", "low", "close"))
    made = bars(spark, d).withColumns({"raw": I.stochastic_raw(h, low, c, W()), "williams_r": I.williams_r(h, low, c, W())})
    made = made.withColumn("stoch_k", I.rolling(F.avg, F.col("raw"), W(), 3))
    made = made.withColumn("stoch_d", I.rolling(F.avg, F.col("stoch_k"), W(), 3))
    return made.select("symbol", "bar_id", *r6("stoch_k", "stoch_d", "williams_r"))


@query(f"""
WITH {BARS}, a AS (SELECT *, CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) END * volume AS mfv, (high + low + close) / 3 AS tp FROM bars),
b AS (SELECT *, lag(tp) OVER (PARTITION BY symbol ORDER BY bar_id) AS before FROM a),
c AS (SELECT *, CASE WHEN before IS NOT NULL THEN CASE WHEN tp > before THEN tp * volume ELSE 0 END END AS up, CASE WHEN before IS NOT NULL THEN CASE WHEN tp < before THEN tp * volume ELSE 0 END END AS down FROM b),
e AS (SELECT symbol, bar_id, CASE WHEN count(*) OVER v = 21 THEN sum(mfv) OVER v / sum(volume) OVER v END AS cmf, CASE WHEN count(up) OVER w = 14 THEN sum(up) OVER w END AS g, CASE WHEN count(up) OVER w = 14 THEN sum(down) OVER w END AS l
  FROM c WINDOW v AS (PARTITION BY symbol ORDER BY bar_id ROWS 20 PRECEDING), w AS (PARTITION BY symbol ORDER BY bar_id ROWS 13 PRECEDING))
SELECT symbol, bar_id, round(cmf, 6) AS cmf_21, round(CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN l = 0 AND g > 0 THEN 100 END, 6) AS mfi_14 FROM e
""")
def w10_money_flow(spark: SparkSession, d: str) -> DataFrame:
    h, low, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    typical, flow = I.money_flow(h, low, c, v)
    made = bars(spark, d).withColumns({"tp": typical, "before": F.lag(typical).over(W()), "flow": flow, "cmf_21": I.cmf(h, low, c, v, W())})
    made = made.withColumn("mfi_14", I.mfi(F.col("tp"), F.col("before"), F.col("flow"), W()))
    return made.select("symbol", "bar_id", *r6("cmf_21", "mfi_14"))


@query(f"""
WITH {BARS}
SELECT symbol, bar_id, round(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_id)), 9) AS ret_1,
       round(sin(2 * pi() * hour(bar_close_ts) / 24), 9) AS hour_sin, round(cos(2 * pi() * ((isodow(bar_close_ts) - 1)) / 7), 9) AS dow_cos,
       (epoch_us(bar_close_ts) - epoch_us(bar_open_ts)) / 1e6 AS bar_duration_sec
FROM bars
""")
def w09_returns_and_seasons(spark: SparkSession, d: str) -> DataFrame:
    s = I.seasonality(F.col("bar_close_ts"))
    span = F.timestamp_diff("MICROSECOND", F.col("bar_open_ts"), F.col("bar_close_ts")) / 1e6
    return bars(spark, d).select(
        "symbol", "bar_id", F.round(I.log_return(F.col("close"), W()), 9).alias("ret_1"), F.round(s["hour_sin"], 9).alias("hour_sin"),
        F.round(s["dow_cos"], 9).alias("dow_cos"), span.alias("bar_duration_sec"),
    )


@query(f"""
WITH {BARS}, e AS (SELECT *, row_number() OVER w AS k, volume > 1.3 * median(volume) OVER (PARTITION BY symbol ORDER BY bar_id ROWS 49 PRECEDING) AS spike FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_id))
SELECT symbol, bar_id, k - max(CASE WHEN spike THEN k END) OVER (PARTITION BY symbol ORDER BY bar_id ROWS UNBOUNDED PRECEDING) AS bars_since_spike FROM e
""")
def w12_bars_since(spark: SparkSession, d: str) -> DataFrame:
    """Bars since volume was last well above its trailing median."""
    made = bars(spark, d).withColumn("k", F.row_number().over(W()))
    made = made.withColumn("spike", F.col("volume") > 1.3 * F.percentile("volume", 0.5).over(W().rowsBetween(-49, 0)))
    since = I.bars_since(F.col("spike"), F.col("k"), W()).cast("bigint")
    return made.select("symbol", "bar_id", since.alias("bars_since_spike"))


@query(f"""
WITH {BARS}, a AS (SELECT *, CASE WHEN count(*) OVER w = 14 THEN avg(high - low) OVER w END AS atr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_id ROWS 13 PRECEDING)),
b AS (SELECT *, list(atr) FILTER (WHERE atr IS NOT NULL) OVER (PARTITION BY symbol ORDER BY bar_id ROWS 99 PRECEDING) AS v FROM a)
SELECT symbol, bar_id, round(atr, 6) AS atr, CASE WHEN len(v) = 100 THEN round((len(list_filter(v, lambda x: x < atr)) + (len(list_filter(v, lambda x: x = atr)) + 1) / 2.0) / 100, 9) END AS atr_rank FROM b
""")
def w16_atr_rank(spark: SparkSession, d: str) -> DataFrame:
    made = tier1.atr_rank(bars(spark, d))
    return made.select("symbol", "bar_id", *r6("atr"), F.round("atr_rank", 9).alias("atr_rank"))


@query(f"""
WITH {BARS}, e AS (SELECT symbol, CAST(bar_close_ts AS DATE) AS day, max(high) AS h, min(low) AS l, arg_max(close, bar_id) AS c FROM bars GROUP BY ALL)
SELECT symbol, day, round(h, 6) AS day_high, round(l, 6) AS day_low, round(c, 6) AS day_close, round((h + l + c) / 3, 6) AS pivot, round(2 * (h + l + c) / 3 - l, 6) AS r1, round(2 * (h + l + c) / 3 - h, 6) AS s1, round(l + 0.618 * (h - l), 6) AS fib FROM e
""")
def e15_daily_levels(spark: SparkSession, d: str) -> DataFrame:
    return tier1.daily_levels(bars(spark, d)).select("symbol", "day", *r6("day_high", "day_low", "day_close", "pivot", "r1", "s1", "fib"))


@query(f"""
WITH {BARS}, e AS (SELECT symbol, CAST(bar_close_ts AS DATE) AS day, max(high) AS h, min(low) AS l, arg_max(close, bar_id) AS c FROM bars GROUP BY ALL),
p AS (SELECT symbol, day, lag((h + l + c) / 3) OVER w AS pivot, lag(l + 0.618 * (h - l)) OVER w AS fib FROM e WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT b.symbol, b.bar_id, round(ln(b.close / p.pivot), 9) AS dist_pivot, round(ln(b.close / p.fib), 9) AS dist_fib FROM bars b LEFT JOIN p ON p.symbol = b.symbol AND p.day = CAST(b.bar_close_ts AS DATE)
""")
def w17_pivot_distances(spark: SparkSession, d: str) -> DataFrame:
    made = tier1.pivot_distances(bars(spark, d))
    return made.select("symbol", "bar_id", *[F.round(c, 9).alias(c) for c in ("dist_pivot", "dist_fib")])


@query(f"""
WITH {BARS}, q AS (SELECT *, bar_close_ts - INTERVAL 4 HOUR AS t4, bar_close_ts - INTERVAL 24 HOUR AS t24, bar_close_ts - INTERVAL 120 HOUR AS t120 FROM bars)
SELECT q.symbol, q.bar_id, round(ln(q.close / a.close), 9) AS htf_4h, round(ln(q.close / b.close), 9) AS htf_1d, round(ln(q.close / c.close), 9) AS htf_5d
FROM q ASOF LEFT JOIN bars a ON a.symbol = q.symbol AND a.bar_close_ts <= q.t4 ASOF LEFT JOIN bars b ON b.symbol = q.symbol AND b.bar_close_ts <= q.t24 ASOF LEFT JOIN bars c ON c.symbol = q.symbol AND c.bar_close_ts <= q.t120
""")
def c06_higher_frames(spark: SparkSession, d: str) -> DataFrame:
    """Log returns against the last bar at least 4 hours, a day and five days back."""
    made = tier1.higher_frames(bars(spark, d))
    return made.select("symbol", "bar_id", *[F.round(c, 9).alias(c) for c in ("htf_4h", "htf_1d", "htf_5d")])


@query(f"""
WITH {BARS}, e AS (SELECT symbol, CAST(bar_close_ts AS DATE) AS day, arg_max(close, bar_id) AS c FROM bars GROUP BY ALL), p AS (SELECT symbol, day, lag(c) OVER (PARTITION BY symbol ORDER BY day) AS before FROM e)
SELECT b.symbol, b.bar_id, round(b.close / p.before - 1, 9) AS daily_ret_pct FROM bars b JOIN p ON p.symbol = b.symbol AND p.day = CAST(b.bar_close_ts AS DATE)
""")
def w22_day_return(spark: SparkSession, d: str) -> DataFrame:
    return tier1.day_return(bars(spark, d)).select("symbol", "bar_id", F.round("daily_ret_pct", 9).alias("daily_ret_pct"))


@query(f"""
WITH {BARS}, e AS (SELECT *, max(high) OVER w AS h, min(low) OVER w AS l FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_close_ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW))
SELECT symbol, bar_id, round(CASE WHEN h = l THEN 0.5 ELSE least(greatest((close - l) / (h - l), 0), 1) END, 9) AS weekly_range_pos FROM e
""")
def w23_week_position(spark: SparkSession, d: str) -> DataFrame:
    return tier1.week_position(bars(spark, d), peers=True).select("symbol", "bar_id", F.round("weekly_range_pos", 9).alias("weekly_range_pos"))


@query(f"""
WITH {BARS}, a AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_id)) AS r FROM bars),
b AS (SELECT *, CASE WHEN count(r) OVER w = 50 THEN stddev_samp(r) OVER w END AS v FROM a WINDOW w AS (PARTITION BY symbol ORDER BY bar_id ROWS 49 PRECEDING))
SELECT symbol, bar_id, round(CASE WHEN count(v) OVER w = 200 THEN v / median(v) OVER w END, 6) AS regime_vol_ratio FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_id ROWS 199 PRECEDING)
""")
def w24_regime_ratio(spark: SparkSession, d: str) -> DataFrame:
    return tier1.regime_ratio(bars(spark, d)).select("symbol", "bar_id", *r6("regime_vol_ratio"))


@query(f"""
WITH {BARS}, a AS (SELECT *, CASE WHEN bar_close_ts > bar_open_ts THEN n_trades / ((epoch_us(bar_close_ts) - epoch_us(bar_open_ts)) / 1e6) ELSE 0 END AS rate FROM bars),
b AS (SELECT *, CASE WHEN count(*) OVER w = 50 THEN median(rate) OVER w END AS m FROM a WINDOW w AS (PARTITION BY symbol ORDER BY bar_id ROWS 49 PRECEDING))
SELECT symbol, bar_id, round(CASE WHEN m > 0 THEN rate / m ELSE 1 END, 6) AS trade_intensity FROM b
""")
def w21_trade_intensity(spark: SparkSession, d: str) -> DataFrame:
    span = F.timestamp_diff("MICROSECOND", F.col("bar_open_ts"), F.col("bar_close_ts")) / 1e6
    made = bars(spark, d).withColumn("sec", span)
    return made.select("symbol", "bar_id", F.round(trade_intensity(F.col("n_trades"), F.col("sec"), W()), 6).alias("trade_intensity"))


@query(f"""
WITH {BARS}, a AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_id)) AS r FROM bars)
SELECT symbol, round(min(r), 9) AS lowest, round(median(r), 9) AS middle, round(max(r), 9) AS highest, count(*) - count(r) AS n_null, count(DISTINCT r) <= 1 AS degenerate FROM a GROUP BY symbol
""")
def e22_distribution(spark: SparkSession, d: str) -> DataFrame:
    made = bars(spark, d).withColumn("r", I.log_return(F.col("close"), W()))
    return made.groupBy("symbol").agg(
        F.round(F.min("r"), 9).alias("lowest"), F.round(F.median("r"), 9).alias("middle"), F.round(F.max("r"), 9).alias("highest"),
        F.count_if(F.col("r").isNull()).alias("n_null"), (F.countDistinct("r") <= 1).alias("degenerate"),
    )


@query(f"""
WITH {BARS}, {labels_sql("0.05", "0.05", 24)}
SELECT symbol, bar_id, {LABEL_NUMBER} AS label, exit_bar_id, exit_reason, holding_bars, round(exit_price, 6) AS exit_price FROM labels
""")
def w30_triple_barrier(spark: SparkSession, d: str) -> DataFrame:
    made = L.triple_barrier(bars(spark, d), 0.05, 0.05, 24)
    return made.select("symbol", "bar_id", "label", "exit_bar_id", "exit_reason", F.col("holding_bars").cast("bigint").alias("holding_bars"), *r6("exit_price"))


@query(f"""
WITH {BARS}, {labels_sql("0.05", "0.05", 24)}
SELECT symbol, {LABEL_NUMBER} AS label, count(*) AS n, CAST(max(holding_bars) AS BIGINT) AS longest, round(avg(holding_bars), 9) AS mean_held, median(holding_bars) AS median_held FROM labels GROUP BY ALL
""")
def e16_class_counts(spark: SparkSession, d: str) -> DataFrame:
    held = F.col("holding_bars")
    return L.triple_barrier(bars(spark, d), 0.05, 0.05, 24).groupBy("symbol", "label").agg(
        F.count(F.lit(1)).alias("n"), F.max(held).cast("bigint").alias("longest"), F.round(F.avg(held), 9).alias("mean_held"), F.median(held).alias("median_held")
    )


@query(f"""
WITH {BARS}, {labels_sql("0.05", "0.05", 24)}, c AS (SELECT symbol, {LABEL_NUMBER} AS y, count(*) AS n FROM labels WHERE exit_reason IS NOT NULL GROUP BY ALL), p AS (SELECT symbol, n / sum(n) OVER (PARTITION BY symbol) AS p FROM c)
SELECT symbol, round(-sum(p * ln(p)), 9) AS entropy FROM p GROUP BY symbol
""")
def e17_prior_entropy(spark: SparkSession, d: str) -> DataFrame:
    made = L.triple_barrier(bars(spark, d), 0.05, 0.05, 24).where("label <> -1")
    return entropy(made, "label", "symbol").select("symbol", F.round("entropy", 9).alias("entropy"))


@query(f"""
WITH {BARS}, {labels_sql("0.03", "0.03", 24)}
SELECT symbol, exit_reason, count(*) AS n, count(*) FILTER (WHERE touched) AS n_touched FROM (
  SELECT l.symbol, l.exit_reason, EXISTS (
    SELECT 1 FROM numbered a JOIN numbered b ON a.symbol = b.symbol AND b.k > a.k + l.holding_bars AND b.k <= a.k + 24
    WHERE a.symbol = l.symbol AND a.bar_id = l.bar_id AND CASE WHEN l.exit_reason = 'tp' THEN b.low <= a.close * (1 - 0.03) ELSE b.high >= a.close * (1 + 0.03) END) AS touched
  FROM labels l WHERE l.exit_reason IN ('tp', 'sl')) GROUP BY ALL
""")
def e28_touched_after(spark: SparkSession, d: str) -> DataFrame:
    """Exits at one barrier whose bars would have touched the other one later."""
    made = L.touched_after(bars(spark, d), L.triple_barrier(bars(spark, d), 0.03, 0.03, 24), 0.03, 0.03, 24)
    return made.where(F.col("exit_reason").isin("tp", "sl")).groupBy("symbol", "exit_reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("later_touch").alias("n_touched"))


@query(f"""
WITH {BARS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_close_ts, bar_id) AS k, count(*) OVER (PARTITION BY symbol) AS n_all FROM bars),
e AS (SELECT *, CASE WHEN bar_id % 2 = 0 THEN 1 ELSE -1 END AS direction FROM numbered),
h AS (SELECT e.symbol, e.bar_id, min(b.k - e.k) AS held FROM e JOIN numbered b ON b.symbol = e.symbol AND b.k > e.k AND b.k <= e.k + 24 WHERE b.high >= e.close * 1.04 OR b.low <= e.close * 0.96 GROUP BY ALL),
x AS (SELECT e.*, h.held, b.high AS bh, b.low AS bl, z.close AS last_close FROM e LEFT JOIN h USING (symbol, bar_id) LEFT JOIN numbered b ON b.symbol = e.symbol AND b.k = e.k + h.held LEFT JOIN numbered z ON z.symbol = e.symbol AND z.k = e.k + 24),
y AS (SELECT *, CASE WHEN held IS NULL THEN CASE WHEN k + 24 <= n_all THEN 'timeout' END WHEN direction = 1 AND bl <= close * 0.96 OR direction = -1 AND bh >= close * 1.04 THEN 'sl' ELSE 'tp' END AS exit_reason FROM x)
SELECT symbol, bar_id, direction, exit_reason, CASE WHEN exit_reason IS NOT NULL THEN coalesce(held, 24) END AS holding_bars,
       round(CASE exit_reason WHEN 'sl' THEN close * (1 - 0.04 * direction) WHEN 'tp' THEN close * (1 + 0.04 * direction) WHEN 'timeout' THEN last_close END, 6) AS exit_price FROM y
""")
def w31_live_exits(spark: SparkSession, d: str) -> DataFrame:
    made = bars(spark, d)
    entries = made.select("symbol", "bar_id", F.when(F.col("bar_id") % 2 == 0, 1).otherwise(-1).alias("direction"))
    return L.live_exits(entries, made, 0.04, 0.04, 24).select("symbol", "bar_id", "direction", "exit_reason", F.col("holding_bars").cast("bigint").alias("holding_bars"), *r6("exit_price"))


@query(f"""
WITH {BARS}, {labels_sql("0.05", "0.05", 24)}, f AS (SELECT symbol, bar_id, count(close) OVER (PARTITION BY symbol ORDER BY bar_id ROWS 95 PRECEDING) AS n, arg_min(bar_id, bar_id) OVER (PARTITION BY symbol ORDER BY bar_id ROWS 95 PRECEDING) AS first_bar FROM bars)
SELECT f.symbol, f.bar_id, f.first_bar, f.n AS length FROM f JOIN labels l USING (symbol, bar_id) WHERE f.n = 96 AND l.exit_reason IS NOT NULL
""")
def w33_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Bars with a full window of 96 vectors, and where it begins."""
    from barloom.operators.models import sequences

    made = sequences(L.triple_barrier(bars(spark, d), 0.05, 0.05, 24), ["bar_id", "close"])
    return made.select("symbol", "bar_id", F.col("window")[0][0].cast("bigint").alias("first_bar"), F.size("window").cast("bigint").alias("length"))


@query(f"""
WITH {BARS}, {labels_sql("0.05", "0.05", 24)}, j AS (SELECT l.*, row_number() OVER (PARTITION BY l.symbol ORDER BY l.bar_id) AS k FROM labels l)
SELECT symbol, bar_id, round(ln(exit_price / close), 9) AS target FROM j WHERE exit_price IS NOT NULL
""")
def c14_return_target(spark: SparkSession, d: str) -> DataFrame:
    made = bars(spark, d)
    labels = L.triple_barrier(made, 0.05, 0.05, 24).where("label <> -1").select("symbol", "bar_id", "exit_price")
    return labels.join(made.select("symbol", "bar_id", "close"), ["symbol", "bar_id"]).select("symbol", "bar_id", F.round(F.ln(F.col("exit_price") / F.col("close")), 9).alias("target"))


@query(f"""
WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_close_ts, bar_id) AS k FROM bars)
SELECT a.symbol, a.bar_id AS entry_bar, b.bar_id, round(b.close, 6) AS close FROM n a JOIN n b ON a.symbol = b.symbol AND b.k > a.k AND b.k <= a.k + 3
""")
def c13_bars_after_entry(spark: SparkSession, d: str) -> DataFrame:
    """The three bars after each entry, from a frame instead of a join."""
    ahead = F.collect_list(F.struct("bar_id", "close")).over(W().rowsBetween(1, 3))
    made = bars(spark, d).withColumn("ahead", ahead)
    return made.select("symbol", F.col("bar_id").alias("entry_bar"), F.explode("ahead").alias("x")).select("symbol", "entry_bar", "x.bar_id", F.round("x.close", 6).alias("close"))
