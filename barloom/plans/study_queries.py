"""Registered queries over folds, trades, sessions and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.config import COST_SCENARIOS, FoldParams
from barloom.operators import backtest as X
from barloom.operators import sessions as S
from barloom.operators import validation as V
from barloom.operators.labels import triple_barrier
from barloom.streaming.paper import must_halt, realised_today

from .base import BARS, DAYS, LABEL_NUMBER, PRED, bars, days, labels_sql, predicted, query, r6

_FOLDS = FoldParams(purge=24, embargo=24, min_rows=50)

_FOLD_CTE = """span AS (SELECT CAST(date_trunc('month', min(d)) AS DATE) AS a, CAST(date_trunc('month', max(d)) + INTERVAL 1 MONTH AS DATE) AS b FROM days),
folds AS (
  SELECT CAST(i AS INTEGER) AS fold_id, a AS train_start, CAST(a + to_months(CAST(24 + 3 * (i - 1) AS INTEGER)) AS DATE) AS val_start,
         CAST(a + to_months(CAST(27 + 3 * (i - 1) AS INTEGER)) AS DATE) AS oot_start, CAST(a + to_months(CAST(30 + 3 * (i - 1) AS INTEGER)) AS DATE) AS oot_end, b
  FROM span, range(1, 200) r(i)
)"""

_SPLIT_CTE = f"""{DAYS}, {_FOLD_CTE}, placed AS (
  SELECT f.fold_id, d.*, CASE WHEN d.d < f.val_start THEN 'train' WHEN d.d < f.oot_start THEN 'val' ELSE 'oot' END AS role
  FROM folds f JOIN days d ON d.d >= f.train_start AND d.d < f.oot_end WHERE f.oot_end <= f.b
), numbered_roles AS (
  SELECT *, count(*) OVER (PARTITION BY fold_id, role) AS n, row_number() OVER (PARTITION BY fold_id, role ORDER BY d) AS up,
         row_number() OVER (PARTITION BY fold_id, role ORDER BY d DESC) AS down FROM placed
), split AS (SELECT * FROM numbered_roles WHERE NOT (role = 'train' AND n > 24 AND down <= 24) AND NOT (role = 'oot' AND n > 24 AND up <= 24))"""


def _calendar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    made = days(spark, d)
    span = V.data_range(made, "d").first()
    return made, V.folds(spark, str(span["data_start"]), str(span["data_end"]), _FOLDS)


@query(f"WITH {DAYS}, {_FOLD_CTE} SELECT fold_id, train_start, val_start, oot_start, oot_end FROM folds WHERE oot_end <= b")
def m01_folds(spark: SparkSession, d: str) -> DataFrame:
    return _calendar(spark, d)[1]


@query(f"WITH {DAYS} SELECT CAST(date_trunc('month', min(d)) AS DATE) AS data_start, CAST(date_trunc('month', max(d)) + INTERVAL 1 MONTH AS DATE) AS data_end FROM days")
def m03_data_range(spark: SparkSession, d: str) -> DataFrame:
    return V.data_range(days(spark, d), "d")


@query(f"WITH {_SPLIT_CTE} SELECT fold_id, role, d, n_trades FROM split")
def m02_split(spark: SparkSession, d: str) -> DataFrame:
    """Every fold's rows by role, purged and embargoed."""
    made, folds = _calendar(spark, d)
    return V.split(made, folds, "d", "close", _FOLDS).select("fold_id", "role", "d", "n_trades")


@query(f"""
WITH {_SPLIT_CTE}
SELECT fold_id, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'val') AS n_val, count(*) FILTER (WHERE role = 'oot') AS n_oot
FROM split GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'val') >= 50 AND count(*) FILTER (WHERE role = 'oot') >= 50
""")
def m04_usable_folds(spark: SparkSession, d: str) -> DataFrame:
    made, folds = _calendar(spark, d)
    return V.usable_folds(V.split(made, folds, "d", "close", _FOLDS), _FOLDS.min_rows)


@query(f"""
WITH {_SPLIT_CTE}, c AS (SELECT fold_id, CASE WHEN close > open THEN 0 WHEN close < open * 0.8 THEN 1 ELSE 2 END AS y, count(*) AS n FROM split WHERE role = 'val' GROUP BY ALL),
e AS (SELECT fold_id, -sum(p * ln(p)) AS h FROM (SELECT fold_id, n / sum(n) OVER (PARTITION BY fold_id) AS p FROM c) GROUP BY 1), r AS (SELECT fold_id, h / 1.04 AS ratio, row_number() OVER (ORDER BY fold_id) AS k FROM e)
SELECT count(*) FILTER (WHERE ratio < 0.99) AS n_pass, count(*) FILTER (WHERE ratio < 0.99) >= 4 AS passed FROM r WHERE k <= 6
""")
def e18_pre_gate(spark: SparkSession, d: str) -> DataFrame:
    """Of the first six folds, how many have a loss ratio below the gate."""
    made, folds = _calendar(spark, d)
    y = F.when(F.col("close") > F.col("open"), 0).when(F.col("close") < F.col("open") * 0.8, 1).otherwise(2)
    val = V.split(made, folds, "d", "close", _FOLDS).where("role = 'val'").withColumn("y", y)
    return V.pre_gate(V.entropy(val, "y", "fold_id").select("fold_id", (F.col("entropy") / 1.04).alias("ratio")))


_SIGNALS = BARS + ", " + PRED + ", " + labels_sql("0.05", "0.05", 24) + f""", joined AS (
  SELECT p.symbol, p.bar_id, p.bar_close_ts AS entry_ts, l.exit_ts, p.close AS entry_price, l.exit_price, l.exit_reason, l.holding_bars, p.p_long, p.p_short, p.p_neutral, {LABEL_NUMBER} AS label
  FROM pred p JOIN labels l USING (symbol, bar_id) WHERE l.exit_reason IS NOT NULL
)"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Bars with labels and probabilities: what a backtest reads."""
    made = triple_barrier(bars(spark, d), 0.05, 0.05, 24).where("label <> -1")
    return predicted(made).select(
        "symbol", "bar_id", F.col("bar_close_ts").alias("entry_ts"), "exit_ts", F.col("close").alias("entry_price"),
        "exit_price", "exit_reason", "holding_bars", "p_long", "p_short", "p_neutral", "label",
    )


@query(f"WITH {_SIGNALS} SELECT symbol, bar_id, label, exit_reason, round(p_long, 6) AS p_long, round(exit_price, 6) AS exit_price FROM joined")
def c02_signals(spark: SparkSession, d: str) -> DataFrame:
    """Predictions, bars and labels by key."""
    return _signals(spark, d).select("symbol", "bar_id", "label", "exit_reason", *r6("p_long", "exit_price"))


@query(f"WITH {_SIGNALS} SELECT symbol, bar_id, CASE WHEN p_long > 0.45 THEN 1 WHEN p_short > 0.45 THEN -1 ELSE 0 END AS direction FROM joined")
def b11_signal_rule(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("symbol", "bar_id", X.signal(F.lit(0.45)).alias("direction"))


@query(f"""
WITH {_SIGNALS}, b AS (SELECT *, greatest(p_long, p_short, p_neutral) AS best FROM joined)
SELECT symbol, bar_id, CASE WHEN best < 0.5 OR (p_long < best AND p_short < best) THEN 'skip' WHEN p_long = best THEN 'long' ELSE 'short' END AS decision,
       CASE WHEN best < 0.5 THEN printf('max prob %.3f below %.2f', best, 0.5) WHEN p_long < best AND p_short < best THEN 'neutral' ELSE printf('prob %.3f', best) END AS reason FROM b
""")
def b10_live_rule(spark: SparkSession, d: str) -> DataFrame:
    decision, reason = X.live_decision(F.lit(0.5))
    return _signals(spark, d).select("symbol", "bar_id", decision.alias("decision"), reason.alias("reason"))


@query(f"WITH {_SIGNALS} SELECT symbol, bar_id, CAST(p_long - 0.4 > 0.01 AS INT)::DOUBLE AS p_long, CAST(p_long - 0.4 < -0.01 AS INT)::DOUBLE AS p_short FROM joined")
def b12_pseudo_probabilities(spark: SparkSession, d: str) -> DataFrame:
    p = X.pseudo_probabilities(F.col("p_long") - 0.4, F.lit(0.01))
    return _signals(spark, d).select("symbol", "bar_id", p["p_long"].alias("p_long"), p["p_short"].alias("p_short"))


@query(f"WITH {_SIGNALS} SELECT symbol, round(avg(-ln(greatest(CASE label WHEN 0 THEN p_long WHEN 1 THEN p_short ELSE p_neutral END, 1e-15))), 9) AS log_loss FROM joined GROUP BY symbol")
def e19_log_loss(spark: SparkSession, d: str) -> DataFrame:
    probs = F.array("p_long", "p_short", "p_neutral")
    return _signals(spark, d).groupBy("symbol").agg(F.round(V.log_loss(probs, F.col("label")), 9).alias("log_loss"))


def _trades_sql(threshold: str = "0.55", keys: str = "symbol", source: str = "joined", cost: str = "11.0") -> str:
    """Trades that find the one slot free: a fold over each key's signals in order."""
    return f"""picked AS (
  SELECT {keys}, list_reduce(
    list_concat([{{'last': TIMESTAMP '1900-01-01', 'taken': CAST([] AS BIGINT[]), 'entry': TIMESTAMP '1900-01-01', 'leave': TIMESTAMP '1900-01-01', 'id': CAST(0 AS BIGINT)}}],
      list({{'last': TIMESTAMP '1900-01-01', 'taken': CAST([] AS BIGINT[]), 'entry': entry_ts, 'leave': exit_ts, 'id': bar_id}} ORDER BY entry_ts, bar_id)),
    lambda a, x: CASE WHEN x.entry >= a.last THEN {{'last': x.leave, 'taken': list_append(a.taken, x.id), 'entry': x.entry, 'leave': x.leave, 'id': x.id}} ELSE a END).taken AS ids
  FROM {source} WHERE p_long > {threshold} OR p_short > {threshold} GROUP BY {keys}
), trades AS (
  SELECT *, pnl_bps_gross - {cost} AS pnl_bps_net FROM (
    SELECT j.*, CASE WHEN p_long > {threshold} THEN 1 ELSE -1 END AS direction,
           CASE WHEN p_long > {threshold} THEN 1 ELSE -1 END * (exit_price / entry_price - 1) * 10000 AS pnl_bps_gross
    FROM {source} j JOIN picked p USING ({keys}) WHERE list_contains(p.ids, j.bar_id))
)"""


def _trades(spark: SparkSession, d: str, threshold: float = 0.55, cost: float = 11.0) -> DataFrame:
    made = _signals(spark, d).withColumn("direction", X.signal(F.lit(threshold))).where("direction <> 0")
    return X.with_pnl(X.select_trades(made, ["symbol"]), F.lit(cost))


@query(f"WITH {_SIGNALS}, {_trades_sql()} SELECT symbol, bar_id, direction, exit_reason, round(pnl_bps_gross, 6) AS pnl_bps_gross, round(pnl_bps_net, 6) AS pnl_bps_net FROM trades")
def w32_trades(spark: SparkSession, d: str) -> DataFrame:
    """Non-overlapping trades: a signal is taken when the position before has closed."""
    return _trades(spark, d).select("symbol", "bar_id", "direction", "exit_reason", *r6("pnl_bps_gross", "pnl_bps_net"))


_CURVE = """curve AS (
  SELECT symbol, exit_ts AS ts, row_number() OVER w AS n, 10000 * exp(sum(ln(1 + pnl_bps_net / 10000)) OVER (w ROWS UNBOUNDED PRECEDING)) AS equity FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY exit_ts, bar_id)
  UNION ALL SELECT symbol, arg_min(entry_ts, (exit_ts, bar_id)), 0, 10000.0 FROM trades GROUP BY symbol
), fallen AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY n ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM curve),
ends AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_max(equity, (ts, n)) AS equity FROM curve GROUP BY ALL),
filled AS (
  SELECT s.symbol, s.day, last_value(e.equity IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY s.day ROWS UNBOUNDED PRECEDING) AS equity
  FROM (SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM ends GROUP BY symbol) s LEFT JOIN ends e USING (symbol, day)
), daily AS (SELECT * FROM (SELECT symbol, day, ln(equity / lag(equity) OVER (PARTITION BY symbol ORDER BY day)) AS ret FROM filled) WHERE ret IS NOT NULL)"""


@query(f"WITH {_SIGNALS}, {_trades_sql()}, {_CURVE} SELECT symbol, n, ts, round(equity, 6) AS equity, round(drawdown, 9) AS drawdown FROM fallen")
def w28_equity_curve(spark: SparkSession, d: str) -> DataFrame:
    curve = X.drawdown(X.equity_curve(_trades(spark, d), ["symbol"]), ["symbol"])
    return curve.select("symbol", F.col("n").cast("bigint").alias("n"), "ts", *r6("equity"), F.round("drawdown", 9).alias("drawdown"))


@query(f"WITH {_SIGNALS}, {_trades_sql()}, {_CURVE} SELECT symbol, day, round(ret, 9) AS ret FROM daily")
def w29_daily_returns(spark: SparkSession, d: str) -> DataFrame:
    return X.daily_returns(X.equity_curve(_trades(spark, d), ["symbol"]), ["symbol"]).select("symbol", "day", F.round("ret", 9).alias("ret"))


@query(f"""
WITH {_SIGNALS}, {_trades_sql()}, {_CURVE}, nb AS (SELECT symbol, count(*) AS n_bars FROM bars GROUP BY 1),
r AS (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS s, stddev_samp(ret) FILTER (WHERE ret < 0) AS sn, exp(sum(ln(1 + ret))) AS grown, count(*) AS n FROM daily GROUP BY 1),
f AS (SELECT symbol, min(drawdown) AS dd FROM fallen GROUP BY 1), c AS (SELECT symbol, count(*) AS n_trades, 100.0 * count(*) FILTER (WHERE pnl_bps_net > 0) / count(*) AS win, sum(holding_bars) AS held FROM trades GROUP BY 1)
SELECT c.symbol, n_trades, round(win, 6) AS win_pct, round(100.0 * held / n_bars, 6) AS pct_time_in_market, round(coalesce(CASE WHEN s > 0 THEN m / s * sqrt(252) END, 0), 6) AS sharpe,
       round(coalesce(CASE WHEN sn > 0 THEN m / sn * sqrt(252) END, 0), 6) AS sortino, round(dd, 6) AS max_dd, round(pow(grown, 252.0 / n) - 1, 6) AS annual_return
FROM c JOIN f USING (symbol) JOIN r USING (symbol) JOIN nb USING (symbol)
""")
def m13_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Risk metrics of the backtest, by symbol."""
    sizes = bars(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    made = X.metrics(_trades(spark, d), ["symbol"], sizes)
    return made.select("symbol", "n_trades", *r6("win_pct", "pct_time_in_market", "sharpe", "sortino", "max_dd", "annual_return"))


_SWEEP = f"""WITH {_SIGNALS}, params AS (SELECT unnest([0.45, 0.5, 0.55, 0.6]) AS threshold), swept AS (
  SELECT j.*, threshold, CASE WHEN p_long > threshold THEN 1 WHEN p_short > threshold THEN -1 ELSE 0 END AS direction FROM joined j, params),
picked AS (
  SELECT symbol, threshold, list_reduce(
    list_concat([{{'last': TIMESTAMP '1900-01-01', 'taken': CAST([] AS BIGINT[]), 'entry': TIMESTAMP '1900-01-01', 'leave': TIMESTAMP '1900-01-01', 'id': CAST(0 AS BIGINT)}}],
      list({{'last': TIMESTAMP '1900-01-01', 'taken': CAST([] AS BIGINT[]), 'entry': entry_ts, 'leave': exit_ts, 'id': bar_id}} ORDER BY entry_ts, bar_id)),
    lambda a, x: CASE WHEN x.entry >= a.last THEN {{'last': x.leave, 'taken': list_append(a.taken, x.id), 'entry': x.entry, 'leave': x.leave, 'id': x.id}} ELSE a END).taken AS ids
  FROM swept WHERE direction <> 0 GROUP BY ALL),
taken AS (SELECT s.*, direction * (exit_price / entry_price - 1) * 10000 AS gross FROM swept s JOIN picked p USING (symbol, threshold) WHERE direction <> 0 AND list_contains(p.ids, s.bar_id))"""


def _swept(spark: SparkSession, d: str) -> DataFrame:
    """Trades for all thresholds at once: the parameters are a few rows of a broadcast join, and keys from there on."""
    params = spark.createDataFrame([(x,) for x in (0.45, 0.5, 0.55, 0.6)], "threshold double")
    made = _signals(spark, d).join(F.broadcast(params), F.lit(True)).withColumn("direction", X.signal(F.col("threshold")))
    return X.with_pnl(X.select_trades(made.where("direction <> 0"), ["symbol", "threshold"]), F.lit(0.0))


@query(f"""{_SWEEP}
SELECT symbol, CAST(threshold AS DOUBLE) AS threshold, count(*) AS n_trades, count(*) FILTER (WHERE direction = 1) AS n_long, round(100.0 * count(*) FILTER (WHERE gross > 11) / count(*), 6) AS win_pct,
       round(avg(gross - 11), 6) AS mean_pnl, round(median(gross - 11), 6) AS median_pnl FROM taken GROUP BY ALL
""")
def m14_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    net = F.col("pnl_bps_gross") - 11.0
    return _swept(spark, d).groupBy("symbol", "threshold").agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(F.col("direction") == 1).alias("n_long"),
        F.round(100.0 * F.count_if(net > 0) / F.count(F.lit(1)), 6).alias("win_pct"),
        F.round(F.avg(net), 6).alias("mean_pnl"),
        F.round(F.median(net), 6).alias("median_pnl"),
    )


@query(f"""{_SWEEP}
SELECT scenario, CAST(threshold AS DOUBLE) AS threshold, count(*) AS n_trades, round(sum(gross - cost), 6) AS total_pnl, round(100.0 * count(*) FILTER (WHERE gross > cost) / count(*), 6) AS win_pct
FROM taken, (VALUES {", ".join(f"('{k}', {v!r})" for k, v in COST_SCENARIOS.items())}) c(scenario, cost) GROUP BY ALL
""")
def m17_cost_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Costs don't change which trades are taken: one selection serves all scenarios."""
    costs = spark.createDataFrame(list(COST_SCENARIOS.items()), "scenario string, cost double")
    net = F.col("pnl_bps_gross") - F.col("cost")
    return _swept(spark, d).join(F.broadcast(costs), F.lit(True)).groupBy("scenario", "threshold").agg(
        F.count(F.lit(1)).alias("n_trades"), F.round(F.sum(net), 6).alias("total_pnl"), F.round(100.0 * F.count_if(net > 0) / F.count(F.lit(1)), 6).alias("win_pct")
    )


@query("WITH " + BARS + """, params AS (SELECT unnest([0.02, 0.03, 0.05]) AS barrier), keyed AS (SELECT bars.*, barrier FROM bars, params),
numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol, barrier ORDER BY bar_id) AS k, count(*) OVER (PARTITION BY symbol, barrier) AS n_all FROM keyed),
touched AS (SELECT a.symbol, a.barrier, a.bar_id, min(b.k - a.k) AS held FROM numbered a JOIN numbered b ON a.symbol = b.symbol AND a.barrier = b.barrier AND b.k > a.k AND b.k <= a.k + 24
  WHERE b.high >= a.close * (1 + CAST(a.barrier AS DOUBLE)) OR b.low <= a.close * (1 - CAST(a.barrier AS DOUBLE)) GROUP BY ALL),
l AS (SELECT a.symbol, a.barrier, CASE WHEN a.k + 24 > a.n_all THEN -1 WHEN h.held IS NULL THEN 2 WHEN x.high >= a.close * (1 + CAST(a.barrier AS DOUBLE)) AND x.low <= a.close * (1 - CAST(a.barrier AS DOUBLE)) THEN 2
  WHEN x.high >= a.close * (1 + CAST(a.barrier AS DOUBLE)) THEN 0 ELSE 1 END AS label FROM numbered a LEFT JOIN touched h ON h.symbol = a.symbol AND h.barrier = a.barrier AND h.bar_id = a.bar_id LEFT JOIN numbered x ON x.symbol = a.symbol AND x.barrier = a.barrier AND x.k = a.k + h.held)
SELECT symbol, CAST(barrier AS DOUBLE) AS barrier, label, count(*) AS n FROM l GROUP BY ALL""")
def m15_barrier_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Labels for several barriers in one pass."""
    params = spark.createDataFrame([(x,) for x in (0.02, 0.03, 0.05)], "barrier double")
    keyed = bars(spark, d).join(F.broadcast(params), F.lit(True))
    made = triple_barrier(keyed, F.col("barrier"), F.col("barrier"), 24, ("symbol", "barrier"))
    return made.groupBy("symbol", "barrier", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_SWEEP}, summed AS (SELECT symbol, threshold, sum(gross - 11) AS total FROM taken GROUP BY ALL)
SELECT symbol, CAST(arg_max(threshold, total) AS DOUBLE) AS best_threshold, round(max(total), 6) AS best_total FROM summed GROUP BY symbol""")
def f06_best_threshold(spark: SparkSession, d: str) -> DataFrame:
    made = _swept(spark, d).groupBy("symbol", "threshold").agg(F.sum(F.col("pnl_bps_gross") - 11.0).alias("total"))
    return made.groupBy("symbol").agg(F.max_by("threshold", "total").alias("best_threshold"), F.round(F.max("total"), 6).alias("best_total"))


#: Paper-trading tables made from the orders: a session is a market segment (one without trades), a trade an order.
_SESSIONS = """sessions AS (
  SELECT CAST(row_number() OVER (ORDER BY s) AS BIGINT) AS session_id, s AS name FROM (SELECT DISTINCT c_mktsegment AS s FROM customer UNION ALL SELECT 'NONE')
), trades AS (
  SELECT o_orderkey AS trade_id, s.session_id, o_orderdate AS entry_ts, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + INTERVAL 2 DAY END AS exit_ts,
         CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'exited' END AS status, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 200 - 90 END AS pnl, CAST(o_orderkey % 20 + 1 AS INTEGER) AS fold_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN sessions s ON s.name = c_mktsegment
)"""


def _paper(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment")
    names = customers.select(F.col("c_mktsegment").alias("name")).distinct().unionAll(spark.createDataFrame([("NONE",)], "name string"))
    sessions = names.withColumn("session_id", F.row_number().over(Window.orderBy("name")).cast("bigint")).select("session_id", "name")
    open_ = F.col("o_orderstatus") == "O"
    trades = (
        spark.read.parquet(f"{d}/orders.parquet")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(sessions.withColumnRenamed("name", "c_mktsegment"), "c_mktsegment")
        .select(
            F.col("o_orderkey").alias("trade_id"),
            "session_id",
            F.col("o_orderdate").alias("entry_ts"),
            F.when(~open_, F.col("o_orderdate") + F.expr("interval 2 day")).alias("exit_ts"),
            F.when(open_, "open").otherwise("exited").alias("status"),
            F.when(~open_, F.floor("o_totalprice") % 200 - 90).cast("double").alias("pnl_bps"),
            (F.col("o_orderkey") % 20 + 1).cast("int").alias("fold_id"),
        )
    )
    return sessions, trades


@query(f"""
WITH {_SESSIONS}, p AS (SELECT session_id, count(*) AS n_trades, count(*) FILTER (WHERE status = 'open') AS n_open, count(*) FILTER (WHERE status = 'exited' AND pnl > 0) AS n_winners,
  CAST(sum(pnl) FILTER (WHERE status = 'exited') AS DOUBLE) AS total, avg(pnl) FILTER (WHERE status = 'exited') AS mean FROM trades GROUP BY 1)
SELECT session_id, name, coalesce(n_trades, 0) AS n_trades, coalesce(n_open, 0) AS n_open, coalesce(n_winners, 0) AS n_winners, coalesce(total, 0) AS total_pnl_bps, round(coalesce(mean, 0), 6) AS mean_pnl_bps FROM sessions LEFT JOIN p USING (session_id)
""")
def c11_sessions(spark: SparkSession, d: str) -> DataFrame:
    made = S.session_overview(*_paper(spark, d))
    return made.withColumns({c: F.col(c).cast("bigint") for c in ("n_trades", "n_open", "n_winners")}).withColumn("mean_pnl_bps", F.round("mean_pnl_bps", 6))


@query(f"WITH {_SESSIONS} SELECT trade_id, CAST(sum(pnl) OVER (PARTITION BY session_id ORDER BY exit_ts) AS DOUBLE) AS cum_pnl_bps FROM trades WHERE status = 'exited'")
def w26_running_pnl(spark: SparkSession, d: str) -> DataFrame:
    """Running total; exits of the same time share it."""
    return S.running_pnl(_paper(spark, d)[1].where("status = 'exited'"), "session_id").select("trade_id", "cum_pnl_bps")


@query(f"WITH {_SESSIONS} SELECT trade_id, exit_ts FROM trades WHERE session_id = 2 AND status = 'exited' ORDER BY exit_ts DESC NULLS LAST, trade_id DESC LIMIT 500")
def f02_newest_trades(spark: SparkSession, d: str) -> DataFrame:
    """A page of the trade list, with an optional filter that asks for nothing."""
    chosen = S.where_all(("session_id", 2), ("status", "exited"), ("fold_id", "all"))
    return S.newest_first(_paper(spark, d)[1].where(chosen), "exit_ts", "trade_id", 500).select("trade_id", "exit_ts")


@query(f"""
WITH {_SESSIONS} SELECT fold_id, count(*) AS n_trades, round(100.0 * count(*) FILTER (WHERE pnl > 0) / count(*), 6) AS win_pct, round(avg(pnl), 6) AS mean_pnl_bps, CAST(sum(pnl) AS DOUBLE) AS total_pnl_bps, min(entry_ts) AS first_entry, max(exit_ts) AS last_exit
FROM trades WHERE status = 'exited' GROUP BY 1
""")
def e11_fold_summary(spark: SparkSession, d: str) -> DataFrame:
    made = S.fold_summary(_paper(spark, d)[1].where("status = 'exited'"))
    return made.withColumns({c: F.round(c, 6) for c in ("win_pct", "mean_pnl_bps")})


@query(f"""
WITH {_SESSIONS}, m AS (SELECT fold_id, count(*) AS n_trades, avg(pnl) / stddev_samp(pnl) AS sharpe FROM trades WHERE status = 'exited' GROUP BY 1)
SELECT CASE WHEN fold_id <= 6 THEN 'early' WHEN fold_id <= 14 THEN 'middle' ELSE 'late' END AS era, count(*) AS n_folds, count(*) FILTER (WHERE n_trades > 0) AS n_active, round(avg(sharpe), 9) AS mean_sharpe, round(stddev_samp(sharpe), 9) AS std_sharpe,
       round(avg(sharpe) FILTER (WHERE sharpe <> 0), 9) AS mean_nonzero_sharpe, CAST(sum(n_trades) AS BIGINT) AS n_trades FROM m GROUP BY 1
""")
def e27_eras(spark: SparkSession, d: str) -> DataFrame:
    """Fold metrics by era."""
    done = _paper(spark, d)[1].where("status = 'exited'")
    per = done.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_trades"), (F.avg("pnl_bps") / F.stddev_samp("pnl_bps")).alias("sharpe"))
    made = S.across_folds(per.withColumn("era", S.era(F.col("fold_id"))), "era")
    return made.withColumns({c: F.round(c, 9) for c in ("mean_sharpe", "std_sharpe", "mean_nonzero_sharpe")})


@query(f"""
WITH {_SESSIONS}, p AS (SELECT session_id, CAST(coalesce(sum(pnl) FILTER (WHERE CAST(exit_ts AS DATE) = DATE '1997-06-15'), 0) AS DOUBLE) AS pnl_today FROM trades GROUP BY 1)
SELECT *, pnl_today <= -50 AS halt FROM p
""")
def e13_daily_kill(spark: SparkSession, d: str) -> DataFrame:
    """A day's realised result per session, and whether it stops trading."""
    return must_halt(realised_today(_paper(spark, d)[1], F.lit("1997-06-15").cast("date")), 0.5)


@query(f"""
WITH {_SESSIONS}, d AS (SELECT *, CASE WHEN pnl > 0 THEN 1 ELSE 0 END AS win FROM trades WHERE status = 'exited')
SELECT f.fold_id, count(*) AS n_prior, round(avg(win), 9) AS prior_win_rate FROM (SELECT DISTINCT fold_id FROM d) f JOIN d t ON t.fold_id < f.fold_id GROUP BY 1
""")
def f08_prior_folds(spark: SparkSession, d: str) -> DataFrame:
    """Per fold, what the folds before it hold: running sums over fold totals instead of an inequality join."""
    done = _paper(spark, d)[1].where("status = 'exited'")
    per = done.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("pnl_bps") > 0, 1).otherwise(0)).alias("wins"))
    before = Window.orderBy("fold_id").rowsBetween(Window.unboundedPreceding, -1)
    made = per.select("fold_id", F.sum("n").over(before).alias("n_prior"), F.sum("wins").over(before).alias("wins"))
    return made.where("n_prior IS NOT NULL").select("fold_id", "n_prior", F.round(F.col("wins") / F.col("n_prior"), 9).alias("prior_win_rate"))


@query(f"""
WITH {_SESSIONS} SELECT (SELECT count(*) FROM sessions) AS n_sessions, count(*) AS n_trades, count(*) FILTER (WHERE status = 'open') AS n_open, round(avg(pnl) FILTER (WHERE status = 'exited'), 6) AS mean_pnl, max(exit_ts) AS last_exit FROM trades
""")
def e12_kpis(spark: SparkSession, d: str) -> DataFrame:
    """One row of totals: two single-row aggregates side by side."""
    sessions, trades = _paper(spark, d)
    totals = trades.agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(F.col("status") == "open").alias("n_open"),
        F.round(F.avg(F.when(F.col("status") == "exited", F.col("pnl_bps"))), 6).alias("mean_pnl"),
        F.max("exit_ts").alias("last_exit"),
    )
    counted = sessions.agg(F.count(F.lit(1)).alias("n_sessions"))
    return counted.join(F.broadcast(totals), F.lit(True))


@query(f"WITH {_SESSIONS} SELECT t.* EXCLUDE (pnl), CAST(pnl AS DOUBLE) AS pnl_bps FROM trades t WHERE session_id IN (SELECT session_id FROM sessions WHERE name LIKE '%U%')")
def b06_key_membership(spark: SparkSession, d: str) -> DataFrame:
    """Trades of chosen sessions, by semi-join."""
    sessions, trades = _paper(spark, d)
    return trades.join(sessions.where("name LIKE '%U%'"), "session_id", "left_semi")
