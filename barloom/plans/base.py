"""The inputs that the registered queries share, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import count_bars
from barloom.operators.scan import running

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The registered queries' CUSUM threshold: 2 % in units of 1/500000 of a log price.
THRESHOLD = 10_000


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """A tape of four symbols from the events; lp is an exact log price in units of 1/500000."""
    return _numbered(spark, d).drop("n")


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """ticks(), with each one's place in its symbol."""
    step = F.round(F.col("value") * 100).cast("bigint") - 5000
    tape = events(spark, d).select(
        F.col("event_id").alias("agg_id"),
        "ts",
        F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("symbol"),
        step.alias("lp"),
        ((F.get_json_object("props", "$.k").cast("int") + 1) / F.lit(10.0)).cast("double").alias("qty"),
        F.col("event_type").isin("view", "error").alias("is_buyer_maker"),
    )
    sums = {"lp": ("sum", F.col("lp")), "n": ("sum", F.lit(1))}
    made = running(tape, ["symbol"], [F.col("ts"), F.col("agg_id")], sums, bucket=F.date_trunc("hour", "ts"))
    return made.select("agg_id", "ts", "symbol", "lp", "qty", "is_buyer_maker", (100 * F.exp(F.col("lp") / 500000.0)).alias("price"), "n")


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of five ticks."""
    return count_bars(_numbered(spark, d), 5, F.col("n"))


def days(spark: SparkSession, d: str) -> DataFrame:
    """One bar per day from the orders."""
    return (
        spark.read.parquet(f"{d}/orders.parquet")
        .groupBy(F.to_date("o_orderdate").alias("d"))
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count(F.lit(1)).alias("n_trades"),
            F.sum("o_totalprice").alias("volume"),
        )
    )


def predicted(rows: DataFrame) -> DataFrame:
    """rows with probabilities made from their keys."""
    k = (F.col("bar_id") * 37 + F.substring("symbol", 2, 1).cast("bigint") * 17) % 101
    return rows.withColumns({"p_long": k / 125.0, "p_short": (100 - k) / 125.0, "p_neutral": F.lit(0.2)})


def r6(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


TICKS = """ticks AS (
  SELECT event_id AS agg_id, ts, 'S' || CAST(user_id % 4 AS VARCHAR) AS symbol,
         CAST(sum(CAST(round(value * 100) AS BIGINT) - 5000)
              OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lp,
         CAST((CAST(json_extract_string(props, '$.k') AS INTEGER) + 1) / 10.0 AS DOUBLE) AS qty,
         event_type IN ('view', 'error') AS is_buyer_maker
  FROM events
), t AS (
  SELECT *, 100 * exp(lp / 500000.0) AS price, row_number() OVER (PARTITION BY symbol ORDER BY ts, agg_id) AS n FROM ticks
)"""

BARS = TICKS + """, bars AS (
  SELECT symbol, CAST((n - 1) // 5 AS BIGINT) AS bar_id, min(ts) AS bar_open_ts, max(ts) AS bar_close_ts,
         arg_min(price, n) AS open, max(price) AS high, min(price) AS low, arg_max(price, n) AS close,
         sum(qty) AS volume, count(*) AS n_trades
  FROM t GROUP BY symbol, (n - 1) // 5 HAVING count(*) = 5
)"""

CUSUM = TICKS + f""", walk AS (
  SELECT symbol, n, lp, CAST(0 AS BIGINT) AS sp, CAST(0 AS BIGINT) AS sn, CAST(0 AS BIGINT) AS seq, ts AS opened, false AS closed
  FROM t WHERE n = 1
  UNION ALL
  SELECT symbol, n, lp, sp, sn, seq, opened,
         sp >= {THRESHOLD} OR -sn >= {THRESHOLD} OR epoch_us(ts) - epoch_us(opened) >= 604800000000
  FROM (
    SELECT t.symbol, t.n, t.lp, t.ts,
           greatest(0, CASE WHEN w.closed THEN 0 ELSE w.sp END + t.lp - w.lp) AS sp,
           least(0, CASE WHEN w.closed THEN 0 ELSE w.sn END + t.lp - w.lp) AS sn,
           CASE WHEN w.closed THEN w.seq + 1 ELSE w.seq END AS seq,
           CASE WHEN w.closed THEN t.ts ELSE w.opened END AS opened
    FROM walk w JOIN t ON t.symbol = w.symbol AND t.n = w.n + 1
  )
), cbars AS (
  SELECT w.symbol, w.seq, min(t.ts) AS bar_open_ts, max(t.ts) AS bar_close_ts,
         CAST(arg_min(t.lp, t.n) AS DOUBLE) AS open, CAST(max(t.lp) AS DOUBLE) AS high, CAST(min(t.lp) AS DOUBLE) AS low,
         CAST(arg_max(t.lp, t.n) AS DOUBLE) AS close, sum(t.qty) AS volume, count(*) AS n_trades,
         CAST(arg_max(w.sp, w.n) AS DOUBLE) AS cusum_pos, CAST(arg_max(w.sn, w.n) AS DOUBLE) AS cusum_neg
  FROM walk w JOIN t ON t.symbol = w.symbol AND t.n = w.n GROUP BY w.symbol, w.seq HAVING bool_or(w.closed)
)"""

DAYS = """days AS (
  SELECT CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS n_trades,
         sum(o_totalprice) AS volume
  FROM orders GROUP BY 1
)"""

PRED = """pred AS (
  SELECT *, ((bar_id * 37 + CAST(substr(symbol, 2, 1) AS BIGINT) * 17) % 101) / 125.0 AS p_long,
         (100 - (bar_id * 37 + CAST(substr(symbol, 2, 1) AS BIGINT) * 17) % 101) / 125.0 AS p_short, 0.2 AS p_neutral
  FROM bars
)"""


def labels_sql(tp: str, sl: str, vertical: int, bars: str = "bars", keys: str = "symbol") -> str:
    """Triple-barrier labels of `bars` (with row number k) as CTE "labels", by a self-join over the bars ahead."""
    return f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY bar_close_ts, bar_id) AS k,
         count(*) OVER (PARTITION BY {keys}) AS n_all FROM {bars}
), touched AS (
  SELECT a.symbol, a.bar_id, min(b.k - a.k) AS held
  FROM numbered a JOIN numbered b ON a.symbol = b.symbol AND b.k > a.k AND b.k <= a.k + {vertical}
  WHERE b.high >= a.close * (1 + {tp}) OR b.low <= a.close * (1 - {sl})
  GROUP BY 1, 2
), labels AS (
  SELECT a.symbol, a.bar_id, a.bar_close_ts, a.close, x.bar_id AS exit_bar_id, x.bar_close_ts AS exit_ts, x.close AS exit_price,
         CASE WHEN a.k + {vertical} > a.n_all THEN NULL ELSE coalesce(h.held, {vertical}) END AS holding_bars,
         CASE WHEN a.k + {vertical} > a.n_all THEN NULL WHEN h.held IS NULL THEN 'timeout'
              WHEN x.high >= a.close * (1 + {tp}) AND x.low <= a.close * (1 - {sl}) THEN 'ambiguous'
              WHEN x.high >= a.close * (1 + {tp}) THEN 'tp' ELSE 'sl' END AS exit_reason
  FROM numbered a LEFT JOIN touched h USING (symbol, bar_id)
  LEFT JOIN numbered x ON x.symbol = a.symbol AND x.k = a.k + coalesce(h.held, {vertical}) AND a.k + {vertical} <= a.n_all
)"""


LABEL_NUMBER = "CASE WHEN exit_reason IS NULL THEN -1 WHEN exit_reason = 'tp' THEN 0 WHEN exit_reason = 'sl' THEN 1 ELSE 2 END"
