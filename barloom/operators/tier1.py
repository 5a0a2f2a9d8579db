"""Further features: time since events, higher time frames, volatility rank, pivots, and the day and week around a bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.indicators import bar_order, bars_since, log_return, percentile_rank, rolling

from .asof import asof_self


def event_columns(w: Window) -> dict[str, Column]:
    """Six events over rows with rsi_14, macd_line, macd_signal, ema_50, close, volume and row number n."""
    side = F.signum(F.col("macd_line") - F.col("macd_signal"))
    typical = F.percentile("volume", 0.5).over(w.rowsBetween(-49, 0))
    return {
        "rsi_high": F.coalesce(F.col("rsi_14") > 70, F.lit(False)),
        "rsi_low": F.coalesce(F.col("rsi_14") < 30, F.lit(False)),
        "macd_cross": F.coalesce(side != F.lag(side).over(w), F.lit(False)),
        "volume_spike": F.col("volume") > 3 * typical,
        "above_ema": F.col("close") > F.col("ema_50"),
        "below_ema": F.col("close") < F.col("ema_50"),
    }


def since_events(rows: DataFrame) -> DataFrame:
    """rows with bars_since_<event> for each of the six events."""
    w = bar_order()
    marked = rows.withColumn("n", F.row_number().over(w)).withColumns(event_columns(w))
    names = list(event_columns(w))
    return marked.withColumns({f"bars_since_{e}": bars_since(F.col(e), F.col("n"), w) for e in names}).drop("n", *names)


def higher_frames(rows: DataFrame) -> DataFrame:
    """Log returns against the last bar 4 hours, 1 day and 5 days back."""
    return rows.withColumns(
        {
            f"htf_{name}": F.ln(F.col("close") / asof_self("close", back, "bar_close_ts"))
            for name, back in (("4h", "4 hours"), ("1d", "1 day"), ("5d", "5 days"))
        }
    )


def atr_rank(rows: DataFrame, n: int = 14, rank_over: int = 100) -> DataFrame:
    w = bar_order()
    made = rows.withColumn("atr", rolling(F.avg, F.col("high") - F.col("low"), w, n))
    return made.withColumn("atr_rank", F.when(F.col("atr").isNotNull(), percentile_rank(F.col("atr"), w, rank_over)))


def daily_levels(bars: DataFrame) -> DataFrame:
    """Per symbol and day that has bars: high, low, last close, and the pivot levels they give."""
    last = F.struct("bar_close_ts", "bar_id")
    days = bars.groupBy("symbol", F.to_date("bar_close_ts").alias("day")).agg(
        F.max("high").alias("day_high"), F.min("low").alias("day_low"), F.max_by("close", last).alias("day_close")
    )
    pivot = (F.col("day_high") + F.col("day_low") + F.col("day_close")) / 3
    span = F.col("day_high") - F.col("day_low")
    return days.withColumns(
        {
            "pivot": pivot,
            "r1": 2 * pivot - F.col("day_low"),
            "s1": 2 * pivot - F.col("day_high"),
            "fib": F.col("day_low") + 0.618 * span,
        }
    )


def pivot_distances(bars: DataFrame) -> DataFrame:
    """bars with log distances from the pivot levels of the day before that had bars."""
    levels = ("pivot", "r1", "s1", "fib")
    w = Window.partitionBy("symbol").orderBy("day")
    before = daily_levels(bars).select("symbol", "day", *[F.lag(x).over(w).alias(x) for x in levels])
    joined = bars.withColumn("day", F.to_date("bar_close_ts")).join(before, ["symbol", "day"], "left")
    return joined.withColumns({f"dist_{x}": F.ln(F.col("close") / F.col(x)) for x in levels}).drop("day", *levels)


def day_return(bars: DataFrame) -> DataFrame:
    """bars with close over the last close of an earlier day, less one; null on a symbol's first day."""
    day = F.unix_date(F.to_date("bar_close_ts"))
    earlier = Window.partitionBy("symbol").orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.struct("bar_close_ts", "bar_id", "close")).over(earlier)["close"]
    return bars.withColumn("daily_ret_pct", F.col("close") / last - 1)


def week_position(bars: DataFrame, peers: bool = False) -> DataFrame:
    """bars with the close's place within the low and high of the last seven days; 0.5 in a flat week.

    Of rows of the same time, those up to this one count, in order of bar_id; with peers all of them, as in SQL's range frame.

    A frame of time that moves with the row would be read anew for every row. Time is cut into hours instead: a row's week is the end of the
    hour seven days back, the hours between, whose highest and lowest are few, and its own hour up to it. Each symbol's hour is a group of its
    own, with the rows of the hour seven days back; one task sees only a symbol's hours.
    """
    hour, week = 3_600_000_000, 7 * 86_400_000_000
    at = F.unix_micros(F.col("bar_close_ts").cast("timestamp"))
    rows = bars.withColumn("_at", at).withColumn("_hour", F.col("_at") - F.pmod("_at", F.lit(hour)))
    # null symbols and times are keys: structs are equal where their nulls are
    slot = F.struct("symbol", "_hour").alias("_slot")
    back = rows.select((F.col("_at") + week).alias("_at"), F.struct("symbol", (F.col("_hour") + week).alias("_hour")).alias("_slot"), F.col("high").alias("_old_high"), F.col("low").alias("_old_low"))
    both = rows.select(*bars.columns, "_at", slot).withColumn("_own", F.lit(True)).unionByName(back, allowMissingColumns=True)
    # the hour's rows up to this one; those of the hour a week before from a week before this one on
    group = Window.partitionBy("_slot")
    early = group.orderBy("_at") if peers else group.orderBy("_at", "bar_id").rowsBetween(Window.unboundedPreceding, 0)
    late = group.orderBy(F.desc("_at"))
    parts = both.withColumns(
        {
            "_high": F.max("high").over(early),
            "_low": F.min("low").over(early),
            "_old_high": F.max("_old_high").over(late),
            "_old_low": F.min("_old_low").over(late),
        }
    ).where("_own")
    between = Window.partitionBy("symbol").orderBy("_hour").rangeBetween(hour - week, -hour)
    hours = rows.groupBy("symbol", "_hour").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    hours = hours.select(slot, F.max("high").over(between).alias("_hours_high"), F.min("low").over(between).alias("_hours_low"))
    made = parts.join(hours, "_slot", "left")
    top, bottom = F.greatest("_old_high", "_hours_high", "_high"), F.least("_old_low", "_hours_low", "_low")
    spot = (F.col("close") - bottom) / (top - bottom)
    place = F.when(top == bottom, 0.5).otherwise(F.least(F.greatest(spot, F.lit(0.0)), F.lit(1.0)))
    return made.select(*bars.columns, place.alias("weekly_range_pos"))


def regime_ratio(bars: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    """bars with the volatility of `short` returns over its median of the last `long`."""
    w = bar_order()
    step = bars.withColumn("ret", log_return(F.col("close"), w))
    step = step.withColumn("vol", rolling(F.stddev_samp, F.col("ret"), w, short))
    # sorted lists: a percentile counts values in a map for every row, which takes several times as long
    last = F.sort_array(F.collect_list("vol").over(w.rowsBetween(-(long - 1), 0)))
    median = F.when(F.size(last) == long, (F.element_at(last, (long + 1) // 2) + F.element_at(last, long // 2 + 1)) / 2)
    return step.withColumn("regime_vol_ratio", F.try_divide(F.col("vol"), median)).drop("ret", "vol")
