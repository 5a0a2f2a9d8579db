"""Indicator columns over bars.

What is a frame of rows is a native window expression. What is a recursion over
all rows (exponential and Wilder smoothing) is made by one function over Arrow
batches of each key's sorted rows, all of its columns in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.config import EMA_PERIODS, RSI_PERIODS, STD_PERIODS

from .streams import runs, streamed


def bar_order(keys: Sequence[str] = ("symbol",)) -> Window:
    return Window.partitionBy(*keys).orderBy("bar_close_ts", "bar_id")


def full(value: Column, counted: Column, frame: Window, n: int) -> Column:
    """value where the frame has n rows that are not null, else null."""
    return F.when(F.count(counted).over(frame) == n, value)


def rolling(agg, x: Column, w: Window, n: int) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return full(agg(x).over(frame), x, frame, n)


def log_return(x: Column, w: Window, lag: int = 1) -> Column:
    return F.ln(x / F.lag(x, lag).over(w))


def bollinger(c: Column, w: Window, n: int = 5, width: float = 2.0) -> tuple[Column, Column]:
    mid, dev = rolling(F.avg, c, w, n), rolling(F.stddev_samp, c, w, n)
    return mid + width * dev, mid - width * dev


def williams_r(h: Column, low: Column, c: Column, w: Window, n: int = 14) -> Column:
    top, bottom = rolling(F.max, h, w, n), rolling(F.min, low, w, n)
    return -100 * F.try_divide(top - c, top - bottom)


def stochastic_raw(h: Column, low: Column, c: Column, w: Window, n: int = 14) -> Column:
    top, bottom = rolling(F.max, h, w, n), rolling(F.min, low, w, n)
    return 100 * F.try_divide(c - bottom, top - bottom)


def cmf(h: Column, low: Column, c: Column, v: Column, w: Window, n: int = 21) -> Column:
    multiplier = F.when(h == low, 0.0).otherwise(((c - low) - (h - c)) / (h - low))
    return F.try_divide(rolling(F.sum, multiplier * v, w, n), rolling(F.sum, v, w, n))


def money_flow(h: Column, low: Column, c: Column, v: Column) -> tuple[Column, Column]:
    typical = (h + low + c) / 3
    return typical, typical * v


def mfi(typical: Column, before: Column, flow: Column, w: Window, n: int = 14) -> Column:
    """typical, its predecessor and flow must be columns of the input."""
    up = F.when(before.isNull(), None).when(typical > before, flow).otherwise(0.0)
    down = F.when(before.isNull(), None).when(typical < before, flow).otherwise(0.0)
    gain, loss = rolling(F.sum, up, w, n), rolling(F.sum, down, w, n)
    return F.when(loss > 0, 100 - 100 / (1 + gain / loss)).when((loss == 0) & (gain > 0), 100.0)


def percentile_rank(x: Column, w: Window, n: int = 100) -> Column:
    """Average rank of the row's value among the last n, over n; null until there are n."""
    frame = F.collect_list(x).over(w.rowsBetween(-(n - 1), 0))
    below = F.size(F.filter(frame, lambda y: y < x))
    same = F.size(F.filter(frame, lambda y: y == x))
    return F.when(F.size(frame) == n, (below + (same + 1) / 2) / n)


def bars_since(event: Column, number: Column, w: Window) -> Column:
    """Rows since the event was last true, 0 at it; null before the first. number: the row's number, a column."""
    return number - F.last(F.when(event, number), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def seasonality(ts: Column) -> dict[str, Column]:
    hour, day = F.hour(ts), F.weekday(ts)
    turn = 2 * np.pi
    return {
        "hour_sin": F.sin(turn * hour / 24),
        "hour_cos": F.cos(turn * hour / 24),
        "dow_sin": F.sin(turn * day / 7),
        "dow_cos": F.cos(turn * day / 7),
    }


class Smoothed:
    """An exponential mean, fed part by part; weights decay through missing values, as pandas has it by default."""

    def __init__(self, alpha: float):
        self.alpha, self.mean, self.weight = alpha, math.nan, 1.0

    def feed(self, values: np.ndarray) -> np.ndarray:
        alpha, rest, mean, weight = self.alpha, 1 - self.alpha, self.mean, self.weight
        out = []
        for x in values.tolist():
            if mean == mean:
                weight *= rest
                if x == x:
                    if mean != x:
                        mean = (weight * mean + alpha * x) / (weight + alpha)
                    weight = 1.0
            elif x == x:
                mean = x
            out.append(mean)
        self.mean, self.weight = mean, weight
        return np.array(out, float)


class WilderRsi:
    """Relative strength with Wilder's smoothing, seeded with the mean of the first n moves; fed moves part by part, nan for the first n - 1."""

    def __init__(self, n: int):
        self.n, self.first = n, np.empty(0)
        self.up, self.down = Smoothed(1 / n), Smoothed(1 / n)

    def feed(self, move: np.ndarray) -> np.ndarray:
        out = np.full(len(move), np.nan)
        lacking = self.n - len(self.first)
        self.first = np.append(self.first, move[:lacking])
        if not len(move) or len(self.first) < self.n:
            return out
        gain, loss = ([np.maximum(sign * m, 0) for m in (self.first, move[lacking:])] for sign in (1, -1))
        seed = lacking > 0
        up, down = (s.feed(np.append(x[0].mean(), x[1]) if seed else x[1]) for s, x in ((self.up, gain), (self.down, loss)))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[lacking - seed :] = np.where(down > 0, 100 - 100 / (1 + up / down), np.where(up > 0, 100.0, np.nan))
        return out


def wilder_rsi(close: np.ndarray, n: int) -> np.ndarray:
    """Relative strength of a whole series; nan for the first n rows."""
    return np.append(np.full(min(len(close), 1), np.nan), WilderRsi(n).feed(np.diff(close)))


class Recursive:
    """One key's state: the last close and every smoothed value."""

    def __init__(self):
        def spans(*ns: int) -> list[Smoothed]:
            return [Smoothed(2 / (n + 1)) for n in ns]

        self.emas, (self.fast, self.slow, self.signal) = spans(*EMA_PERIODS), spans(12, 26, 9)
        self.rsis = [WilderRsi(n) for n in RSI_PERIODS]
        self.last: np.ndarray | None = None

    def feed(self, close: np.ndarray) -> list[np.ndarray]:
        """RECURSIVE of the next closes."""
        line = self.fast.feed(close) - self.slow.feed(close)
        signal = self.signal.feed(line)
        fresh = self.last is None
        move = np.diff(close if fresh else np.append(self.last, close))
        self.last = close[-1:]
        rsis = [np.append(np.full(int(fresh), np.nan), r.feed(move)) for r in self.rsis]
        return [*[e.feed(close) for e in self.emas], line, signal, line - signal, *rsis]


RECURSIVE = [f"ema_{n}" for n in EMA_PERIODS] + ["macd_line", "macd_signal", "macd_hist"] + [f"rsi_{n}" for n in RSI_PERIODS]


def with_recursive(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """bars with RECURSIVE columns; a key's bars stream through one task, batch by batch. Missing is null, never nan."""
    keys = list(keys)
    order = [F.col(c).asc_nulls_last() for c in ("bar_close_ts", "bar_id")]

    def walk(batches):
        key, state = None, Recursive()
        for batch in batches:
            if not batch.num_rows:
                continue
            close = batch.column("close").cast(pa.float64()).to_numpy(zero_copy_only=False)
            parts = []
            for own, begin, end in runs(batch, keys):
                if own != key:
                    key, state = own, Recursive()
                parts.append(state.feed(close[begin:end]))
            made = [pa.array(np.concatenate(x), from_pandas=True) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *RECURSIVE])

    kinds = StructType([*bars.schema.fields, *[StructField(c, DoubleType()) for c in RECURSIVE]])
    return streamed(bars, keys, order).mapInArrow(walk, kinds)


def with_decayed(rows: DataFrame, value: str, outs: dict[str, tuple[int, int]], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """rows with exponential means of `value`: outs gives each one's span, and how many values it needs before it is not null.

    Weights decay through missing values, at which a mean stays as it is. A key's rows stream through one task, of which only the keys,
    the order and the value pass through Python.
    """
    keys = list(keys)
    order = ["bar_close_ts", "bar_id"]
    own = rows.select(*keys, *order, F.col(value).cast("double").alias("_x"))

    def walk(batches):
        key, state = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("_x").to_numpy(zero_copy_only=False)
            parts = []
            for this, begin, end in runs(batch, keys):
                if this != key:
                    key, state = this, [[Smoothed(2 / (span + 1)), 0, least] for span, least in outs.values()]
                x = values[begin:end]
                made = []
                for s in state:
                    seen = s[1] + np.cumsum(~np.isnan(x))
                    made.append(np.where(seen >= s[2], s[0].feed(x), np.nan))
                    s[1] = int(seen[-1])
                parts.append(made)
            columns = [pa.array(np.concatenate(x), from_pandas=True) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keys, *order]), *columns], names=[*keys, *order, *outs])

    fields = [*own.select(*keys, *order).schema.fields, *[StructField(c, DoubleType()) for c in outs]]
    made = streamed(own, keys, [F.col(c).asc_nulls_last() for c in order]).mapInArrow(walk, StructType(fields))
    same = [rows[c].eqNullSafe(made[c]) for c in [*keys, *order]]
    return rows.join(made, reduce(lambda a, b: a & b, same), "left").select(*[rows[c] for c in rows.columns], *[made[c] for c in outs])


def decayed_mean(values: pd.Series, span: int, least: int) -> pd.Series:
    """Exponential mean whose weights decay through missing values, null until there are `least` values."""
    return values.ewm(span=span, adjust=False, min_periods=least).mean()


#: The feature columns in contract order; fixed values.
FEATURES = (
    """
    ema_5 ema_10 ema_15 ema_20 ema_50 std_5 std_10 std_15 std_20 std_50 macd_line macd_signal macd_hist rsi_6 rsi_10 rsi_14
    stoch_k stoch_d williams_r bb_upper bb_lower ret_1 cmf_21 mfi_14 hour_sin hour_cos dow_sin dow_cos bar_duration_sec
    n_trades volume cusum_pos cusum_neg
    """.split()
)


def build_features(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The feature matrix: keys, bar_id, bar_close_ts and the FEATURES, all double, in contract order."""
    w = bar_order(keys)
    h, low, c, v = (F.col(x).cast("double") for x in ("high", "low", "close", "volume"))
    typical, flow = money_flow(h, low, c, v)
    smooth = with_recursive(bars, keys)
    step = smooth.withColumns(
        {f"std_{n}": rolling(F.stddev_samp, c, w, n) for n in STD_PERIODS}
        | {"stoch_raw": stochastic_raw(h, low, c, w), "williams_r": williams_r(h, low, c, w)}
        | {"bb_upper": bollinger(c, w)[0], "bb_lower": bollinger(c, w)[1]}
        | {"ret_1": log_return(c, w), "cmf_21": cmf(h, low, c, v, w)}
        | {"typical": typical, "typical_before": F.lag(typical).over(w), "flow": flow}
    )
    step = step.withColumns(
        {
            "stoch_k": rolling(F.avg, F.col("stoch_raw"), w, 3),
            "mfi_14": mfi(F.col("typical"), F.col("typical_before"), F.col("flow"), w),
            "bar_duration_sec": F.timestamp_diff("MICROSECOND", F.col("bar_open_ts"), F.col("bar_close_ts")) / 1e6,
        }
        | seasonality(F.col("bar_close_ts"))
    )
    step = step.withColumn("stoch_d", rolling(F.avg, F.col("stoch_k"), w, 3))
    return step.select(*keys, "bar_id", "bar_close_ts", *[F.col(x).cast("double").alias(x) for x in FEATURES])
