"""The CUSUM filter as a stream with durable state, and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.bars import Cusum

_OUT = (
    "symbol string, seq long, bar_open_ts timestamp, bar_close_ts timestamp, open double, high double, low double, "
    "close double, volume double, n_trades long, cusum_pos double, cusum_neg double"
)
_STATE = (
    "spos double, sneg double, last double, seq long, t long, open double, high double, low double, volume double, n long"
)


class CusumProcessor(StatefulProcessor):
    """One symbol's filter; a trigger's ticks are put in order of (ts, agg_id) first.

    The age limit is looked at when a tick comes, so there is no timer.
    """

    def __init__(self, threshold: float, max_hours: float):
        self.threshold, self.max_hours = threshold, max_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cusum", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        walk = Cusum(self.threshold, self.max_hours)
        if self.state.exists():
            s = self.state.get()
            walk.spos, walk.sneg, walk.last, walk.seq = s[0], s[1], s[2], s[3]
            walk.bar = None if s[4] is None else [s[4], s[5], s[6], s[7], s[8], s[9]]
        frame = pd.concat(list(rows)).sort_values(["t", "agg_id"], kind="stable")
        bars = walk.feed(*(frame[c].tolist() for c in ("t", "lp", "price", "qty")))
        self.state.update((walk.spos, walk.sneg, walk.last, walk.seq, *(walk.bar or [None] * 6)))
        if bars:
            names = [f.split()[0] for f in _OUT.split(", ")]
            out = pd.DataFrame([(key[0], *b) for b in bars], columns=names)
            for c in ("bar_open_ts", "bar_close_ts"):
                out[c] = pd.to_datetime(out[c], unit="us", utc=True)
            yield out

    def close(self) -> None:
        pass


def stream_bars(ticks: DataFrame, threshold: float, max_hours: float = 168.0, log_price: Column | None = None) -> DataFrame:
    """Bars of a stream of ticks (symbol, agg_id, ts, price, qty), as cusum_bars makes them of a table."""
    tape = ticks.select(
        "symbol",
        F.unix_micros("ts").alias("t"),
        "agg_id",
        (F.ln("price") if log_price is None else log_price.cast("double")).alias("lp"),
        F.col("price").cast("double").alias("price"),
        F.col("qty").cast("double").alias("qty"),
    )
    return tape.groupBy("symbol").transformWithStateInPandas(
        CusumProcessor(threshold, max_hours), outputStructType=_OUT, outputMode="Append", timeMode="None"
    )


def first_arrivals(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream without repeated (symbol, agg_id) within the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "agg_id"])


def counts_per_window(ticks: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Ticks and volume per symbol and tumbling window, once the watermark has passed it."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width))
        .agg(F.count(F.lit(1)).alias("n_ticks"), F.sum("qty").alias("volume"))
        .select("symbol", F.col("window.start").alias("window_start"), "n_ticks", "volume")
    )
