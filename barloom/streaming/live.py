"""From ticks to trades as one streaming query: ticks put in order, bars, features, scores, decisions, positions, the daily kill.

Each step keeps its state per symbol (the last one per session) in the state store, so a restart goes on where the
checkpoint ended. What comes out of the steps equals what the batch operators make of the same ticks in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.config import STD_PERIODS
from barloom.functions.indicators import FEATURES, RECURSIVE, Recursive, Smoothed, seasonality
from barloom.operators.backtest import live_decision

from .bars import stream_bars
from .paper import PositionProcessor

_TICKS = "symbol string, agg_id long, ts timestamp, price double, qty double, late boolean"
_HELD = "agg_id long, t long, price double, qty double"


class ReorderProcessor(StatefulProcessor):
    """One symbol's ticks that wait until none before them can come; what comes after its place was passed is late."""

    def __init__(self, delay_us: int, idle_ms: int):
        self.delay, self.idle = delay_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)
        #: all before `passed` has been handed on; the newest time seen
        self.marks = handle.getValueState("marks", "passed long, newest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        passed, newest = self.marks.get() if self.marks.exists() else (-(2**62), -(2**62))
        fresh = pd.concat(list(rows))[["agg_id", "t", "price", "qty"]]
        late = fresh[fresh["t"] < passed]
        held = pd.DataFrame([tuple(x) for x in self.held.get()] if self.held.exists() else [], columns=fresh.columns)
        held = pd.concat([held, fresh[fresh["t"] >= passed]]) if len(held) else fresh[fresh["t"] >= passed]
        newest = max(newest, int(fresh["t"].max()))
        passed = max(passed, newest - self.delay)
        self.marks.update((passed, newest))
        if self.idle:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle)
        yield from self._released(key, held, late, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing has come for a while: what waits goes on."""
        passed, newest = self.marks.get()
        held = pd.DataFrame([tuple(x) for x in self.held.get()] if self.held.exists() else [], columns=["agg_id", "t", "price", "qty"])
        self.marks.update((newest + 1, newest))
        yield from self._released(key, held, held[:0], newest + 1)

    def _released(self, key, held: pd.DataFrame, late: pd.DataFrame, passed: int) -> Iterator[pd.DataFrame]:
        held = held.sort_values(["t", "agg_id"], kind="stable").drop_duplicates(["t", "agg_id"])
        ready, rest = held[held["t"] < passed], held[held["t"] >= passed]
        if len(rest):
            self.held.put([(int(a), int(t), float(p), float(q)) for a, t, p, q in rest.itertuples(index=False)])
        else:
            self.held.clear()
        out = pd.concat([ready.assign(late=False), late.assign(late=True)])
        if len(out):
            made = pd.DataFrame({"symbol": key[0], "agg_id": out["agg_id"], "ts": pd.to_datetime(out["t"], unit="us", utc=True)})
            yield made.assign(price=out["price"], qty=out["qty"], late=out["late"]).reset_index(drop=True)

    def close(self) -> None:
        pass


def reordered(ticks: DataFrame, delay: str = "1 minute", idle: str | None = None) -> DataFrame:
    """A stream of ticks (symbol, agg_id, ts, price, qty) in order of (ts, agg_id) within each symbol, with `late`.

    A tick waits in the state store until its symbol's newest one is more than `delay` after it. One whose time has been passed comes
    out at once, as late: it belongs in a table of its own, not on the tape. Spark's own watermark would drop it unseen, and is one for
    all symbols; this is each symbol's. Repeats of a waiting tick are dropped, of a passed one late. With `idle`,
    a symbol that is silent for so long (in processing time) hands on all that waits.
    """
    delay_us, idle_ms = (int(pd.Timedelta(x or 0) / pd.Timedelta(1, unit)) for x, unit in ((delay, "us"), (idle, "ms")))
    tape = ticks.select("symbol", F.col("agg_id").cast("long"), F.unix_micros("ts").alias("t"), F.col("price").cast("double"), F.col("qty").cast("double"))
    return tape.groupBy("symbol").transformWithStateInPandas(
        ReorderProcessor(delay_us, idle_ms), outputStructType=_TICKS, outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None"
    )


_BARS = ["bar_open_us", "bar_close_us", "high", "low", "close", "volume", "n_trades", "cusum_pos", "cusum_neg"]
_WINDOWED = [f for f in FEATURES if f not in RECURSIVE and not f.startswith(("hour_", "dow_"))]
_MADE = "symbol string, bar_id long, bar_close_ts timestamp, high double, low double, close double, " + ", ".join(f"{f} double" for f in [*RECURSIVE, *_WINDOWED])

#: Bars that the longest window needs before the newest one.
_RING = max(*STD_PERIODS, 21) - 1


def _last(values: np.ndarray, n: int) -> np.ndarray:
    """Rows of the n values up to each one; nan before there are n."""
    padded = np.concatenate([np.full(n - 1, np.nan), values])
    return np.lib.stride_tricks.sliding_window_view(padded, n)


def windowed(bars: pd.DataFrame) -> dict[str, np.ndarray]:
    """The features that look at a window of bars, for every row of a stretch of bars; nan where there are too few."""
    high, low, close, volume = (bars[c].to_numpy(float) for c in ("high", "low", "close", "volume"))

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(b == 0, np.nan, a / np.where(b == 0, 1.0, b))

    out = {f"std_{n}": _last(close, n).std(axis=1, ddof=1) for n in STD_PERIODS}
    middle, spread = _last(close, 5).mean(axis=1), 2 * out["std_5"]
    top, bottom = _last(high, 14).max(axis=1), _last(low, 14).min(axis=1)
    raw = 100 * over(close - bottom, top - bottom)
    k = _last(raw, 3).mean(axis=1)
    flow = np.where(high == low, 0.0, over((close - low) - (high - close), high - low)) * volume
    typical = (high + low + close) / 3
    move = np.diff(typical, prepend=np.nan)
    ups, downs = (np.where(np.isnan(move), np.nan, np.where(sign * move > 0, typical * volume, 0.0)) for sign in (1, -1))
    gain, loss = _last(ups, 14).sum(axis=1), _last(downs, 14).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mfi = np.where(loss > 0, 100 - 100 / (1 + gain / np.where(loss > 0, loss, 1.0)), np.where((loss == 0) & (gain > 0), 100.0, np.nan))
        ret = np.log(close / np.concatenate([[np.nan], close[:-1]]))
    return out | {
        "stoch_k": k,
        "stoch_d": _last(k, 3).mean(axis=1),
        "williams_r": -100 * over(top - close, top - bottom),
        "bb_upper": middle + spread,
        "bb_lower": middle - spread,
        "ret_1": ret,
        "cmf_21": over(_last(flow, 21).sum(axis=1), _last(volume, 21).sum(axis=1)),
        "mfi_14": mfi,
        "bar_duration_sec": (bars["bar_close_us"] - bars["bar_open_us"]).to_numpy() / 1e6,
        "n_trades": bars["n_trades"].to_numpy(float),
        "volume": volume,
        "cusum_pos": bars["cusum_pos"].to_numpy(float),
        "cusum_neg": bars["cusum_neg"].to_numpy(float),
    }


def _smoothers(state: Recursive) -> list[Smoothed]:
    return [*state.emas, state.fast, state.slow, state.signal, *[s for r in state.rsis for s in (r.up, r.down)]]


class FeatureProcessor(StatefulProcessor):
    """One symbol's indicator state: the last bars that windows look at, and every smoothed value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = ", ".join(f"{c} double" for c in _BARS)
        self.ring = handle.getListState("ring", kinds)
        self.smooth = handle.getValueState("smooth", "means array<double>, weights array<double>, firsts array<array<double>>, last double")

    def _restored(self) -> Recursive:
        state = Recursive()
        if self.smooth.exists():
            means, weights, firsts, last = self.smooth.get()
            for s, mean, weight in zip(_smoothers(state), means, weights, strict=True):
                s.mean, s.weight = mean, weight
            for r, first in zip(state.rsis, firsts, strict=True):
                r.first = np.array(first, float)
            state.last = np.array([last])
        return state

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values(["bar_close_us", "bar_id"], kind="stable")
        old = pd.DataFrame([tuple(x) for x in self.ring.get()] if self.ring.exists() else [], columns=_BARS, dtype=float)
        every = pd.concat([old, fresh[_BARS].astype(float)], ignore_index=True) if len(old) else fresh[_BARS].astype(float).reset_index(drop=True)
        state = self._restored()
        smoothed = state.feed(fresh["close"].to_numpy(float))
        out = {"symbol": key[0], "bar_id": fresh["bar_id"].to_numpy(), "bar_close_ts": pd.to_datetime(fresh["bar_close_us"].to_numpy(), unit="us", utc=True)}
        out |= {c: fresh[c].to_numpy(float) for c in ("high", "low", "close")} | dict(zip(RECURSIVE, smoothed, strict=True))
        made = windowed(every)
        out |= {f: made[f][len(old) :] for f in _WINDOWED}
        self.ring.put([tuple(map(float, r)) for r in every.tail(_RING).itertuples(index=False)])
        held = _smoothers(state)
        firsts = [[float(x) for x in r.first] for r in state.rsis]
        self.smooth.update(([float(s.mean) for s in held], [float(s.weight) for s in held], firsts, float(state.last[0])))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def stream_features(bars: DataFrame) -> DataFrame:
    """Of a stream of bars (as stream_bars makes them): symbol, bar_id, bar_close_ts, high, low, close and the FEATURES, missing ones null."""
    rows = bars.select(
        "symbol", F.col("seq").alias("bar_id"), F.unix_micros("bar_open_ts").alias("bar_open_us"), F.unix_micros("bar_close_ts").alias("bar_close_us"),
        "high", "low", "close", "volume", "n_trades", "cusum_pos", "cusum_neg",
    )
    made = rows.groupBy("symbol").transformWithStateInPandas(FeatureProcessor(), outputStructType=_MADE, outputMode="Append", timeMode="None")
    made = made.withColumns(seasonality(F.col("bar_close_ts")))
    filled = [F.when(~F.isnan(f), F.col(f)).alias(f) for f in FEATURES]
    return made.select("symbol", "bar_id", "bar_close_ts", *[F.col(c) for c in ("high", "low", "close")], *filled)


_EVENTS = (
    "session_id long, symbol string, bar_id long, event string, direction int, ts timestamp, price double, reason string, "
    "holding_bars int, pnl_bps_gross double, pnl_bps_net double"
)


class SessionProcessor(StatefulProcessor):
    """A session's open positions in all its symbols, and what it has realised today.

    Positions follow PositionProcessor. Once a day's realised net PnL is at or below -100 * max_loss_pct basis points, signals of that (UTC) day
    are halted; exits go on. A bar's exits count before its own signal is decided.
    """

    def __init__(self, tp: float, sl: float, vertical: int, max_concurrent: int, cost_bps: float, max_loss_pct: float | None):
        self.rules = PositionProcessor(tp, sl, vertical, max_concurrent, cost_bps)
        self.limit = -math.inf if max_loss_pct is None else -100.0 * max_loss_pct

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "symbol string, bar_id long, entry_ts long, entry_price double, direction int, held int")
        self.today = handle.getValueState("today", "day long, pnl double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        open_: dict[str, list[list]] = {}
        for p in self.open.get() if self.open.exists() else ():
            open_.setdefault(p[0], []).append(list(p[1:]))
        day, pnl = self.today.get() if self.today.exists() else (-1, 0.0)
        out: list[tuple] = []
        frame = pd.concat(list(rows)).sort_values(["t", "symbol", "bar_id"], kind="stable")
        for r in frame.itertuples(index=False):
            if r.t // 86_400_000_000 != day:
                day, pnl = int(r.t // 86_400_000_000), 0.0
            done, open_[r.symbol] = self.rules.step(open_.get(r.symbol, []), r, lambda own: pnl + own <= self.limit)  # noqa: B023
            for event in done:
                pnl += event[-1] or 0.0
            out += [(key[0], r.symbol, *event) for event in done]
        kept = [(symbol, *p) for symbol, ps in open_.items() for p in ps]
        if kept:
            self.open.put(kept)
        else:
            self.open.clear()
        self.today.update((day, pnl))
        if out:
            made = pd.DataFrame(out, columns=[f.split()[0] for f in _EVENTS.split(", ")])
            made["ts"] = pd.to_datetime(made["ts"], unit="us", utc=True)
            yield made

    def close(self) -> None:
        pass


def session_events(
    decided: DataFrame, tp: float, sl: float, vertical: int, max_concurrent: int = 1, cost_bps: float = 11.0, max_loss_pct: float | None = None
) -> DataFrame:
    """Entries, exits, passed and halted signals of a stream of decisions (session_id, symbol, bar_id, bar_close_ts, high, low, close, decision, reason)."""
    rows = decided.select("session_id", "symbol", "bar_id", F.unix_micros("bar_close_ts").alias("t"), "high", "low", "close", "decision", "reason")
    return rows.groupBy("session_id").transformWithStateInPandas(
        SessionProcessor(tp, sl, vertical, max_concurrent, cost_bps, max_loss_pct), outputStructType=_EVENTS, outputMode="Append", timeMode="None"
    )


def trading_loop(
    ticks: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    session_id: int,
    threshold: Column,
    bar_threshold: float,
    tp: float,
    sl: float,
    vertical: int,
    delay: str = "1 minute",
    max_hours: float = 168.0,
    max_concurrent: int = 1,
    cost_bps: float = 11.0,
    max_loss_pct: float | None = None,
) -> DataFrame:
    """A stream of a session's entries, exits, passed and halted signals, made of a stream of ticks in any order.

    score: from rows with the FEATURES to the same with p_long, p_short, p_neutral, without Python state (a fitted model). Late ticks are
    left out here; reordered() hands them to whoever keeps them.
    """
    tape = reordered(ticks, delay).where("NOT late").drop("late")
    scored = score(stream_features(stream_bars(tape, bar_threshold, max_hours)))
    decision, reason = live_decision(threshold)
    decided = scored.withColumns({"session_id": F.lit(session_id).cast("long"), "decision": decision, "reason": reason})
    return session_events(decided, tp, sl, vertical, max_concurrent, cost_bps, max_loss_pct)
