"""Paper trading on a stream of scored bars: decisions, open positions and exits, idempotent by key."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barloom.operators.backtest import live_decision

KEY = ["session_id", "symbol", "bar_id"]


class TradingHalted(RuntimeError):
    """A batch was not decided because trading is halted: it stays with the source, and a restart decides it."""


def decisions(scored: DataFrame, threshold: float, session_id: int) -> DataFrame:
    """A decision per scored bar: session_id, symbol, bar_id, bar_close_ts, probabilities, decision, reason."""
    verdict, reason = live_decision(F.lit(threshold))
    return scored.select(
        F.lit(session_id).cast("long").alias("session_id"),
        "symbol",
        "bar_id",
        "bar_close_ts",
        "p_long",
        "p_short",
        "p_neutral",
        verdict.alias("decision"),
        reason.alias("reason"),
    )


def undecided(scored: DataFrame, done: DataFrame) -> DataFrame:
    """Scored bars that have no decision yet, by key: a restart neither misses nor repeats one."""
    return scored.join(done.select("symbol", "bar_id"), ["symbol", "bar_id"], "left_anti")


def realised_today(trades: DataFrame, now: Column) -> DataFrame:
    """Sum of today's realised PnL per session, 0 without trades."""
    today = F.to_date("exit_ts") == F.to_date(now)
    return trades.groupBy("session_id").agg(F.coalesce(F.sum(F.when(today, F.col("pnl_bps"))), F.lit(0.0)).alias("pnl_today"))


def must_halt(pnl_today: DataFrame, max_loss_pct: float) -> DataFrame:
    return pnl_today.withColumn("halt", F.col("pnl_today") <= -100.0 * max_loss_pct)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None while there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def run(
    scored: DataFrame,
    path: str,
    checkpoint: str,
    threshold: float,
    session_id: int,
    halted: Callable[[SparkSession], bool] = lambda spark: False,
    once: bool = False,
    every: str = "600 seconds",
) -> StreamingQuery:
    """Writes decisions for a stream of scored bars; every batch replaces its own part, so repeats change nothing.

    Bars that the session has decided in other parts are left out, so a new checkpoint doesn't decide them again. Of these
    only the parts from the batch's first day on are read. While trading is halted the query stops with TradingHalted
    and the checkpoint stays where it is.
    """
    own = hashlib.md5(checkpoint.encode(), usedforsecurity=False).hexdigest()[:8]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if halted(spark):
            raise TradingHalted(f"session {session_id}: batch {batch_id} waits")
        part = f"{own}-{batch_id}"
        known, first = _read(spark, path), batch.agg(F.to_date(F.min("bar_close_ts"))).first()[0]
        if known is not None and first is not None:
            done = known.where((F.col("session_id") == session_id) & (F.col("part") != part) & (F.to_date("bar_close_ts") >= F.lit(first)))
            batch = undecided(batch, done)
        made = decisions(batch, threshold, session_id).dropDuplicates(KEY)
        made.withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    writer = scored.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def start_session(session: DataFrame, path: str) -> None:
    """Adds sessions (session_id, name, started_at, ended_at, end_reason, ..) to the table at path; those that it has stay as they are."""
    known = _read(session.sparkSession, path)
    fresh = session if known is None else session.join(known.select("session_id"), "session_id", "left_anti").select(*session.columns)
    fresh.write.mode("append").partitionBy("session_id").parquet(path)


def end_session(spark: SparkSession, path: str, session_id: int, ended_at: Column, reason: str) -> None:
    """Marks a session as ended, once; its partition alone is written anew."""
    own = spark.read.parquet(path).where((F.col("session_id") == session_id) & F.col("ended_at").isNull())
    # one row: read before its file is replaced
    rows = spark.createDataFrame(own.collect(), own.schema)
    ended = rows.withColumns({"ended_at": ended_at.cast(own.schema["ended_at"].dataType), "end_reason": F.lit(reason)})
    ended.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


_OPEN = "bar_id long, entry_ts long, entry_price double, direction int, held int"
_TRADES = (
    "session_id long, symbol string, bar_id long, event string, direction int, ts timestamp, price double, reason string, "
    "holding_bars int, pnl_bps_gross double, pnl_bps_net double"
)


class PositionProcessor(StatefulProcessor):
    """A session's open positions in one symbol: a bar closes those that it decides, after its own signal has found a slot or not.

    As live trading has it, a bar that touches both barriers is a loss, exits are at the barrier's price, and a signal
    that comes while all slots are taken is passed over, although a slot may be freed by the same trigger.
    """

    def __init__(self, tp: float, sl: float, vertical: int, max_concurrent: int, cost_bps: float):
        self.tp, self.sl, self.vertical, self.max_concurrent, self.cost_bps = tp, sl, vertical, max_concurrent, cost_bps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        open_ = [list(p) for p in self.open.get()] if self.open.exists() else []
        out = []
        frame = pd.concat(list(rows)).sort_values(["t", "bar_id"], kind="stable")
        for r in frame.itertuples(index=False):
            done, open_ = self.step(open_, r)
            out += [(*key, *event) for event in done]
        if open_:
            self.open.put([tuple(p) for p in open_])
        else:
            self.open.clear()
        if out:
            made = pd.DataFrame(out, columns=[f.split()[0] for f in _TRADES.split(", ")])
            made["ts"] = pd.to_datetime(made["ts"], unit="us", utc=True)
            yield made

    def step(self, open_: list[list], r, halted: Callable[[float], bool] = lambda own: False) -> tuple[list[tuple], list[list]]:
        """What one bar does: its events (bar_id to pnl_bps_net), and the positions that are open after it.

        halted is asked before a signal is followed, with the net PnL of the bar's own exits.
        """
        done, still = [], []
        for p in open_:
            p[4] += 1
            won, lost = p[2] * (1 + p[3] * self.tp), p[2] * (1 - p[3] * self.sl)
            hit_won, hit_lost = (r.high >= won, r.low <= lost) if p[3] == 1 else (r.low <= won, r.high >= lost)
            price, reason = (lost, "sl") if hit_lost else (won, "tp") if hit_won else (r.close, "timeout") if p[4] >= self.vertical else (None, None)
            if reason is None:
                still.append(p)
                continue
            gross = p[3] * (price / p[2] - 1) * 10_000.0
            done.append((p[0], "exit", p[3], r.t, price, reason, p[4], gross, gross - self.cost_bps))
        if r.decision in ("long", "short"):
            side = 1 if r.decision == "long" else -1
            # a slot that this bar frees is not free for its own signal
            event = "halted" if halted(sum(e[-1] for e in done)) else "entry" if len(open_) < self.max_concurrent else "passed"
            done.append((r.bar_id, event, side, r.t, r.close, r.reason, 0, None, None))
            if event == "entry":
                still.append([r.bar_id, r.t, r.close, side, 0])
        return done, still

    def close(self) -> None:
        pass


def positions(decided: DataFrame, tp: float, sl: float, vertical: int, max_concurrent: int = 1, cost_bps: float = 11.0) -> DataFrame:
    """Entries, exits and passed signals of a stream of decisions with high, low, close: a row for each event."""
    rows = decided.select("session_id", "symbol", "bar_id", F.unix_micros("bar_close_ts").alias("t"), "high", "low", "close", "decision", "reason")
    return rows.groupBy("session_id", "symbol").transformWithStateInPandas(
        PositionProcessor(tp, sl, vertical, max_concurrent, cost_bps), outputStructType=_TRADES, outputMode="Append", timeMode="None"
    )
