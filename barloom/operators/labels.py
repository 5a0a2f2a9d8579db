"""Triple-barrier labels, the live exit walk, and what happens after an exit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import LONG, NEUTRAL, SHORT, UNLABELED
from barloom.functions.indicators import bar_order


def _ahead(w: Window, n: int) -> Column:
    return F.collect_list(F.struct("high", "low", "close", "bar_id", "bar_close_ts")).over(w.rowsBetween(1, n))


def triple_barrier(bars: DataFrame, tp: Column | float, sl: Column | float, vertical: int, keys=("symbol",)) -> DataFrame:
    """Per bar: label, exit_bar_id, exit_reason, holding_bars, exit_price.

    Of the next `vertical` bars the first that touches a barrier decides: both
    in one bar are ambiguous (neutral), the upper alone is long, the lower
    alone short; none is a timeout (neutral) at the last. The exit price is
    the exit bar's close. Bars with fewer bars after them are unlabeled (-1).
    tp, sl: shares of the close, numbers or columns, so that one pass labels for many barriers.
    """
    up = F.col("close") * (1 + (F.lit(tp) if isinstance(tp, float) else tp))
    down = F.col("close") * (1 - (F.lit(sl) if isinstance(sl, float) else sl))
    rows = bars.withColumns({"ahead": _ahead(bar_order(keys), vertical), "up": up, "down": down})
    touches = F.filter(
        F.transform(
            "ahead",
            lambda x, i: F.struct(
                (i + 1).alias("held"), (x["high"] >= F.col("up")).alias("tp"), (x["low"] <= F.col("down")).alias("sl")
            ),
        ),
        lambda t: t["tp"] | t["sl"],
    )
    rows = rows.withColumn("hit", F.get(touches, F.lit(0))).withColumn("known", F.size("ahead") == vertical)
    reason = (
        F.when(~F.col("known"), None)
        .when(F.col("hit").isNull(), "timeout")
        .when(F.col("hit.tp") & F.col("hit.sl"), "ambiguous")
        .when(F.col("hit.tp"), "tp")
        .otherwise("sl")
    )
    held = F.when(F.col("known"), F.coalesce(F.col("hit.held"), F.lit(vertical)))
    rows = rows.withColumns({"exit_reason": reason, "holding_bars": held})
    label = (
        F.when(~F.col("known"), UNLABELED)
        .when(F.col("exit_reason") == "tp", LONG)
        .when(F.col("exit_reason") == "sl", SHORT)
        .otherwise(NEUTRAL)
    )
    at = F.get("ahead", F.col("holding_bars") - 1)
    return rows.withColumns(
        {
            "label": label.cast("int"),
            "exit_bar_id": F.when(F.col("known"), at["bar_id"]),
            "exit_ts": F.when(F.col("known"), at["bar_close_ts"]),
            "exit_price": F.when(F.col("known"), at["close"]),
        }
    ).drop("ahead", "up", "down", "hit", "known")


def touched_after(bars: DataFrame, labels: DataFrame, tp: float, sl: float, vertical: int, keys=("symbol",)) -> DataFrame:
    """labels with later_touch: after a tp exit, was the lower barrier reached before the vertical one; and the mirror."""
    rows = labels.withColumn("ahead", _ahead(bar_order(keys), vertical))
    rest = F.slice("ahead", F.col("holding_bars") + 1, F.greatest(F.lit(vertical) - F.col("holding_bars"), F.lit(0)))
    up, down = F.col("close") * (1 + tp), F.col("close") * (1 - sl)
    later = F.when(F.col("exit_reason") == "tp", F.exists(rest, lambda x: x["low"] <= down)).when(
        F.col("exit_reason") == "sl", F.exists(rest, lambda x: x["high"] >= up)
    )
    return rows.withColumn("later_touch", F.coalesce(later, F.lit(False))).drop("ahead")


def live_exits(entries: DataFrame, bars: DataFrame, tp: float, sl: float, vertical: int) -> DataFrame:
    """Open positions (symbol, bar_id, direction) with the exit that live trading makes, at the barrier's price.

    A bar that touches both barriers is taken as the loss. Positions that neither
    touched nor aged stay open (null reason).
    """
    w = bar_order()
    known = bars.withColumn("ahead", _ahead(w, vertical)).select("symbol", "bar_id", "close", "ahead")
    rows = entries.join(known, ["symbol", "bar_id"])
    long_ = F.col("direction") == 1
    win = F.when(long_, F.col("close") * (1 + tp)).otherwise(F.col("close") * (1 - tp))
    lose = F.when(long_, F.col("close") * (1 - sl)).otherwise(F.col("close") * (1 + sl))
    rows = rows.withColumns({"win_price": win, "lose_price": lose})

    def touch(x: Column, i: Column) -> Column:
        won = F.when(long_, x["high"] >= F.col("win_price")).otherwise(x["low"] <= F.col("win_price"))
        lost = F.when(long_, x["low"] <= F.col("lose_price")).otherwise(x["high"] >= F.col("lose_price"))
        return F.struct((i + 1).alias("held"), won.alias("won"), lost.alias("lost"))

    hits = F.filter(F.transform("ahead", touch), lambda t: t["won"] | t["lost"])
    rows = rows.withColumn("hit", F.get(hits, F.lit(0)))
    aged = F.size("ahead") == vertical
    reason = (
        F.when(F.col("hit.lost"), "sl").when(F.col("hit.won"), "tp").when(aged, "timeout")
    )
    rows = rows.withColumn("exit_reason", reason)
    held = F.coalesce(F.col("hit.held"), F.when(aged, F.lit(vertical)))
    price = (
        F.when(F.col("exit_reason") == "sl", F.col("lose_price"))
        .when(F.col("exit_reason") == "tp", F.col("win_price"))
        .when(aged, F.get("ahead", F.lit(vertical - 1))["close"])
    )
    return rows.select("symbol", "bar_id", "direction", "exit_reason", held.alias("holding_bars"), price.alias("exit_price"))
