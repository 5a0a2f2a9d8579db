"""As-of and interval joins without inequality joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_self(value: str, back: str, ts: str = "ts", tie: str = "bar_id", by: tuple[str, ...] = ("symbol",)) -> Column:
    """value of the last row at or before this row's ts less an interval (such as '4 hours'), or null.

    A range frame over the ordered rows: one sort per key, and no join.
    """
    order = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(ts).cast("timestamp")))
    reach = order.rangeBetween(Window.unboundedPreceding, -_micros(back))
    return F.max(F.struct(F.col(ts), F.col(tie), F.col(value).alias("v"))).over(reach)["v"]


def _micros(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"hour": 3600, "day": 86400, "minute": 60}[unit.rstrip("s")] * 1_000_000


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], ts: str, values: list[str]) -> DataFrame:
    """left with `values` of the last right row of the same key at or before its ts (rows must have both by and ts)."""
    marks = F.struct(*[F.col(v) for v in values])
    both = left.withColumn("side", F.lit(1)).unionByName(
        right.select(*by, ts, marks.alias("found")).withColumn("side", F.lit(0)), allowMissingColumns=True
    )
    order = Window.partitionBy(*by).orderBy(ts, "side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("last", F.last("found", ignorenulls=True).over(order)).where("side = 1")
    return out.select(*left.columns, *[F.col("last")[v].alias(v) for v in values])


def assign_to_bars(ticks: DataFrame, bars: DataFrame, bucket_hours: float = 24.0) -> DataFrame:
    """Ticks with the bar (bar_id) of their symbol that closes first at or after them.

    Ticks at or before a symbol's first open, and after its last close, are left
    out. A tick at a close belongs to the bar that closes then, the first of
    several. Ticks and closes are sorted together, so there is no inequality join.

    Time is cut into buckets, and each bucket of a symbol is a group of its own, with its closes and the first one after it,
    which is all that its ticks can need. So one symbol's ticks are as many tasks as it has buckets. What one
    task sees of a whole symbol are its bars and its buckets.
    """
    width = int(bucket_hours * 3_600_000_000)

    def bucket(ts: str) -> Column:
        return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / width).alias("bucket")

    opens = bars.groupBy("symbol").agg(F.min("bar_open_ts").alias("first_open"))
    closes = bars.select("symbol", F.col("bar_close_ts").alias("ts"), "bar_id", bucket("bar_close_ts"))
    # each bucket that has ticks, as a mark before its closes: the first close of a later bucket stands behind its last
    marks = ticks.select("symbol", bucket("ts")).distinct().select("symbol", F.lit(None).cast(closes.schema["ts"].dataType).alias("ts"), F.lit(None).cast(closes.schema["bar_id"].dataType).alias("bar_id"), "bucket")
    back = Window.partitionBy("symbol").orderBy(F.desc("bucket"))
    # of equal closes the first bar counts
    first = F.struct("ts", "bar_id")
    firsts = marks.unionByName(closes).groupBy("symbol", "bucket").agg(F.min(F.when(F.col("ts").isNotNull(), first)).alias("first"))
    later = firsts.select("symbol", "bucket", F.last("first", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("next"))
    later = later.where("next IS NOT NULL").select("symbol", "next.ts", "next.bar_id", "bucket")
    known = closes.unionByName(later).withColumn("is_bar", F.lit(1))
    tape = ticks.withColumn("bucket", bucket("ts")).withColumn("is_bar", F.lit(0)).unionByName(known, allowMissingColumns=True)
    # backwards in time: the frame grows row by row, where one that looks ahead would be read anew for every row
    group = Window.partitionBy("symbol", "bucket").orderBy(F.desc("ts"), F.desc("is_bar"), F.desc("bar_id"))
    nearest = F.last("bar_id", ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, 0))
    assigned = tape.withColumn("bar_id", nearest).where("is_bar = 0")
    return assigned.where("bar_id IS NOT NULL").join(opens, "symbol").where("ts > first_open").drop("is_bar", "first_open", "bucket")
