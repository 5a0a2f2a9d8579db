"""Row numbers and running sums, maxima and minima of keys of any size, by a two-level scan.

A window function puts a key's rows into one task. Here rows are sorted into ranges by key and order (sampled
splitters, so a large key is many ranges); each range's totals are scanned per key, and every row adds what comes before
its range to what comes before it within the range. A key's scan over ranges has a row for each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.scratch import written

#: Rows of range totals that may be broadcast: keys and ranges, of some tens of bytes each.
BROADCAST_ROWS = 500_000

#: Rows of a partition that monotonically_increasing_id() numbers.
_ID_BITS = 33


def _ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """rows, written in ranges of key and order, with _scan_id, which ascends with both, and _scan_part, their range."""
    ends = [F.col(k) for k in keys] + list(order)
    made = rows.repartitionByRange(*ends).sortWithinPartitions(*ends).withColumn("_scan_id", F.monotonically_increasing_id())
    return written(made, "ranges").withColumn("_scan_part", F.shiftright("_scan_id", _ID_BITS))


def _joined(table: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table with the columns that stand for what comes before each key's ranges; null keys are keys."""
    before = written(before.select(F.struct(*keys, "_scan_part").alias("_scan_key"), *[c for c in before.columns if c.startswith("_before")]), "range-totals")
    if before.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    key = F.struct(*keys, "_scan_part")
    return table.join(before, key.eqNullSafe(F.col("_scan_key")), "left").drop("_scan_key")


def _earlier(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_scan_part").rowsBetween(Window.unboundedPreceding, -1)


def positions(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "n") -> DataFrame:
    """rows with `out`, their number from 1 within their key in this order, as row_number() has it.

    Rows that are equal in key and order are numbered in any order. Nulls in keys are a key; in the order they stand where
    it puts them. Without keys all rows are numbered through. No rows give no rows. One shuffle, by range.
    """
    table = _ranged(rows, keys, order)
    totals = table.groupBy(*keys, "_scan_part").agg(F.count(F.lit(1)).alias("n_rows"), F.min("_scan_id").alias("first_id"))
    # a range's rows of one key are numbered through from its first
    base = F.coalesce(F.sum("n_rows").over(_earlier(keys)), F.lit(0)) - F.col("first_id") + 1
    made = _joined(table, totals.withColumn("_before", base), keys)
    return made.select(*rows.columns, (F.col("_scan_id") + F.col("_before")).alias(out))


def _add(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


_SCANS = {"sum": (F.sum, _add), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def running(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    outs: dict[str, tuple[str, Column]],
    peers: bool = False,
    bucket: Column | None = None,
) -> DataFrame:
    """rows with running values up to each row within its key: outs gives each one's name, kind (sum, max, min) and column.

    bucket: a column that ascends with the order, such as the hour of a time, whose values are the ranges; then nothing is sampled or
    written, a bucket's rows of a key are one task, and a key's buckets are scanned by one. Without it ranges are sampled, and as large
    as each other.

    peers: rows that are equal in the order share the value of the last of them, as a window's default frame has it. Nulls
    are passed over; a running value is null while there are only nulls. Sums of doubles may differ from a window's in
    their last digits, since ranges are summed apart. Keys and no rows are treated as by positions().
    """
    held = {f"_value{i}": column for i, (_, column) in enumerate(outs.values())}
    kinds = [_SCANS[kind] for kind, _ in outs.values()]
    if bucket is None:
        table, last = _ranged(rows.withColumns(held), keys, order), [F.col("_scan_id")]
    else:
        table, last = rows.withColumns(held | {"_scan_part": bucket}), list(order)
    # null keys are keys: structs are equal where their nulls are
    slot = F.struct(*keys, "_scan_part").alias("_slot")
    totals = table.groupBy(*keys, "_scan_part").agg(*[total(v).alias(f"_total{i}") for i, (v, (total, _)) in enumerate(zip(held, kinds, strict=True))])
    before = totals.select(slot, *[total(f"_total{i}").over(_earlier(keys)).alias(f"_before{i}") for i, (total, _) in enumerate(kinds)])
    local = Window.partitionBy("_slot")
    local = local.orderBy(*order) if peers else local.orderBy(*last).rowsBetween(Window.unboundedPreceding, 0)
    within = table.withColumn("_slot", slot).withColumns(
        {f"_own{i}": total(v).over(local) for i, (v, (total, _)) in enumerate(zip(held, kinds, strict=True))}
    )
    # both sides are dealt by their slot already: the rows are not shuffled again
    made = within.join(before, "_slot", "left")
    kept = [c for c in rows.columns if c not in outs]
    return made.select(*kept, *[both(F.col(f"_before{i}"), F.col(f"_own{i}")).alias(n) for i, (n, (_, both)) in enumerate(zip(outs, kinds, strict=True))])
