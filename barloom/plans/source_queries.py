"""Registered queries over sources: published archives, catching up with them, and records pulled by ids."""

from __future__ import annotations

from datetime import date

import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.ticks import epoch_to_timestamp
from barloom.sources import archive, published
from barloom.sources.pull import FIELDS, PullSource
from barloom.sources.runs import RunStore, backfill_runs, run_id
from barloom.sources.scratch import folder, written
from barloom.sources.tables import write_ticks

from .base import TICKS, query, r6, ticks
from .study_queries import _SIGNALS, _trades, _trades_sql
from .tape_queries import archive_line

HEADER = "agg_id,price,qty,first_id,last_id,epoch,is_buyer_maker,best_match"

#: The days that the catch-up query's table ends with, that is not published, and that it runs on; fixed values.
LAST, GAP, TODAY = date(2024, 1, 10), date(2024, 1, 16), date(2024, 1, 28)


def _utc() -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros("ts"), F.expr("timestamp_ntz'1970-01-01'"))


def _published(spark: SparkSession, tape: DataFrame) -> tuple[str, list]:
    """The tape as archives by day in a folder of the shared ones, and what was published."""
    base = folder(spark, "published")
    lines = tape.select("symbol", F.to_date("ts").cast("string").alias("period"), "ts", "agg_id", archive_line().alias("line"))
    # a row for each archive
    return base, published.publish(lines, base, ["ts", "agg_id"], HEADER).collect()


@query(f"""
WITH {TICKS}
SELECT symbol, strftime(ts, '%Y-%m-%d') AS period, count(*) AS n_ticks, min(agg_id) AS first_id, max(agg_id) AS last_id,
       round(sum(price), 6) AS price_sum, count(*) FILTER (WHERE is_buyer_maker) AS n_maker, max(ts) AS last_ts
FROM t GROUP BY ALL
""")
def a02_published_archives(spark: SparkSession, d: str) -> DataFrame:
    """The tape published by symbol and day with checksums, copied, verified and read back, an archive a task."""
    base, told = _published(spark, ticks(spark, d))
    symbols, days = (sorted({r[k] for r in told}) for k in ("symbol", "period"))
    rows = published.read_archives(spark, base, symbols, days, missing="skip", into=folder(spark, "fetched"))
    parsed = rows.select("symbol", "period", *[c.alias(n) for n, c in archive.parse_line(F.col("line")).items()]).where("agg_id IS NOT NULL")
    return parsed.groupBy("symbol", "period").agg(
        F.count(F.lit(1)).alias("n_ticks"),
        F.min("agg_id").alias("first_id"),
        F.max("agg_id").alias("last_id"),
        F.round(F.sum("price"), 6).alias("price_sum"),
        F.count_if("is_buyer_maker").alias("n_maker"),
        F.max(_utc()).alias("last_ts"),
    )


@query(f"""
WITH {TICKS}
SELECT agg_id, ts, round(price, 6) AS price, qty, is_buyer_maker, ts >= TIMESTAMP '{LAST}' + INTERVAL 1 DAY AS added
FROM t WHERE symbol = 'S0' AND ts < TIMESTAMP '{GAP}'
""")
def a15_catch_up(spark: SparkSession, d: str) -> DataFrame:
    """A symbol's table after catching up with daily archives from its last day on, up to the day that isn't published."""
    tape = ticks(spark, d).where("symbol = 'S0'")
    base, _ = _published(spark, tape.where(F.to_date("ts") != F.lit(GAP)))
    path = folder(spark, "ticks")
    held = tape.where(F.to_date("ts") <= F.lit(LAST)).select(archive_line().alias("line"))
    write_ticks(archive.ticks(held, "S0"), path)
    for _ in range(2):
        published.catch_up(spark, path, base, "S0", TODAY, into=folder(spark, "fetched"))
    made = spark.read.parquet(path).withColumn("ts", _utc())
    return made.select("agg_id", "ts", *r6("price"), "qty", "is_buyer_maker", (F.to_date("ts") > F.lit(LAST)).alias("added"))


@query(f"""
WITH {_SIGNALS}, {_trades_sql()}
SELECT 'l0_' || symbol || '_0.55' AS run_id, symbol, count(DISTINCT bar_id % 3) AS n_folds_evaluated, count(*) AS n_trades_total,
       round(avg(CASE WHEN pnl_bps_net > 0 THEN 100.0 ELSE 0 END), 6) AS win_pct, round(sum(pnl_bps_net), 6) AS total_pnl_bps, min(entry_ts) AS first_entry, 2 AS manifest
FROM trades GROUP BY symbol
""")
def m22_run_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the backtest, one for each symbol, published twice with their trades and read back."""
    name = run_id("l0", F.col("symbol"), F.lit("0.55"))
    trades = written(_trades(spark, d).withColumns({"run_id": name, "fold_id": (F.col("bar_id") % 3).cast("int")}), "backfill")
    about = trades.select("run_id", "symbol", F.lit(0.55).alias("threshold")).distinct()
    store = RunStore(spark, folder(spark, "runs"))
    for _ in range(2):
        number = backfill_runs(store, trades, about, ["symbol", "threshold"], 18)
    first = store.read("trades").groupBy("run_id").agg(F.min("entry_ts").alias("first_entry"))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_folds_evaluated", "n_trades_total")]
    made = store.read("runs").join(first, "run_id")
    return made.select("run_id", "symbol", *counts, *r6("win_pct", "total_pnl_bps"), "first_entry", F.lit(number).alias("manifest"))


def fetch_page(first: int, limit: int, path: str) -> list[dict]:
    """Of records written below path in ranges of their ids, those from `first` on."""
    table, width, ids = ds.dataset(path.removeprefix("file://"), format="parquet"), limit, ds.field("agg_id")
    while True:
        found = table.to_table(filter=(ids >= first) & (ids < first + width))
        if len(found) >= limit or not table.count_rows(filter=ids >= first + width):
            break
        # ids have gaps: look further ahead until the page is full
        width *= 4
    page = found.sort_by("agg_id").slice(0, limit).to_pylist()
    names = ("agg_id", "price", "qty", "agg_id", "agg_id", "epoch", "is_buyer_maker")
    return [dict(zip(FIELDS, (*(r[n] for n in names), True), strict=True)) for r in page]


@query(f"""
WITH {TICKS}
SELECT agg_id, ts, round(price, 6) AS price, round(qty, 6) AS qty, is_buyer_maker FROM t
""")
def a13_pulled_ticks(spark: SparkSession, d: str) -> DataFrame:
    """The tape pulled by pages of ids, in ranges of ids that are tasks."""
    path = folder(spark, "records")
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("ts"))
    rows = ticks(spark, d).select("agg_id", F.col("price").cast("string"), F.col("qty").cast("string"), micros.alias("epoch"), "is_buyer_maker")
    rows.repartitionByRange("agg_id").sortWithinPartitions("agg_id").write.parquet(path)
    spark.dataSource.register(PullSource)
    options = {"fetch": "barloom.plans.source_queries:fetch_page", "fetch.path": path, "page": 5_000, "pages": 4}
    pulled = spark.read.format("tick_pull").options(**options).load()
    made = pulled.select("agg_id", epoch_to_timestamp(F.col("epoch")).alias("ts"), F.col("price").cast("double"), F.col("qty").cast("double"), "is_buyer_maker")
    return made.withColumn("ts", _utc()).select("agg_id", "ts", *r6("price", "qty"), "is_buyer_maker")
