"""Archives, manifests, tables, the pull source and paper trading."""

from __future__ import annotations

import hashlib
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barloom.functions import ticks as T
from barloom.sources import archive, tables
from barloom.sources.pull import PullSource
from barloom.streaming import paper

T0 = datetime(2024, 1, 1)
HEADER = "agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker,best_match"
LINES = [f"{i},{100 + i}.5,0.{i + 1},{i},{i},{1700000000000 + i if i % 2 else (1700000000000 + i) * 1000},{'True' if i % 3 else 'false'},True" for i in range(9)]


def make_zip(path, name, lines, extra=None):
    with zipfile.ZipFile(path, "w") as z:
        if extra:
            z.writestr(extra, "0,0,0,0,0,0,True,True\n")
        z.writestr(name, "\n".join(lines) + "\n")


def test_archive_round_trip(spark, tmp_path):
    make_zip(tmp_path / "BTC-2023-11.zip", "BTC-2023-11.csv", [HEADER, *LINES], extra="nested/BTC-2023-11.csv")
    digest = hashlib.sha256((tmp_path / "BTC-2023-11.zip").read_bytes()).hexdigest()
    (tmp_path / "BTC-2023-11.zip.CHECKSUM").write_text(f"{digest}  BTC-2023-11.zip\n")
    zips = archive.files(spark, str(tmp_path))
    sums = archive.files(spark, str(tmp_path), "*.CHECKSUM")
    checked = archive.verified(zips, sums)
    assert checked.first()["sha256"] == digest
    rows = archive.ticks(archive.lines(checked), "BTC").orderBy("agg_id").collect()
    assert [r["agg_id"] for r in rows] == list(range(9))
    assert {r["ts"].replace(tzinfo=None).year for r in rows} == {2023}
    assert rows[1]["quote_qty"] == pytest.approx(101.5 * 0.2) and [r["is_buyer_maker"] for r in rows[:4]] == [False, True, True, False]
    (tmp_path / "BTC-2023-11.zip.CHECKSUM").write_text("00  BTC-2023-11.zip\n")
    wrong = archive.verified(archive.files(spark, str(tmp_path)), archive.files(spark, str(tmp_path), "*.CHECKSUM"))
    for read in (wrong, wrong.select("file", "content"), archive.lines(wrong), archive.ticks(archive.lines(wrong), "BTC")):
        with pytest.raises(PySparkException):
            read.collect()


def test_archive_without_csv(spark, tmp_path):
    make_zip(tmp_path / "x.zip", "readme.txt", ["no"])
    with pytest.raises(PySparkException):
        archive.lines(archive.files(spark, str(tmp_path))).collect()


def test_csv_ticks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *LINES]))
    (tmp_path / "b.csv").write_text("\n".join(LINES))
    made = archive.csv_ticks(spark, str(tmp_path), "BTC")
    assert made.count() == 18 and archive.first_of_key(made, ["symbol", "agg_id"], "ts").count() == 9


def test_tokens(spark):
    rows = spark.createDataFrame([("BTCUSDT",), ("eth",)], "s string").select(T.symbol_short(F.col("s")))
    assert [r[0] for r in rows.collect()] == ["btc", "eth"]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("maybe",)], "s string").select(T.bool_strict(F.col("s"))).collect()
    months = spark.range(1).select(T.complete_months(F.lit("2024-01-15").cast("date"), F.lit("2024-04-02").cast("date"))).first()[0]
    assert [str(m) for m in months] == ["2024-01-01", "2024-02-01", "2024-03-01"]


def test_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "ticks")
    ticks = spark.createDataFrame([("A", i, datetime(2024, 1 + i % 2, 5, i % 24), 1.0) for i in range(40)], "symbol string, agg_id long, ts timestamp, price double")
    tables.write_ticks(ticks, path)
    tables.write_ticks(ticks.where("agg_id < 10 AND agg_id % 2 = 0"), path)
    got = {r["month"]: r["count"] for r in spark.read.parquet(path).groupBy("month").count().collect()}
    assert got == {"2024-01": 5, "2024-02": 20}


def test_feature_sets_and_versions(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1, datetime(2024, 1, 1), 0.5)], "symbol string, bar_id long, bar_close_ts timestamp, f double")
    tables.write_features(rows, str(tmp_path / "f"), "base")
    tables.write_features(rows.withColumn("f", F.lit(2.0)), str(tmp_path / "f"), "v2")
    assert tables.read_features(spark, str(tmp_path / "f")).first()["f"] == 0.5
    assert tables.read_features(spark, str(tmp_path / "f"), v2=True).first()["f"] == 2.0
    with pytest.raises(ValueError):
        tables.read_features(spark, "x", tier1=True, v2=True)
    assert tables.latest_version(["m_v9", "m_v10", "m_v2"]) == "m_v10" and tables.latest_version([]) is None


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "n int, s string")
    tables.write_report(rows, str(tmp_path / "r"))
    tables.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "r")).first()["s"] == "a" and spark.read.option("header", True).csv(str(tmp_path / "c")).first()["n"] == "1"
    events = spark.createDataFrame([(datetime(2024, 1, 1, 23), 1, "start", "{}"), (datetime(2024, 1, 2), 1, "stop", "{}")], "ts timestamp, session_id long, event string, payload string")
    tables.append_audit(events, str(tmp_path / "audit"))
    tables.append_audit(events, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).groupBy("day").count().count() == 2


def fetch(first, limit):
    """A tape of 25 records, page by page."""
    return [{"a": i, "p": "1.5", "q": "2", "f": i, "l": i, "T": 1700000000000 + i, "m": True, "M": True} for i in range(first, min(first + limit, 25))]


def test_pull_source(spark, tmp_path):
    spark.dataSource.register(PullSource)
    source = spark.readStream.format("tick_pull").option("fetch", "tests.test_sources:fetch").option("page", 10).load()
    query = source.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "k")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted(r["agg_id"] for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == list(range(25))


def test_paper_loop(spark, tmp_path):
    rows = [("A", i, datetime(2024, 1, 1) + timedelta(hours=i), 0.7 if i % 2 else 0.3, 0.2, 0.1) for i in range(10)]
    kind = "symbol string, bar_id long, bar_close_ts timestamp, p_long double, p_short double, p_neutral double"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    query = paper.run(source, str(tmp_path / "out"), str(tmp_path / "k"), 0.6, 7, once=True)
    query.awaitTermination(120)
    made = spark.read.parquet(str(tmp_path / "out"))
    assert {r["decision"]: r["count"] for r in made.groupBy("decision").count().collect()} == {"long": 5, "skip": 5}
    assert paper.undecided(spark.createDataFrame(rows, kind), made).count() == 0


KIND = "symbol string, bar_id long, bar_close_ts timestamp, p_long double, p_short double, p_neutral double"
BARS = [("A", i, datetime(2024, 1, 1) + timedelta(hours=i), 0.7 if i % 2 else 0.3, 0.2, 0.1) for i in range(10)]


def test_a_halt_loses_no_bar(spark, tmp_path):
    spark.createDataFrame(BARS, KIND).coalesce(1).write.parquet(str(tmp_path / "in"))
    out, halt = str(tmp_path / "out"), [True]

    def start(checkpoint):
        source = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
        query = paper.run(source, out, str(tmp_path / checkpoint), 0.6, 7, halted=lambda s: halt[0], once=True)
        query.awaitTermination(120)

    with pytest.raises(PySparkException, match="TradingHalted"):
        start("k")
    halt[0] = False
    start("k")
    assert spark.read.parquet(out).count() == 10
    # another checkpoint sees all bars again, and decides none of them anew
    start("other")
    assert spark.read.parquet(out).count() == 10


def test_session_lifecycle(spark, tmp_path):
    kind = "session_id long, name string, started_at timestamp, ended_at timestamp, end_reason string"
    rows = [(1, "a", T0, None, None), (2, "b", T0, None, None)]
    where = str(tmp_path / "sessions")
    paper.start_session(spark.createDataFrame(rows[:1], kind), where)
    paper.start_session(spark.createDataFrame(rows, kind), where)
    for reason in ("done", "again"):
        paper.end_session(spark, where, 1, F.lit("2024-02-01").cast("timestamp"), reason)
    got = {r["session_id"]: (r["name"], r["end_reason"]) for r in spark.read.parquet(where).collect()}
    assert got == {1: ("a", "done"), 2: ("b", None)}


def test_positions(spark, tmp_path):
    """Entries while there is a slot, exits at barriers or by age, over several triggers."""
    kind = "session_id long, symbol string, bar_id long, bar_close_ts timestamp, high double, low double, close double, decision string, reason string"
    plan = [(100, 100, 100, "long"), (104, 99, 101, "short"), (106, 100, 105, "skip"), (105, 105, 105, "short"), (106, 104, 105, "skip"), (106, 104, 104, "long"), (104, 104, 104, "skip")]
    rows = [(7, "A", i, T0 + timedelta(hours=i), float(h), float(low), float(c), d, "r") for i, (h, low, c, d) in enumerate(plan)]
    for i in (0, 4):
        spark.createDataFrame(rows[i : i + 4], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        made = paper.positions(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 0.05, 0.05, 2)
        query = made.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = [(r["bar_id"], r["event"], r["reason"], r["holding_bars"]) for r in spark.read.parquet(str(tmp_path / "o")).orderBy("ts", "bar_id").collect()]
    assert got == [(0, "entry", "r", 0), (1, "passed", "r", 0), (0, "exit", "tp", 2), (3, "entry", "r", 0), (3, "exit", "timeout", 2), (5, "passed", "r", 0)]


def test_bar_reader_and_versions(spark, tmp_path):
    rows = [("A", 200, i, T0 + timedelta(days=20 * i), T0 + timedelta(days=20 * i + 1), 1.0) for i in range(4)] + [("A", 150, 0, T0, T0, 2.0)]
    kind = "symbol string, threshold_bp int, seq long, bar_open_ts timestamp, bar_close_ts timestamp, close double"
    tables.write_bars(spark.createDataFrame(rows, kind), str(tmp_path / "bars"))
    assert tables.read_bars(spark, str(tmp_path / "bars"), "A", 200).count() == 4
    assert [r["seq"] for r in tables.read_bars(spark, str(tmp_path / "bars"), "A", 200, "2024-01-01").orderBy("bar_close_ts").collect()] == [0, 1]
    days = spark.createDataFrame([("2024-01-01", "2024-01-05"), ("2024-01-01", "2024-03-01"), ("2024-01-04", "2024-01-05")], "a string, b string")
    got = [len(r[0]) for r in days.select(T.days_to_catch_up(F.col("a").cast("date"), F.col("b").cast("date"))).collect()]
    assert got == [3, 14, 0]


def test_audit_stream_over_a_restart(spark, tmp_path):
    kind, path = "ts timestamp, session_id long, event string, payload string", str(tmp_path / "audit")

    def put(name, hours):
        rows = [(datetime(2024, 1, 1) + timedelta(hours=h), 1, f"e{h}", "{}") for h in hours]
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"d={name}"))

    def run():
        events = spark.readStream.schema(kind + ", d int").parquet(str(tmp_path / "in")).drop("d")
        tables.stream_audit(events, path, str(tmp_path / "k"), once=True).awaitTermination(120)

    put(0, range(20))
    run()
    # the batch is done, but the checkpoint doesn't say so: it is run again
    commits = tmp_path / "k" / "commits"
    for f in commits.iterdir():
        f.unlink()
    put(1, range(20, 30))
    run()
    run()
    got = spark.read.json(path)
    assert sorted(int(r.event[1:]) for r in got.collect()) == list(range(30))
    assert {str(r.day) for r in got.select("day").distinct().collect()} == {"2024-01-01", "2024-01-02"}


def test_reports_and_ticks_are_read(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"name": "run", "n": 2, "folds": [{"fold_id": 1, "sharpe": 0.5}, {"fold_id": 2, "sharpe": null}], "tags": ["a", "b"]}')
    made = tables.read_report(spark, str(tmp_path / "r.json"), "folds")
    assert sorted((r["name"], r["fold_id"], r["sharpe"]) for r in made.collect()) == [("run", 1, 0.5), ("run", 2, None)]
    assert [r["tags"] for r in tables.read_report(spark, str(tmp_path / "r.json"), "tags").select("tags").collect()] == ["a", "b"]
    assert tables.read_report(spark, str(tmp_path / "r.json")).count() == 1
    path = str(tmp_path / "ticks")
    rows = [("A", i, datetime(2024, 1, 1) + timedelta(days=i), 1.0) for i in range(90)] + [("B", 0, datetime(2024, 1, 1), 1.0)]
    tables.write_ticks(spark.createDataFrame(rows, "symbol string, agg_id long, ts timestamp, price double"), path)

    def ids(*a, **k):
        return [r.agg_id for r in tables.read_ticks(spark, path, "A", *a, **k).collect()]

    assert ids() == list(range(90)) and ids("2024-02-01", "2024-02-03") == [31, 32] and ids("2024-03-29") == [88, 89] and ids(limit=3) == [0, 1, 2]
    bounded = tables.read_ticks(spark, path, "A", "2024-02-01", "2024-02-03")
    assert len(bounded.inputFiles()) == 1 or "PartitionFilters" in bounded._jdf.queryExecution().toString()
