"""Published archives: sums, gaps, half-written files, catch-up and backfill, from a folder and over http."""

from __future__ import annotations

import functools
import hashlib
import http.server
import os
import threading
import zipfile
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from barloom.sources import published as P
from barloom.sources.archive import ticks

HEADER = "agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker,best_match"


def lines(day, n=50):
    start = int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() * 1000)
    first = day.toordinal() * 1000
    return [f"{first + i},{100 + i}.5,0.5,{i},{i},{start + i * 1000},{'True' if i % 3 else 'false'},True" for i in range(n)]


def put(base, period, rows, symbol="BTC", told=None, header=True):
    folder = os.path.join(base, symbol)
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{symbol}-aggTrades-{period}.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(f"{symbol}-aggTrades-{period}.csv", "\n".join([HEADER, *rows] if header else rows) + "\n")
    with open(path, "rb") as f:
        digest = told or hashlib.sha256(f.read()).hexdigest()
    if told != "":
        with open(path + ".CHECKSUM", "w") as f:
            f.write(f"{digest}  {os.path.basename(path)}\n")
    return path


def days(n, first=date(2024, 1, 30)):
    return [date.fromordinal(first.toordinal() + i) for i in range(n)]


def table(spark, path, upto):
    """A table of ticks whose last day is `upto`."""
    made = spark.createDataFrame([(x,) for x in lines(upto, 5)], "line string")
    from barloom.sources.tables import write_ticks

    write_ticks(ticks(made, "BTC"), path)


@pytest.fixture
def web(tmp_path):
    """The base folder served by http."""
    base = tmp_path / "base"
    base.mkdir()

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=str(base)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()
    server.server_close()


@pytest.mark.parametrize("kind", ["path", "uri", "http"])
def test_each_archive_is_a_task(spark, tmp_path, web, kind):
    base, into = tmp_path / "base", tmp_path / "into"
    for d in days(3):
        put(base, d, lines(d), header=d.day % 2 == 0)
    address = {"path": str(base), "uri": f"file://{base}", "http": web}[kind]
    for _ in range(2):
        rows = P.read_archives(spark, address, ["BTC"], [str(d) for d in days(3)], into=str(into))
        assert rows.rdd.getNumPartitions() == 3
        got = ticks(rows, "BTC")
        assert got.count() == 150 and got.select("agg_id").distinct().count() == 150
        assert rows.select("period", "sha256").distinct().count() == 3
    kept = sorted(f for _, _, fs in os.walk(into) for f in fs)
    assert kept == [f"BTC-aggTrades-{d}.zip" for d in days(3)]


def test_wrong_and_missing_sums_fail_and_leave_nothing(spark, tmp_path):
    base, into = tmp_path / "base", tmp_path / "into"
    put(base, "2024-01-30", lines(date(2024, 1, 30)), told="0" * 64)
    put(base, "2024-01-31", lines(date(2024, 1, 31)), told="")
    put(base, "2024-02-01", lines(date(2024, 2, 1)), told="short")
    for period, why in (("2024-01-30", "mismatch"), ("2024-01-31", "no checksum"), ("2024-02-01", "bad checksum"), ("2024-02-02", "no checksum")):
        for folder in (str(into), None):
            with pytest.raises(Exception, match=why):
                P.read_archives(spark, str(base), ["BTC"], [period], into=folder).collect()
    assert [f for _, _, fs in os.walk(into) for f in fs] == []


def test_a_half_written_copy_is_replaced(spark, tmp_path):
    base, into = tmp_path / "base", tmp_path / "into"
    d = days(1)[0]
    whole = put(base, d, lines(d))
    os.makedirs(into / "BTC")
    copy = into / "BTC" / os.path.basename(whole)
    with open(whole, "rb") as f:
        half = f.read()[:100]
    copy.write_bytes(half)
    (into / "BTC" / f"{os.path.basename(whole)}.0123.part").write_bytes(half)
    assert ticks(P.read_archives(spark, str(base), ["BTC"], [str(d)], into=str(into)), "BTC").count() == 50
    with open(whole, "rb") as f:
        assert copy.read_bytes() == f.read()


def test_a_web_address_needs_a_folder(spark, web):
    with pytest.raises(Exception, match="shared folder"):
        P.read_archives(spark, web, ["BTC"], ["2024-01-30"]).collect()


def test_catch_up_stops_at_the_first_gap(spark, tmp_path):
    base, path = tmp_path / "base", str(tmp_path / "ticks")
    assert P.catch_up(spark, path, str(base), "BTC", date(2024, 2, 9))["reason"] == "empty_table"
    table(spark, path, days(1)[0])
    assert P.catch_up(spark, path, str(base), "BTC", date(2024, 2, 9)) == {
        "reason": "no_new_archive", "last_day_before": days(1)[0], "last_day_after": days(1)[0], "days": []
    }
    for d in days(8):
        if d != date(2024, 2, 3):
            put(base, d, lines(d))
    done = P.catch_up(spark, path, str(base), "BTC", date(2024, 2, 9), into=str(tmp_path / "into"))
    assert done["reason"] == "complete" and done["days"] == ["2024-01-31", "2024-02-01", "2024-02-02"] and done["last_day_after"] == date(2024, 2, 2)
    assert spark.read.parquet(path).count() == 5 + 150
    put(base, date(2024, 2, 3), lines(date(2024, 2, 3)))
    # yesterday is the last day wanted, and `most` bounds the days
    assert P.catch_up(spark, path, str(base), "BTC", date(2024, 2, 5), most=1)["days"] == ["2024-02-03"]
    assert P.catch_up(spark, path, str(base), "BTC", date(2024, 2, 5))["days"] == ["2024-02-04"]
    assert P.catch_up(spark, path, str(base), "BTC", date(2024, 2, 5))["reason"] == "no_new_archive"
    rows = spark.read.parquet(path)
    assert rows.count() == rows.select("agg_id").distinct().count() == 255


def test_a_failed_day_adds_nothing(spark, tmp_path):
    base, path = tmp_path / "base", str(tmp_path / "ticks")
    table(spark, path, days(1)[0])
    for d in days(3)[1:]:
        put(base, d, lines(d), told="1" * 64 if d == days(3)[2] else None)
    with pytest.raises(Exception, match="mismatch"):
        P.catch_up(spark, path, str(base), "BTC", date(2024, 2, 9))
    assert spark.read.parquet(path).count() == 5
    put(base, days(3)[2], lines(days(3)[2]))
    assert P.catch_up(spark, path, str(base), "BTC", date(2024, 2, 9))["days"] == ["2024-01-31", "2024-02-01"]
    assert spark.read.parquet(path).count() == 105


def test_months_are_replaced_by_their_sum(spark, tmp_path):
    base, path = tmp_path / "base", str(tmp_path / "ticks")
    log = spark.createDataFrame([], "symbol string, month date, sha256 string, n_rows long, version int")
    for m in (1, 2):
        put(base, f"2024-0{m}", lines(date(2024, m, 5)) + lines(date(2024, m, 20)))
    log = P.backfill(spark, path, log, str(base), "BTC", date(2024, 1, 3), date(2024, 4, 2))
    assert [(str(r.month), r.n_rows, r.version) for r in log.orderBy("month").collect()] == [("2024-01-01", 100, 1), ("2024-02-01", 100, 1)]
    log = spark.createDataFrame(log.collect(), log.schema)
    again = P.backfill(spark, path, log, str(base), "BTC", date(2024, 1, 3), date(2024, 4, 2))
    assert again is log
    put(base, "2024-02", lines(date(2024, 2, 5), 7))
    log = P.backfill(spark, path, log, str(base), "BTC", date(2024, 1, 3), date(2024, 4, 2))
    assert [(str(r.month), r.n_rows, r.version) for r in log.orderBy("month").collect()] == [("2024-01-01", 100, 1), ("2024-02-01", 7, 2)]
    assert spark.read.parquet(path).count() == 107


def test_publish_and_read_back(spark, tmp_path):
    rows = [(s, str(d), x, i) for s in ("A", "B") for d in days(2) for i, x in enumerate(lines(d, 30))]
    made = spark.createDataFrame(rows, "symbol string, period string, line string, n long").repartition(5)
    told = P.publish(made, f"file://{tmp_path}/out", ["n"], HEADER).collect()
    assert sorted((r.symbol, r.period, r.n_lines) for r in told) == sorted((s, str(d), 30) for s in ("A", "B") for d in days(2))
    back = P.read_archives(spark, f"{tmp_path}/out", ["A", "B"], [str(d) for d in days(2)])
    assert {r.sha256 for r in told} == {r.sha256 for r in back.select("sha256").distinct().collect()}
    first = back.where((F.col("symbol") == "A") & (F.col("period") == str(days(2)[0]))).collect()
    assert [r.line for r in first] == [HEADER, *lines(days(2)[0], 30)]
