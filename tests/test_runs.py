"""Runs are published all at once: reruns, failures, readers during a write, conflicts."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.sources.runs import PublishConflict, RunStore, backfill_runs, run_id

T0 = datetime(2024, 1, 1)


def trades(spark, pnl=(10.0, -5.0, 7.0), runs=("a", "b")):
    rows = [
        (r, 1 + i // 2, i, T0 + timedelta(days=i), T0 + timedelta(days=i, hours=5), 100.0, 101.0, 1, 3, p)
        for r in runs
        for i, p in enumerate(pnl)
    ]
    kind = "run_id string, fold_id int, bar_id long, entry_ts timestamp, exit_ts timestamp, entry_price double, exit_price double, direction int, holding_bars int, pnl_bps_net double"
    return spark.createDataFrame(rows, kind)


def about(spark, runs=("a", "b")):
    return spark.createDataFrame([(r, 0.6) for r in runs], "run_id string, threshold double")


def content(store, number=None):
    return {t: sorted(map(str, store.read(t, number).select(*sorted(store.read(t, number).columns)).collect())) for t in ("runs", "trades")}


def test_reruns_give_the_same_and_other_runs_stay(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    assert store.read("runs") is None and store.number() == 0
    for _ in range(2):
        backfill_runs(store, trades(spark), about(spark), ["threshold"], 18)
    first = content(store, 1)
    assert content(store) == first and len(first["trades"]) == 6 and store.number() == 2
    r = store.read("runs").where("run_id = 'a'").first()
    assert (r.n_trades_total, r.n_folds_total, r.n_folds_evaluated, r.total_pnl_bps) == (3, 18, 2, 12.0) and r.win_pct == pytest.approx(200 / 3)
    backfill_runs(store, trades(spark, (1.0,), ("b", )), about(spark, ("b", "none")), ["threshold"], 18)
    made = {x.run_id: x.n_trades_total for x in store.read("runs").collect()}
    assert made == {"a": 3, "b": 1, "none": 0} and store.read("trades").count() == 4
    # what was read from an older manifest is still there, until it is swept away
    assert content(store, 1) == first
    assert len(store.vacuum()) == 1 and content(store)["trades"] == content(store, 3)["trades"]


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    backfill_runs(store, trades(spark), about(spark), ["threshold"], 18)
    old = content(store)
    broken = trades(spark).withColumn("pnl_bps_net", F.when(F.col("bar_id") == 2, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("pnl_bps_net")))
    with pytest.raises(Exception, match="broken"):
        store.publish({"trades": broken}, ["a", "b"])
    with pytest.raises(Exception, match="not published"):
        store.publish({"trades": trades(spark)}, ["a"])
    assert content(store) == old and store.number() == 1


def test_a_reader_sees_old_or_new(spark, tmp_path, monkeypatch):
    store = RunStore(spark, str(tmp_path / "store"))
    store.publish({"trades": trades(spark), "runs": about(spark)}, ["a", "b"])
    before = store.read("trades")
    put, seen = store._put, []

    def during(number, runs):
        # all files are written, the manifest is not
        seen.append(RunStore(spark, store.root).read("trades").count())
        return put(number, runs)

    monkeypatch.setattr(store, "_put", during)
    store.publish({"trades": trades(spark, (1.0, 2.0)), "runs": about(spark)}, ["a", "b"])
    assert seen == [6] and store.read("trades").count() == 4
    # a plan made before goes on reading what it was made for
    assert before.count() == 6
    store.publish({}, [], dropped=["a"])
    assert store.read("trades").count() == 2


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    one, two = (RunStore(spark, str(tmp_path / "store")) for _ in range(2))
    put = one._put

    def overtaken(number, runs):
        two.publish({"trades": trades(spark, (9.0,), ("z",))}, ["z"])
        return put(number, runs)

    monkeypatch.setattr(one, "_put", overtaken)
    with pytest.raises(PublishConflict):
        one.publish({"trades": trades(spark)}, ["a", "b"])
    assert set(one.manifest()) == {"z"}
    monkeypatch.undo()
    one.publish({"trades": trades(spark)}, ["a", "b"])
    assert set(one.manifest()) == {"a", "b", "z"} and one.read("trades").count() == 7


def test_names(spark):
    assert spark.range(1).select(run_id("l0", F.lit("BTC"), F.lit(0.62))).first()[0] == "l0_BTC_0.62"
