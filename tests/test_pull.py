"""The partitioned pull source: ids by tasks, gaps, growth, restarts, failures."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from barloom.sources.pull import PullSource, _Pull

LOG = "requests.log"


def _tape(path):
    with open(os.path.join(path, "ids.json")) as f:
        return json.load(f)


def fetch(first, limit, path, flaky="no"):
    """Records of the ids that a file holds; logs what is asked, and fails once where it is told to."""
    with open(os.path.join(path, LOG), "a") as f:
        f.write(f"{first} {limit}\n")
    broken = os.path.join(path, "broken")
    if flaky == "yes" and os.path.exists(broken) and limit > 1:
        os.remove(broken)
        raise OSError("no answer")
    ids = [i for i in _tape(path) if i >= first][:limit]
    return [{"a": i, "p": f"{i}.5", "q": "2", "f": i, "l": i, "T": 1700000000000 + i, "m": i % 2 == 0, "M": True} for i in ids]


def newest(path, flaky="no"):
    return max(_tape(path), default=None)


def put(path, ids):
    (path / "ids.json").write_text(json.dumps(list(ids)))


def asked(path):
    return [tuple(map(int, line.split())) for line in (path / LOG).read_text().splitlines()]


def stream(spark, path, **more):
    spark.dataSource.register(PullSource)
    options = {"fetch": "tests.test_pull:fetch", "fetch.path": str(path), "page": 10, "pages": 2, **more}
    return spark.readStream.format("tick_pull").options(**options).load()


def run(source, path, name="o"):
    writer = source.withColumn("task", F.spark_partition_id()).writeStream.format("parquet")
    query = writer.option("path", str(path / name)).option("checkpointLocation", str(path / f"k-{name}")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def ids(spark, path, name="o"):
    return sorted(r["agg_id"] for r in spark.read.parquet(str(path / name)).collect())


@pytest.mark.parametrize("known", [True, False])
def test_tasks_growth_and_restart(spark, tmp_path, known):
    more = {"newest": "tests.test_pull:newest"} if known else {}
    first = [i for i in range(95) if i % 7]
    put(tmp_path, first)
    run(stream(spark, tmp_path, **more), tmp_path)
    made = spark.read.parquet(str(tmp_path / "o"))
    assert ids(spark, tmp_path) == first
    # 95 ids, 20 for each task
    assert made.select("task").distinct().count() == 5
    pages = [a for a in asked(tmp_path) if a[1] > 1]
    assert len(pages) <= 10 and max(n for _, n in pages) == 10
    more_ids = [*first, 140, 141, 300]
    put(tmp_path, more_ids)
    run(stream(spark, tmp_path, **more), tmp_path)
    assert ids(spark, tmp_path) == more_ids
    run(stream(spark, tmp_path, **more), tmp_path)
    assert ids(spark, tmp_path) == more_ids


def test_a_failed_request_loses_and_repeats_nothing(spark, tmp_path):
    put(tmp_path, range(50))
    (tmp_path / "broken").write_text("")
    with pytest.raises(Exception, match="no answer"):
        run(stream(spark, tmp_path, **{"fetch.flaky": "yes"}), tmp_path)
    put(tmp_path, range(70))
    # the trigger that failed is run again with its own ids, the rest by the next one
    run(stream(spark, tmp_path, **{"fetch.flaky": "yes"}), tmp_path)
    assert ids(spark, tmp_path) == list(range(70))


@pytest.mark.parametrize("tape", [[], [5], [0, 1, 2], [7, 8, 100, 5000], list(range(64))])
def test_the_newest_is_found_by_single_records(tmp_path, tape):
    put(tmp_path, tape)
    pull = _Pull({"fetch": "tests.test_pull:fetch", "fetch.path": str(tmp_path)})
    for at in (0, 5, 6, 9000):
        assert pull.end(at) == max(at, max(tape, default=-1) + 1)
    assert len(asked(tmp_path)) < 4 * 40 if (tmp_path / LOG).exists() else True


def test_batch(spark, tmp_path):
    put(tmp_path, range(3, 47))
    spark.dataSource.register(PullSource)
    options = {"fetch": "tests.test_pull:fetch", "fetch.path": str(tmp_path), "page": 4, "pages": 3, "start": 10}
    rows = spark.read.format("tick_pull").options(**options).load()
    assert sorted(r.agg_id for r in rows.collect()) == list(range(10, 47)) and rows.rdd.getNumPartitions() == 4
