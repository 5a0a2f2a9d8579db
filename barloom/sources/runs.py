"""Tables of runs that are published all at once: readers see a run's old rows or its new ones, never part of either.

What is written stands in a folder of its own version first. A manifest, one small numbered file, names the version that
each run is to be read from; publishing is the rename of the next manifest into place. A writer that fails
before leaves the old manifest, and of two writers that want the same number one fails and may try again.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import backtest as X
from barloom.operators.sessions import across_folds

from .scratch import written


class PublishConflict(RuntimeError):
    """Another writer has published meanwhile: nothing of this one is to be seen; it may be repeated."""


class RunStore:
    """Tables below a root of any store that Spark reads; each row belongs to a run_id."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def number(self) -> int:
        """The number of the manifest that counts; 0 before the first."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def manifest(self, number: int | None = None) -> dict[str, str]:
        """run_id to the version that it is read from; as it was at `number`, if given."""
        number = self.number() if number is None else number
        if not number:
            return {}
        text = self.spark.read.option("wholetext", "true").text(f"{self.root}/manifests/{number:012d}.json").first()[0]
        return json.loads(text)["runs"]

    def read(self, table: str, number: int | None = None) -> DataFrame | None:
        """The rows of all published runs; None if there are none. What is published later doesn't change the result."""
        versions: dict[str, list[str]] = {}
        for run, version in self.manifest(number).items():
            versions.setdefault(version, []).append(run)
        parts = []
        for version, runs in sorted(versions.items()):
            part = self.spark.read.option("basePath", f"{self.root}/{version}/{table}").parquet(f"{self.root}/{version}/{table}")
            parts.append(part.where(F.col("run_id").isin(runs)))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def publish(self, tables: dict[str, DataFrame], runs: list[str], dropped: list[str] | None = None) -> int:
        """Writes the tables' rows of these runs (all have the column run_id) and makes them what is read; returns the manifest's number.

        A run that was published before is replaced in all tables, also by no rows. Rows of other runs fail the call, since nobody
        would see them. Runs in `dropped` are read no more.
        """
        before = self.number()
        current = self.manifest(before)
        version = f"v-{uuid.uuid4().hex}"
        for name, df in tables.items():
            known = F.col("run_id").isin(runs) if runs else F.lit(False)
            stray = F.raise_error(F.concat(F.lit("a row of a run that is not published: "), F.coalesce("run_id", F.lit("null"))))
            checked = df.withColumn("run_id", F.when(known, F.col("run_id")).otherwise(stray.cast("string")))
            # the run is a column of the files, not a folder: a version without rows can be read as well
            checked.write.parquet(f"{self.root}/{version}/{name}")
        now = {r: v for r, v in current.items() if r not in (dropped or [])} | {r: version for r in runs}
        return self._put(before + 1, now)

    def _put(self, number: int, runs: dict[str, str]) -> int:
        part = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}.part")
        target = self._path(f"{self.root}/manifests/{number:012d}.json")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(part, False)
        try:
            out.write(bytearray(json.dumps({"number": number, "runs": runs}, sort_keys=True).encode()))
        finally:
            out.close()
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise PublishConflict(f"manifest {number} is there already")
        return number

    def vacuum(self) -> list[str]:
        """Deletes the versions that the newest manifest doesn't name, and returns them. Nobody may be reading or writing then."""
        used, gone = set(self.manifest().values()), []
        for f in self._fs.listStatus(self._path(self.root)):
            name = f.getPath().getName()
            if name.startswith("v-") and name not in used:
                self._fs.delete(f.getPath(), True)
                gone.append(name)
        return gone


def run_id(prefix: str, *parts: Column) -> Column:
    """A name that says what a run is, the same whenever it is made."""
    return F.concat_ws("_", F.lit(prefix), *[p.cast("string") for p in parts])


def backfill_runs(store: RunStore, trades: DataFrame, about: DataFrame, keys: list[str], n_folds: int) -> int:
    """Publishes runs and their trades, with each run's summary over folds; returns the manifest's number.

    trades: run_id, fold_id, the trade's columns, pnl_bps_net. about: a row for each run, run_id and what it was made with
    (keys). Runs without trades are published with none. Repeated with the same trades, it gives the same tables.
    """
    trades, about = written(trades, "run-trades"), written(about.select("run_id", *keys).dropDuplicates(["run_id"]), "runs")
    folds = X.metrics(trades, ["run_id", "fold_id"])
    won = trades.groupBy("run_id").agg(F.avg(F.when(F.col("pnl_bps_net") > 0, 100.0).otherwise(0.0)).alias("win_pct"), F.sum("pnl_bps_net").alias("total_pnl_bps"))
    told = across_folds(folds, "run_id").select(
        "run_id",
        F.col("n_folds").alias("n_folds_evaluated"),
        (F.col("mean_sharpe") * F.col("n_folds") / n_folds).alias("sharpe_all_folds"),
        F.col("mean_nonzero_sharpe").alias("sharpe_nonzero"),
        F.col("n_trades").alias("n_trades_total"),
    )
    zero = F.lit(0)
    runs = about.join(told, "run_id", "left").join(won, "run_id", "left").withColumns(
        {"n_folds_total": F.lit(n_folds), "n_folds_evaluated": F.coalesce("n_folds_evaluated", zero), "n_trades_total": F.coalesce("n_trades_total", zero)}
    )
    # as many names as runs
    names = [r[0] for r in about.select("run_id").collect()]
    return store.publish({"runs": runs, "trades": trades}, names)

