"""The library stands without its llm subpackage: the entry point then lists the other queries."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

ASK = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "e01_cusum_bars" in q and set(o) <= set(q) and "pipeline" not in q and not [k for k in q if k.startswith("op")]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.entry(spark).count())
"""


def test_queries_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "barloom"), tmp_path / "barloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert int(done.stdout.split("rows")[-1]) > 0
