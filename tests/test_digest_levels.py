"""Digests that end after some levels."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import functions as F

from barloom.operators.bars import ordered_digest


def _md5(texts: list[str]) -> str:
    return md5("|".join(texts).encode()).hexdigest()


def test_two_levels_leave_a_row_for_each_stretch(spark):
    sizes = {"a": 21, "b": 9, "c": 2, "d": 10}
    rows = spark.createDataFrame([(k, i, f"t{i}") for k, n in sizes.items() for i in range(n)], "k string, i long, s string")
    got = sorted((r["k"], r["print"]) for r in ordered_digest(rows, ["k"], F.col("s"), [F.col("i")], chunk=3, levels=2).collect())
    want = []
    for k, n in sizes.items():
        parts = [_md5([f"t{i}" for i in range(a, min(a + 3, n))]) for a in range(0, n, 3)]
        want += [(k, parts[0])] if len(parts) == 1 else [(k, _md5(parts[a : a + 3])) for a in range(0, len(parts), 3)]
    assert got == sorted(want) and len(got) == 7
