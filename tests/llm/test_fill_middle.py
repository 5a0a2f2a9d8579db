"""Fill-in-the-middle against plain Python, and rank and select against counting."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm.fill_middle import BitVector, fill_in_middle, restored

TRICKY = [
    "", None, "a", "é", "日本語 text", "<P>", "x<S>y", "<M", "<P <S <M", "ab12 cd\n\n", "😀a😀", "\x00a\x00", "a" * 70_000, "é1" * 40_000,
    "word " * 30_000, "S>a<", "P><", "M> b <", "<" * 9,
]


def by_hand(doc_id, text, seed=1):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [0, 1, 63, 64, 511, 512, 513, 20_000])
@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_rank_and_select(size, share):
    bits = np.random.default_rng(size).random(size) < share
    v = BitVector(bits)
    ones = np.flatnonzero(bits)
    assert v.total == len(ones)
    at = np.arange(size + 1)
    assert v.rank(at).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
    assert v.select(np.arange(len(ones))).tolist() == ones.tolist()


def test_against_plain_python(spark):
    rng = random.Random(5)
    texts = [*TRICKY, *("".join(rng.choice("ab <>PSMé\n1😀") for _ in range(rng.randrange(60))) for _ in range(400))]
    rows = [(i if i % 50 else None, t, "c", 1) for i, t in enumerate(texts)] + [(3, "again", "c", 1), (3, "again", "c", 1), (3, "other", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n long").repartition(3)
    made = fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    order = lambda x: tuple("" if v is None else str(v) for v in x)
    want = [(i, *by_hand(i, t), t or "") for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_no_rows_and_marks_that_cannot_be_told_apart(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle(docs).collect() == []
    for marks in (("<P>", "<P>", "<M>"), ("aba", "c", "d"), ("", "b", "c"), ("ab", "bc", "d"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, marks=marks)


def test_other_marks_and_shares(spark):
    docs = spark.createDataFrame([(i, f"text number {i} (x)") for i in range(200)], "doc_id long, text string")
    marks = ("[pre.]", "[suf*]", "[mid]")
    made = fill_in_middle(docs, seed=9, percent=50, spm_percent=100, marks=marks)
    back = made.withColumn("text", restored(F.col("output"), F.col("form"), marks))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, f"text number {i} (x)") for i in range(200)}
    forms = {r["form"]: r["count"] for r in made.groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm"} and 60 < forms["plain"] < 140
