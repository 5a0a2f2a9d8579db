"""Fingerprints against plain Python: order of the ids, edited texts, samples by loops, likeness, twins by all pairs."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from barloom.llm import fingerprints as M
from barloom.llm.shingles import shingle_sets


def grams(text, k=5):
    return {int(x) for x in shingle_sets(pa.array([text], pa.large_string()), k)[0]}


def by_hand(text):
    """The samples by loops over Python integers."""
    p, x = 2**31 - 1, [g % (2**31 - 1) for g in grams(text)]
    return [min((int(a) * g + int(b)) % p for g in x) & 0xFFFF if x else 0xFFFF for a, b in zip(M._A, M._B, strict=True)]


def expected(rows):
    pack = zstandard.ZstdCompressor(level=1)
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, pack.compress(r[1].encode())))
    made = {t: by_hand(t) for _, t in rows}
    out = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        edit = text[: len(text) - n] + after[:n]
        e = by_hand(edit)
        text_ = lambda s: "".join(f"{v:04x}" for v in s)
        share = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
        own = made[text]
        out.append((doc_id, len(text), hashlib.sha256(edit.encode()).hexdigest(), text_(own), text_(e), share(own, e), share(own, made[after])))
    return out


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "😀"]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.3:
            t = rng.choice(out).split(" ")
            if rng.random() < 0.6:
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))))
    return out


KEY = lambda r: tuple("" if v is None else str(v) for v in r)


@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_against_plain_python(spark, monkeypatch, partitions):
    monkeypatch.setattr(M, "_STEP", 700)
    monkeypatch.setattr(M, "_PER_TASK", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = list(enumerate(texts(120), 10))
    rows += [(3, ""), (4, None), (5, " \t"), (6, "one"), (None, "no id at all"), (-7, "a b c d e f g"), (50, rows[40][1]), (50, "another text with that id"), (999, "x " * 30_000)]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, row long, range string").repartition(3)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = M.fingerprint_documents(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((tuple(r)[:7] for r in got), key=KEY) == sorted(expected(rows), key=KEY)
    # twins: what leads a band and is similar is found; nothing is named that is not
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(grams(t or ""))

    def near(a, b):
        return (not a and not b) or (a or b) and 100 * len(a & b) >= 80 * len(a | b)

    by_text = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        by_text.setdefault(t or "", i)
    for r in got:
        if r.twin_id is not None:
            assert r.twin_id <= r.doc_id and any(near(a, b) for a in sets[r.twin_id] for b in sets[r.doc_id])
    found = {r.doc_id: r.twin_id for r in got if r.doc_id != 50}
    for i, t in rows:
        if i not in (None, 50) and by_text[t or ""] not in (i, None):
            assert found[i] is not None and found[i] <= by_text[t or ""]
    pairs = [(i, j) for i, _ in rows for j, _ in rows if None not in (i, j) and 50 not in (i, j) and j < i and sets[i][0] and near(sets[i][0], sets[j][0])]
    assert len(pairs) > 20 and sum(found[i] is not None for i, _ in pairs) >= 0.95 * len(pairs)


def test_few_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert M.fingerprint_documents(docs).collect() == []
    one = M.fingerprint_documents(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert [tuple(r)[:7] for r in one] == expected([(1, "a b c d e f g h")]) and one[0].near_next == 1.0 and one[0].twin_id is None
    same = M.fingerprint_documents(spark.createDataFrame([(2, "a b")] * 3 + [(None, None)], "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in same if r.doc_id == 2}) == 1 and len(same) == 4


def test_likeness_estimates_jaccard():
    rng = random.Random(8)
    for shared in (0, 100, 300, 390, 400):
        a = [rng.getrandbits(62) for _ in range(400)]
        b = a[:shared] + [rng.getrandbits(62) for _ in range(400 - shared)]
        x, y = M.signatures([np.array(sorted(a), np.uint64)]), M.signatures([np.array(sorted(b), np.uint64)])
        assert abs(M.likeness(x, y)[0] - shared / (800 - shared)) < 0.13
