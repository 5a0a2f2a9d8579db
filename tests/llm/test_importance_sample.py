"""Importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from barloom.llm import importance_sample as M

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, longest):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(words), Counter(" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))


def by_hand(docs, target, longest=1, buckets=10_000, percent=10, least_words=20, seed=2024):
    def filled(texts):
        out = Counter()
        for t in texts:
            for f, n in grams(t, longest)[1].items():
                out[zlib.crc32(f.encode()) % buckets] += n
        return out

    raw, aim = filled(t for _, t in docs), filled(target)
    s_all, t_all = float(sum(raw.values())), float(sum(aim.values()))
    gain = {b: math.floor(1000 * math.log(((aim[b] + 1.0) * (s_all + buckets)) / ((raw[b] + 1.0) * (t_all + buckets)))) for b in raw}
    rows = []
    for doc_id, text in docs:
        n, counts = grams(text, longest)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] * k for f, k in counts.items())
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, sum(counts.values()), weight, score, n))
    able = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    rank = {}
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        rank.setdefault(r, []).append(place)
    return sorted((*r[:4], rank[r].pop(0) if rank.get(r) else None) for r in rows if r[0] is not None), [r for r in rows if r[0] is None]


def texts(n, seed=4):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Straße", "İs", "naïve", "x1", "語", "a_b", "don't", *(f"w{i}" for i in range(300))]
    out = [" ".join(rng.choice(vocabulary[: rng.choice([6, 20, 309])]) for _ in range(rng.randrange(70))) for _ in range(n)]
    return [*out, "", None, "...", "the " * 40_000, out[3], "\x00the\x7fof", "ＡＢ ab"]


@pytest.mark.parametrize(("longest", "buckets", "broadcast"), [(1, 10_000, 1_000_000), (1, 10_000, 40), (1, 50, 0), (3, 1_000, 60)])
def test_against_plain_python(spark, monkeypatch, longest, buckets, broadcast):
    """Also where gains of frequent strings alone, or none, may be broadcast."""
    monkeypatch.setattr(M, "FREQUENT", broadcast)
    monkeypatch.setattr(M, "_STEP", 500)
    rows = list(enumerate(texts(300)))
    rows += [(7, "again and again " * 10)] * 3
    target = ["the of the x1 w1 w2 w3", None, "naïve STRASSE Straße", ""]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row long, features string").repartition(5)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    made = M.importance_resample(docs, aims, longest=longest, buckets=buckets, percent=20)
    assert made.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert [t for _, t in made.dtypes] == ["bigint"] * 5
    want, _ = by_hand(rows, target, longest, buckets, 20)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(want, key=key)


def test_null_ids_and_empty_tables(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert M.importance_resample(none, target).collect() == []
    docs = spark.createDataFrame([(None, "a b " * 20), (1, "c d " * 20), (2, None)], "doc_id long, text string")
    for aims in (target, target.where("false")):
        got = {r.doc_id: r for r in M.importance_resample(docs, aims, percent=100).collect()}
        _, nulls = by_hand([(None, "a b " * 20), (1, "c d " * 20), (2, None)], [r.text for r in aims.collect()])
        assert got[None].weight == nulls[0][2] and got[None].score == nulls[0][3]
        assert {got[None].rank, got[1].rank} == {1, 2} and got[2].rank is None and got[2].weight == 0 and got[2].n_features == 0


def test_rare_strings_are_few(spark, monkeypatch):
    monkeypatch.setattr(M, "FREQUENT", 5)
    strings = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate([1] * 50 + [2] * 9 + [4, 5, 9, 100])], "feature string, raw long")
    assert M._least_count(strings) == 4
    assert M._least_count(strings.where("false")) == 1 << 62
