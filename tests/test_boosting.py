"""Boosted trees: against a plain reimplementation, early stopping, missing values, repeated runs, leaks, and their use."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import boosting as B
from barloom.operators import models, study
from barloom.operators.validation import log_loss

T0 = datetime(2024, 1, 1)
SMALL = B.BoostParams(rounds=12, patience=5, rate=0.2, leaves=6, depth=3, bins=16, min_rows=10)


def frame(spark, x, y, held=None):
    held = np.zeros(len(y), bool) if held is None else held
    rows = [(i, *map(float, v), int(c), bool(h)) for i, (v, c, h) in enumerate(zip(x, y, held, strict=True))]
    names = ", ".join(f"f{j} double" for j in range(x.shape[1]))
    return spark.createDataFrame(rows, f"bar_id long, {names}, label int, is_valid boolean").repartition(4)


def loss(model, rows, classes=3):
    made = model.transform(rows)
    return made.agg(F.avg(-F.log(F.get("probability", F.col("label"))))).first()[0]


def plain_round(bins, y, scores, p, classes):
    """One round by loops over rows, features and bins, all rows and features drawn."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    prob = e / e.sum(axis=1, keepdims=True)
    out = scores.copy()
    for k in range(classes):
        g = np.rint((prob[:, k] - (y == k)) * 2**20) / 2**20
        h = np.rint(prob[:, k] * (1 - prob[:, k]) * classes / (classes - 1) * 2**20) / 2**20
        worth = lambda a: max(abs(g[a].sum()) - p.l1, 0) ** 2 / (h[a].sum() + p.l2)  # noqa: B023, E731
        nodes, leaves = [np.arange(len(y))], 1
        for _ in range(p.depth):
            found = []
            for at in nodes:
                best = None
                for f in range(bins.shape[1]):
                    for b in range(1, bins[:, f].max() + 1):
                        left = at[bins[at, f] <= b]
                        right = at[bins[at, f] > b]
                        if min(len(left), len(right)) < p.min_rows:
                            continue
                        gain = worth(left) + worth(right) - worth(at)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = gain, left, right
                if best is not None:
                    found.append(best)
            nodes = []
            for _, left, right in sorted(found, key=lambda s: -s[0]):
                if leaves == p.leaves:
                    break
                leaves += 1
                nodes += [left, right]
                for a in (left, right):
                    value = -p.rate * math.copysign(max(abs(g[a].sum()) - p.l1, 0), g[a].sum()) / (h[a].sum() + p.l2)
                    out[a, k] = scores[a, k] + value
            nodes.sort(key=lambda a: a[0])
    return out


def test_equals_loops(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3))
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.4, 0, np.where(x[:, 0] * x[:, 1] < -0.3, 1, 2))
    p = B.BoostParams(rounds=3, rate=0.3, leaves=5, depth=3, bins=8, min_rows=8, feature_share=1.0, row_share=1.0)
    rows = frame(spark, x, y)
    model = B.fit_boosted(rows, ["f0", "f1", "f2"], held=None, p=p)
    assert len(model.trees) == 3 and model.losses == []
    bins = B._binned([x[:, j] for j in range(3)], model.edges)
    scores = np.tile(model.start, (len(y), 1))
    for _ in range(3):
        scores = plain_round(bins, y, scores, p, 3)
    want = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    got = {r.bar_id: r.probability for r in model.transform(rows).collect()}
    assert np.allclose([got[i] for i in range(len(y))], want, atol=1e-6)


def test_beats_the_forest_and_is_repeatable(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1600, 5))
    # what a feature says depends on two others
    y = np.where(x[:, 0] * x[:, 1] > 0.2, 0, np.where(x[:, 2] + x[:, 0] > 0.5, 1, 2))
    held = np.arange(1600) >= 1200
    rows, names = frame(spark, x, y, held), [f"f{j}" for j in range(5)]
    p = B.BoostParams(rounds=30, patience=10, rate=0.25, leaves=12, depth=4, bins=32, min_rows=10)
    model = B.fit_boosted(rows, names, p=p)
    test = rows.where("is_valid")
    forest = models.predict(models.fit_classifier(rows.where("NOT is_valid"), names, kind="forest"), test)
    theirs = forest.agg(log_loss(F.array("p_long", "p_short", "p_neutral"), F.col("label"))).first()[0]
    ours = loss(model, test)
    assert ours < 0.8 * theirs and ours == pytest.approx(min(model.losses), abs=1e-5)
    again = B.fit_boosted(rows.repartition(7), names, p=p)
    assert again.losses == model.losses and all(np.array_equal(a.value, b.value) for x, z in zip(model.trees, again.trees, strict=True) for a, b in zip(x, z, strict=True))
    assert {f for f, _ in model.importance(3)} == {"f0", "f1", "f2"} and models.importance(model, names, 1)[0][0] in ("f0", "f1")


def test_stops_early_on_noise(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(600, 3)), rng.integers(0, 3, 600)
    p = B.BoostParams(rounds=60, patience=4, rate=0.5, leaves=8, depth=3, bins=16, min_rows=10)
    model = B.fit_boosted(frame(spark, x, y, np.arange(600) >= 400), ["f0", "f1", "f2"], p=p)
    best = int(np.argmin(model.losses))
    assert len(model.losses) == best + 5 < 60 and len(model.trees) == best
    assert loss(model, frame(spark, x[400:], y[400:])) <= model.losses[0] + 1e-6


def test_leak_is_seen(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 700)
    x = np.stack([rng.normal(size=700), y + 0.01 * rng.normal(size=700)], axis=1)
    rows = frame(spark, x, y, np.arange(700) >= 500)
    ratio = {n: loss(B.fit_boosted(rows, [f"f{j}" for j in range(n)], p=SMALL), rows.where("is_valid")) / math.log(3) for n in (1, 2)}
    assert ratio[1] > 0.7 and ratio[2] < 0.5


def test_missing_values_and_odd_tables(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2))
    y = np.where(rng.random(400) < 0.5, 1, 0)
    # that a value is missing tells the class
    x[y == 1, 0] = np.nan
    rows = frame(spark, x, y).withColumn("f0", F.when(F.isnan("f0") & (F.col("bar_id") % 2 == 0), None).otherwise(F.col("f0")))
    odd = rows.limit(3).withColumn("label", F.lit(-1)).unionAll(rows.limit(2).withColumn("label", F.lit(None).cast("int")))
    model = B.fit_boosted(rows.unionAll(odd), ["f0", "f1"], classes=2, p=SMALL)
    assert loss(model, rows, 2) < 0.2
    model.save(spark, str(tmp_path / "m"))
    back = B.Boosted.load(spark, str(tmp_path / "m"))
    told = [{r.bar_id: r.probability for r in m.transform(rows).collect()} for m in (model, back)]
    assert told[0] == told[1]
    none = B.fit_boosted(rows.where("false"), ["f0", "f1"], p=SMALL)
    assert none.trees == [] and [round(v, 9) for v in none.transform(rows).first().probability] == [round(1 / 3, 9)] * 3
    one = B.fit_boosted(rows.where("label = 1"), ["f0"], p=SMALL)
    assert one.transform(rows).first().probability[1] > 0.95
    same = B.fit_boosted(rows.withColumn("f0", F.lit(1.0)), ["f0"], p=SMALL)
    assert same.trees == []


def test_meta_label_keeps_its_last_fifth_apart(spark, monkeypatch):
    rng = np.random.default_rng(2)
    made = [("A", i, 1 + i // 40, T0 + timedelta(hours=i), float(v), int(v > 0)) for i, v in enumerate(rng.normal(size=240))]
    rows = spark.createDataFrame(made, "symbol string, bar_id long, fold_id int, bar_close_ts timestamp, f double, win int")
    seen = {}
    fit = models.fit_boosted

    def spy(placed, *a):
        seen.update({r["is_valid"]: (r["a"], r["b"]) for r in placed.groupBy("is_valid").agg(F.min("bar_id").alias("a"), F.max("bar_id").alias("b")).collect()})
        return fit(placed, *a)

    monkeypatch.setattr(models, "fit_boosted", spy)
    late = models.meta_label(rows, ["f"], 5, boost=B.BoostParams(rounds=10, patience=3, rate=0.3, leaves=4, depth=2, min_rows=10))
    assert seen == {False: (0, 127), True: (128, 159)}
    assert late.agg(F.avg(((F.col("meta_proba") > 0.5).cast("int") == F.col("win")).cast("int"))).first()[0] > 0.9


def test_train_and_save(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 2))
    y = np.where(x[:, 0] > 0.4, 0, np.where(x[:, 0] < -0.4, 1, 2))
    y[::50] = -1
    rows = frame(spark, x, y).withColumn("bar_close_ts", F.timestamp_seconds(F.col("bar_id") * 3600))
    told = [study.train_and_save(rows, ["f0", "f1"], str(tmp_path), v, boost=SMALL) for v in ([], ["v1"])]
    assert [t["version"] for t in told] == ["v1", "v2"] and told[0] == {**told[1], "version": "v1"}
    assert (told[0]["n_train"], told[0]["n_held"]) == (392, 98) and told[0]["top"][0][0] == "f0" and told[0]["loss"] < 0.5
    made = study.load_trained(spark, str(tmp_path), "v1")(rows.where("label >= 0"))
    right = made.select(F.array("p_long", "p_short", "p_neutral").alias("p"), "label").where("array_position(p, array_max(p)) - 1 = label").count()
    assert right > 0.85 * 490
