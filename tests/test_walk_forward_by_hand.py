"""A walk-forward run against plain Python: folds by the calendar, purge and embargo by counting, both regressions by Newton's steps."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from barloom.config import FoldParams
from barloom.operators import study
from barloom.operators.validation import data_range, folds

T0 = datetime(2024, 1, 1)
PARAMS = FoldParams(train_months=2, val_months=1, oot_months=1, step_months=1, purge=3, embargo=2, min_rows=20)


def newton(x, y, classes, ridge, free=1):
    """Coefficients (features, then the intercept) by class of a softmax regression; the last `free` columns aren't penalised."""
    n, m = x.shape
    w = np.zeros((classes, m))
    hot = np.eye(classes)[y]
    penalty = np.r_[np.full(m - free, ridge), np.zeros(free)]
    for _ in range(60):
        s = x @ w.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = ((p - hot).T @ x / n + penalty * w).reshape(-1)
        hess = np.zeros((classes * m, classes * m))
        for a in range(classes):
            for b in range(classes):
                k = p[:, a] * ((a == b) - p[:, b])
                hess[a * m : a * m + m, b * m : b * m + m] = (x * k[:, None]).T @ x / n + (a == b) * np.diag(penalty)
        step = np.linalg.lstsq(hess, grad, rcond=None)[0]
        w -= step.reshape(classes, m)
        if np.abs(step).max() < 1e-10:
            break
    return w


def softmax(s):
    p = np.exp(s - s.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def platt(p, y):
    """Slope and offset of a logistic regression whose slope has a penalty of one over the number of rows."""
    a = b = 0.0
    n = len(p)
    for _ in range(100):
        q = 1 / (1 + np.exp(-(a * p + b)))
        grad = np.array([((q - y) * p).mean() + a / n, (q - y).mean()])
        k = q * (1 - q)
        hess = np.array([[(k * p * p).mean() + 1 / n, (k * p).mean()], [(k * p).mean(), k.mean()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
    return a, b


def by_hand(rows):
    """(fold, bar): the three calibrated chances."""
    out = {}
    month = lambda t: t.month - 1
    for fold in range(1, 20):
        val, oot = 2 + fold - 1, 3 + fold - 1
        if oot + 1 > 6:
            break
        train = [r for r in rows if month(r[2]) < val][: -PARAMS.purge]
        held = [r for r in rows if month(r[2]) == val]
        test = [r for r in rows if month(r[2]) == oot][PARAMS.embargo :]
        x = np.array([[r[3], r[4]] for r in train])
        mean, dev = x.mean(axis=0), x.std(axis=0, ddof=1)
        ready = lambda part: np.c_[(np.array([[r[3], r[4]] for r in part]) - mean) / dev, np.ones(len(part))]  # noqa: B023, E731
        w = newton(ready(train), np.array([r[5] for r in train]), 3, 0.01)
        raw = softmax(ready(held) @ w.T)
        made = softmax(ready(test) @ w.T)
        y = np.array([r[5] for r in held])
        cal = np.empty_like(made)
        for k in range(3):
            a, b = platt(raw[:, k], (y == k).astype(float))
            cal[:, k] = 1 / (1 + np.exp(-(a * made[:, k] + b)))
        cal /= cal.sum(axis=1, keepdims=True)
        out |= {(fold, r[1]): tuple(c) for r, c in zip(test, cal, strict=True)}
    return out


def test_walk_forward_equals_plain_python(spark):
    rng, made = random.Random(18), []
    for i in range(6 * 122):
        t, x = T0 + timedelta(hours=6 * i), rng.gauss(0, 1)
        label = (0 if x > 0.6 else 1 if x < -0.6 else 2) if rng.random() < 0.85 else rng.randrange(3)
        if t < datetime(2024, 7, 1):
            made.append(("A", i, t, x, rng.gauss(0, 1), label))
    rows = spark.createDataFrame(made, "symbol string, bar_id long, bar_close_ts timestamp, x double, noise double, label int").repartition(3)
    span = data_range(rows, "bar_close_ts").first()
    calendar = folds(spark, str(span["data_start"]), str(span["data_end"]), PARAMS)
    got = {(r.fold_id, r.bar_id): (r.p_long, r.p_short, r.p_neutral) for r in study.walk_forward(rows, calendar, ["x", "noise"], PARAMS, kind="logistic").collect()}
    want = by_hand(made)
    assert set(got) == set(want) and {f for f, _ in want} == {1, 2, 3}
    for key, p in want.items():
        assert got[key] == pytest.approx(p, abs=2e-3), key
