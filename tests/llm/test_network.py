"""The network's forward pass against plain loops, and its gradients against finite differences."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import toxicity as T

TEXTS = ["Some words in a row, and some MORE words", "x", "ünïcode wörds 12 34", "one two three four five six seven eight nine ten eleven"]


@pytest.fixture
def net():
    made = T.Network(hidden=3, embedded=2, table_bits=8, seed=3)
    rng = np.random.default_rng(4)
    made.word_odds, made.gram_odds = (rng.normal(0, 1, 256).astype(np.float32) for _ in range(2))
    made.p = {k: rng.normal(0, 0.5, v.shape).astype(np.float64) for k, v in made.p.items()}
    return made


def read():
    (data, offsets), = T._texts(pa.array(TEXTS, pa.large_string()))
    return T.read_words(data, offsets)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def letters_of(words, i):
    ends = np.append(words.begins, len(words.letters))
    return words.letters[ends[i] : ends[i + 1]].tolist()


def test_forward_by_loops(net):
    words = read()
    x, (at, doc) = net.embed(words), T.windows(words, 4, 2)
    evidence, e, h = net.evidence(words), net.embedded, net.hidden
    for i in range(len(words.hashes)):
        own = [T._LOWER[c] for c in letters_of(words, i)]
        late = [(k + 0.5) / len(own) for k in range(len(own))]
        for j in range(e):
            assert x[i, 3 + j] == pytest.approx(net.p["words"][int(words.hashes[i]) & 4095, j], abs=1e-5)
            assert x[i, 3 + e + j] == pytest.approx(sum(net.p["chars"][c, j] * (1 - w) for c, w in zip(own, late)) / len(own), abs=1e-5)
            assert x[i, 3 + 2 * e + j] == pytest.approx(sum(net.p["chars"][c, j] * w for c, w in zip(own, late)) / len(own), abs=1e-5)
        assert np.allclose(x[i, :3], evidence[i])
    logits = net.run(x, at)
    for line, row in enumerate(at.tolist()):
        places = [i for i in row if i >= 0]
        states = [[0.0] * 2 * h for _ in places]
        for k, way in enumerate("fb"):
            state = [0.0] * h
            for t in range(len(places)) if way == "f" else range(len(places) - 1, -1, -1):
                a = [net.p["B" + way][c] + sum(x[places[t], r] * net.p["W" + way][r, c] for r in range(x.shape[1])) for c in range(3 * h)]
                s = [sum(state[r] * net.p["U" + way][r, c] for r in range(h)) for c in range(3 * h)]
                z = [sigmoid(a[c] + s[c]) for c in range(h)]
                r_ = [sigmoid(a[h + c] + s[h + c]) for c in range(h)]
                new = [math.tanh(a[2 * h + c] + r_[c] * s[2 * h + c]) for c in range(h)]
                state = [z[c] * state[c] + (1 - z[c]) * new[c] for c in range(h)]
                states[t][k * h : (k + 1) * h] = state
        score = [math.exp(sum(v * w for v, w in zip(s, net.p["attend"]))) for s in states]
        pooled = [sum(w * s[c] for w, s in zip(score, states)) / sum(score) for c in range(2 * h)]
        assert logits[line] == pytest.approx(sum(v * w for v, w in zip(pooled, net.p["out"])) + net.p["bias"][0], abs=1e-4)


def test_gradients_by_differences(net):
    words = read()
    at, doc = T.windows(words, 4, 2)
    fixed = net.evidence(words).astype(np.float64)
    y, weight = (doc % 2).astype(np.float64), np.ones(len(doc))

    def loss():
        p = 1 / (1 + np.exp(-net.run(net.embed(words, fixed).astype(np.float64), at)))
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    found = net.gradients(words, net.embed(words, fixed), at, y, weight)
    rng = np.random.default_rng(5)
    for name, g in found.items():
        places = np.flatnonzero(np.abs(g.ravel()) > 1e-4)
        assert len(places)
        for i in rng.choice(places, min(6, len(places)), replace=False):
            flat, step = net.p[name].ravel(), 1e-2
            before = flat[i]
            flat[i] = before + step
            up = loss()
            flat[i] = before - step
            down = loss()
            flat[i] = before
            assert g.ravel()[i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=3e-4), (name, i)


def test_letters_have_an_order(net):
    (data, offsets), = T._texts(pa.array(["abc cba acb"], pa.large_string()))
    words = T.read_words(data, offsets)
    chars = net.embed(words)[:, 3 + net.embedded :]
    assert all(not np.allclose(chars[i], chars[j]) for i in range(3) for j in range(i))
