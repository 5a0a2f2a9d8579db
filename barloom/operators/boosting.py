"""Gradient-boosted trees for any number of classes, with early stopping, grown from histograms that Spark adds up.

Features are put into bins by quantiles once. A round grows a tree for each class, level by level: every task adds its
rows' gradients up by (node, feature, bin), one aggregate adds the tasks' sums, and the driver picks the splits from as
many cells as nodes, features and bins make, whatever the number of rows. Gradients are rounded to whole numbers before they are
added, so sums don't depend on the order of rows or tasks, and a repeated run, or a lost executor, gives the same trees.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from barloom.sources.scratch import discard, written

#: Gradients are added in units of 2**-20.
_UNIT = float(1 << 20)

#: Rounds whose trees are applied anew in each pass, before scores are written again.
_KEEP = 8

#: The cell that holds the validation rows' loss.
_LOSS = -1


@dataclass(frozen=True)
class BoostParams:
    """rounds at most, and rounds without a better validation loss after which to stop; learning rate; leaves and depth of a tree;
    bins of a feature (254 at most); rows of a leaf at least; penalties; shares of features per tree, and of rows, drawn anew every few rounds.
    """

    rounds: int = 1000
    patience: int = 50
    rate: float = 0.05
    leaves: int = 63
    depth: int = 6
    bins: int = 64
    min_rows: int = 50
    l1: float = 0.1
    l2: float = 0.1
    feature_share: float = 0.8
    row_share: float = 0.8
    redraw: int = 5
    seed: int = 42


@dataclass
class Tree:
    """A binary tree in an array: node i has the children 2i+1 and 2i+2. feature is -1 at leaves.

    Bins up to `bin` go left; so do missing values where missing_left.
    """

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def stump(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (rows x features)."""
        node, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            b = bins[every, np.maximum(feature, 0)]
            left = np.where(b == 0, self.missing_left[node], b <= self.bin[node])
            node = np.where(inner, 2 * node + 2 - left, node)

    def plain(self) -> dict:
        return {k: v.tolist() for k, v in vars(self).items()}

    @classmethod
    def of(cls, plain: dict) -> Tree:
        kinds = {"feature": np.int32, "bin": np.int32, "missing_left": bool, "value": float, "gain": float}
        return cls(**{k: np.array(v, kinds[k]) for k, v in plain.items()})


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _binned(values: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins from 1 on, each value in the first whose edge is not below it; 0 for missing ones."""
    out = np.zeros((len(values[0]) if values else 0, len(values)), np.uint8)
    for i, (v, e) in enumerate(zip(values, edges, strict=True)):
        out[:, i] = np.where(np.isnan(v), 0, np.searchsorted(e, v, side="left") + 1)
    return out


def _doubles(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)


@dataclass
class Boosted:
    """A fitted model: rounds of one tree per class. losses has the validation rows' log-loss after each round, from none on."""

    features: list[str]
    classes: int
    edges: list[np.ndarray]
    start: np.ndarray
    trees: list[list[Tree]]
    losses: list[float]

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with `probability`, an array with each class's; nulls and nan in features are missing values."""
        features, edges, start, trees = self.features, self.edges, self.start, self.trees

        @arrow_udf(ArrayType(DoubleType()))
        def probability(*columns: pa.Array) -> pa.Array:
            bins = _binned([_doubles(c) for c in columns], edges)
            p = _softmax(_added(np.tile(start, (len(bins), 1)), bins, trees))
            offsets = np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.reshape(-1)))

        return rows.withColumn("probability", probability(*[F.col(f).cast("double") for f in features]))

    def importance(self, k: int) -> list[tuple[str, float]]:
        """The k features that lowered the loss most, with their gains' sums."""
        gains = np.zeros(len(self.features))
        for tree in (t for one in self.trees for t in one):
            inner = tree.feature >= 0
            np.add.at(gains, tree.feature[inner], tree.gain[inner])
        return sorted(zip(self.features, gains.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]

    def save(self, spark: SparkSession, path: str) -> None:
        plain = {
            "features": self.features,
            "classes": self.classes,
            "edges": [e.tolist() for e in self.edges],
            "start": self.start.tolist(),
            "trees": [[t.plain() for t in one] for one in self.trees],
            "losses": self.losses,
        }
        spark.createDataFrame([(json.dumps(plain),)], "model string").coalesce(1).write.text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        m = json.loads(spark.read.option("wholetext", "true").text(path).first()[0])
        return cls(
            m["features"], m["classes"], [np.array(e, float) for e in m["edges"]], np.array(m["start"]),
            [[Tree.of(t) for t in one] for one in m["trees"]], m["losses"],
        )


def _added(scores: np.ndarray, bins: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    for one in trees:
        for k, tree in enumerate(one):
            scores[:, k] += tree.value[tree.nodes(bins)]
    return scores


def _edges(train: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Per feature up to bins - 1 quantiles of its values: what driver and tasks need to know of the data."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = train.agg(*[F.percentile_approx(F.when(~F.isnan(f), F.col(f)), shares, 100 * bins).alias(f) for f in features]).first()
    return [np.unique(np.array(found[f] or [], float)) for f in features]


def _draw(u: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each row's hash and a salt."""
    x = u ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(33))) / 2.0**64


@dataclass
class _Pass:
    """What a task needs to add its rows up: the trees since scores were written, those that grow, and their open nodes."""

    classes: int
    n_features: int
    width: int
    pending: list[list[Tree]]
    growing: list[Tree]
    open: list[tuple[int, int]]
    row_share: float
    salt: int
    with_loss: bool

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        bins = _fixed(batch.column("bins"), np.uint8, self.n_features)
        scores = _fixed(batch.column("scores"), np.float64, self.classes)
        return bins, _added(scores.copy(), bins, self.pending)

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with the scores of the pending trees added."""
        for batch in batches:
            _, scores = self.read(batch)
            made = pa.array([s.tobytes() for s in scores], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("scores"), "scores", made)

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """cell, g, h, n of the task's rows; the loss of its validation rows as a cell of its own."""
        cells = len(self.open) * self.n_features * self.width
        total = np.zeros((3, cells), np.int64)
        loss, n_loss = 0, 0
        slots = np.full((self.classes, max((len(t.feature) for t in self.growing), default=1)), -1, np.int64)
        for slot, (k, node) in enumerate(self.open):
            slots[k, node] = slot
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, scores = self.read(batch)
            p = _softmax(scores)
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            held = batch.column("held").to_numpy(zero_copy_only=False)
            if self.with_loss and held.any():
                own = np.maximum(p[held, label[held]], 1e-15)
                loss -= int(np.rint(np.log(own) * _UNIT).astype(np.int64).sum())
                n_loss += int(held.sum())
            if not cells:
                continue
            used = ~held & (_draw(batch.column("u").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), self.salt) < self.row_share)
            for k in range(self.classes):
                slot = slots[k, self.growing[k].nodes(bins)]
                rows = used & (slot >= 0)
                if not rows.any():
                    continue
                at = (slot[rows][:, None] * self.n_features + np.arange(self.n_features)) * self.width + bins[rows]
                own = p[rows, k]
                g = np.rint((own - (label[rows] == k)) * _UNIT)
                # as is usual for a softmax, whose classes' scores move together
                h = np.rint(own * (1 - own) * self.classes / (self.classes - 1) * _UNIT)
                for i, w in enumerate((g, h, None)):
                    weights = None if w is None else np.repeat(w, self.n_features)
                    # sums of whole numbers below 2**53 are exact
                    total[i] += np.bincount(at.reshape(-1), weights, cells).astype(np.int64)
        full = np.flatnonzero(total[2])
        columns = [full, *total[:, full]]
        if n_loss:
            columns = [np.append(c, x) for c, x in zip(columns, (_LOSS, loss, 0, n_loss), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cell", "g", "h", "n"])


def _fixed(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Binary values of one length as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(kind).reshape(len(column), width)


def _aggregated(table: DataFrame, step: _Pass) -> tuple[np.ndarray, float | None]:
    """Sums of gradients, curvatures and rows by open node, feature and bin, and the mean validation loss if asked for."""
    made = table.mapInArrow(step.sums, "cell long, g long, h long, n long").groupBy("cell")
    found = made.agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).toArrow()
    cell, *values = (found.column(c).to_numpy() for c in ("cell", "g", "h", "n"))
    sums = np.zeros((3, len(step.open) * step.n_features * step.width))
    inner = cell >= 0
    for i, v in enumerate(values):
        sums[i, cell[inner]] = v[inner] / (1.0 if i == 2 else _UNIT)
    told = np.flatnonzero(cell == _LOSS)
    loss = float(values[0][told[0]] / _UNIT / values[2][told[0]]) if len(told) else None
    return sums.reshape(3, len(step.open), step.n_features, step.width), loss


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _worth(g: np.ndarray, h: np.ndarray, p: BoostParams) -> np.ndarray:
    return _shrunk(g, p.l1) ** 2 / (h + p.l2)


def _splits(sums: np.ndarray, allowed: list[np.ndarray], step: _Pass, p: BoostParams) -> list[tuple]:
    """Of each open node that a split serves: (gain, class, node, feature, bin, missing_left, value left, value right)."""
    out = []
    for slot, (k, node) in enumerate(step.open):
        g, h, n = sums[:, slot]
        total = g[0].sum(), h[0].sum(), n[0].sum()
        best: tuple | None = None
        for missing_left in (False, True):
            left = [np.cumsum(x[:, 1:], axis=1) + (x[:, :1] if missing_left else 0) for x in (g, h, n)]
            right = [t - x for t, x in zip(total, left, strict=True)]
            gain = _worth(left[0], left[1], p) + _worth(right[0], right[1], p) - _worth(*map(np.float64, total[:2]), p)
            fits = (left[2] >= p.min_rows) & (right[2] >= p.min_rows) & allowed[k][:, None]
            gain = np.where(fits, gain, 0.0)
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            # without missing values both sides are alike; they then go where more rows are
            if gain[f, b] > 1e-9 and (best is None or gain[f, b] > best[0] or (n[f, 0] == 0 and gain[f, b] == best[0] and left[2][f, b] > right[2][f, b])):
                values = [float(-p.rate * _shrunk(s[0][f, b], p.l1) / (s[1][f, b] + p.l2)) for s in (left, right)]
                best = (float(gain[f, b]), k, node, int(f), int(b) + 1, missing_left, *values)
        if best is not None:
            out.append(best)
    return out


def _grown(table: DataFrame, step: _Pass, p: BoostParams, round_: int) -> tuple[list[Tree], float | None]:
    """The trees of one round, and the validation loss before it."""
    rng = np.random.default_rng([p.seed, round_])
    some = max(1, math.ceil(p.feature_share * step.n_features))
    allowed = []
    for _ in range(step.classes):
        chosen = np.zeros(step.n_features, bool)
        chosen[rng.permutation(step.n_features)[:some]] = True
        allowed.append(chosen)
    trees, leaves, loss = [Tree.stump(p.depth) for _ in range(step.classes)], [1] * step.classes, None
    open_ = [(k, 0) for k in range(step.classes)]
    for level in range(p.depth):
        here = replace(step, growing=trees, open=open_, with_loss=level == 0)
        sums, told = _aggregated(table, here)
        loss = told if level == 0 else loss
        open_ = []
        for gain, k, node, f, b, missing_left, *values in sorted(_splits(sums, allowed, here, p), key=lambda s: (-s[0], *s[1:3])):
            if leaves[k] == p.leaves:
                continue
            leaves[k] += 1
            t = trees[k]
            t.feature[node], t.bin[node], t.missing_left[node], t.gain[node] = f, b, missing_left, gain
            for side in (0, 1):
                t.value[2 * node + 1 + side] = values[side]
                open_.append((k, 2 * node + 1 + side))
        open_ = sorted(x for x in open_ if leaves[x[0]] < p.leaves)
        if not open_:
            break
    return trees, loss


def fit_boosted(
    rows: DataFrame, features: Sequence[str], label: str = "label", held: str | None = "is_valid", classes: int = 3, p: BoostParams = BoostParams()
) -> Boosted:
    """Trees fitted to the rows of which `held` is not true, up to the round after which the others' log-loss was least.

    Rows without a label from 0 to classes - 1 are left out; a null in `held` is false. Without held rows, or held=None, all rounds are fitted. Nulls and
    nan in features are missing values, which go to the better side of each split. Rows that are equal are drawn alike. Without
    training rows the classes are equally likely. Classes that don't occur have a small chance.
    """
    features = list(features)
    y = F.col(label).cast("int")
    keep = rows.where(y.between(0, classes - 1)).select(
        *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
        y.alias("label"),
        (F.coalesce(F.col(held).cast("boolean"), F.lit(False)) if held else F.lit(False)).alias("held"),
    )
    names = [f"x{i}" for i in range(len(features))]
    keep = keep.withColumn("u", F.xxhash64(*names, "label"))
    train = keep.where(~F.col("held"))
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    n = sum(counts.values())
    start = np.log(np.array([max(counts.get(k, 0), 0.5) for k in range(classes)]) / max(n, 1))
    edges = _edges(train, names, p.bins)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = _binned([_doubles(b.column(c)) for c in names], edges)
            columns = [b.column("label"), b.column("held"), b.column("u"), pa.array([x.tobytes() for x in bins], pa.binary())]
            columns.append(pa.array([start.tobytes()] * len(bins), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["label", "held", "u", "bins", "scores"])

    kind = "label int, held boolean, u long, bins binary, scores binary"
    table = written(keep.mapInArrow(prepare, kind), "boost")
    width = max((len(e) for e in edges), default=0) + 2
    model = Boosted(features, classes, edges, start, [], [])
    if not n:
        return model
    step = _Pass(classes, len(features), width, [], [], [], p.row_share, 0, False)
    best, has_held = 0, True
    for round_ in range(p.rounds + 1):
        step = replace(step, salt=p.seed * 1_000_003 + round_ // p.redraw)
        if round_ == p.rounds:
            if has_held:
                model.losses += [x for x in [_aggregated(table, replace(step, growing=[], open=[], with_loss=True))[1]] if x is not None]
            break
        trees, loss = _grown(table, step, p, round_)
        has_held = loss is not None
        if has_held:
            model.losses.append(loss)
            best = round_ if loss < model.losses[best] else best
            if round_ - best >= p.patience:
                break
        if all(t.feature[0] < 0 for t in trees):
            break
        model.trees.append(trees)
        step.pending.append(trees)
        if len(step.pending) == _KEEP:
            old, table = table, written(table.mapInArrow(step.scored, kind), "boost")
            discard(old)
            step = replace(step, pending=[])
    discard(table)
    if model.losses:
        del model.trees[int(np.argmin(model.losses)) :]
    return model

