"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import mix64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Letters of words: ASCII letters and digits, and all of UTF-8's other bytes.
_LETTER = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _LETTER[_a:_b] = True
_GRAMS = (3, 4, 5)
_STEP = 1 << 19


@dataclass
class Words:
    """The words of some documents: per word the index of a distinct one; what each distinct one looks like."""

    index: np.ndarray  # of each word among the distinct ones
    upto: np.ndarray  # words before each document's end
    hashes: np.ndarray  # of the distinct words
    letters: np.ndarray  # their bytes, one after the other
    begins: np.ndarray  # where each one's bytes begin


def _ragged(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions begins[i] .. begins[i] + lengths[i] - 1 for all i."""
    shift = begins - (np.cumsum(lengths) - lengths)
    return np.arange(int(lengths.sum())) + np.repeat(shift, lengths)


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = _LETTER[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    upto = np.searchsorted(starts, offsets[1:])
    none = np.zeros(0, np.int64)
    if not len(starts):
        return Words(none, upto, np.zeros(0, np.uint64), none, none)
    letters = data[solid]
    begins = (np.cumsum(solid) - 1)[starts]
    lengths = np.diff(np.append(begins, len(letters)))
    place = np.arange(len(letters)) - np.repeat(begins, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE | np.uint64(1)))
    hashes = mix64(np.add.reduceat(_BYTE[letters] * powers[place], begins))
    distinct, at, index = np.unique(hashes, return_index=True, return_inverse=True)
    own = letters[_ragged(begins[at], lengths[at])]
    return Words(index, upto, distinct, own, np.cumsum(lengths[at]) - lengths[at])


def _together(parts: list[Words]) -> Words:
    """The words of several lists of documents as one."""
    hashes, at = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True)
    begins, letters, shift = [], [], 0
    for p in parts:
        begins.append(p.begins + shift)
        letters.append(p.letters)
        shift += len(p.letters)
    lengths = np.concatenate([np.diff(np.append(p.begins, len(p.letters))) for p in parts])[at]
    own = np.concatenate(letters)[_ragged(np.concatenate(begins)[at], lengths)] if len(at) else letters[0]
    index = np.concatenate([np.searchsorted(hashes, p.hashes)[p.index] for p in parts])
    ends = np.cumsum([0, *(len(p.index) for p in parts)])
    upto = np.concatenate([p.upto + e for p, e in zip(parts, ends[:-1], strict=True)])
    return Words(index, upto, hashes, own, np.cumsum(lengths) - lengths)


def _gram_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of each distinct word, word by word; where each word's begin.

    A word has one mark before it and one after it.
    """
    lengths = np.diff(np.append(words.begins, len(words.letters)))
    full = lengths + 2
    begins = np.cumsum(full) - full
    marked = np.full(int(full.sum()), 1, np.uint64)
    marked[_ragged(begins + 1, lengths)] = _BYTE[words.letters]
    end = np.repeat(begins + full, full)
    n = len(marked)
    padded = np.append(marked, np.zeros(max(_GRAMS), np.uint64))
    rolled = np.zeros(n, np.uint64)
    columns, valid = [], []
    for i in range(max(_GRAMS)):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + padded[i : i + n]
        if i + 1 in _GRAMS:
            columns.append(mix64(rolled + np.uint64(i)))
            valid.append(np.arange(n) + i < end)
    valid[0] |= np.arange(n) == np.repeat(begins, full)  # every word has one at least
    hashes, ok = np.stack(columns, 1).ravel(), np.stack(valid, 1)
    per = ok.sum(1)
    counts = np.add.reduceat(per, begins)
    return hashes[ok.ravel()], np.cumsum(counts) - counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.negative(x)
    np.minimum(out, 80, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


class Network:
    """Per word: its evidence and an embedding, and those of its characters in order; a gated recurrence both ways; attention.

    The characters' embeddings are summed twice, weighted towards the word's beginning and towards its end.

    The evidence of a word and of its character n-grams is a smoothed log-odds
    of the documents that hold it, counted over the training rows into tables of
    2**table_bits cells. The rest is learned by gradient descent.
    """

    def __init__(self, hidden: int = 8, embedded: int = 4, table_bits: int = 18, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.embedded, self.table_bits = hidden, embedded, table_bits
        size = 1 << table_bits
        self.word_odds = np.zeros(size, np.float32)
        self.gram_odds = np.zeros(size, np.float32)
        d = 3 + 3 * embedded
        init = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {"words": init(4096, embedded) * 0.1, "chars": init(256, embedded) * 0.1}
        for way in "fb":
            self.p |= {f"W{way}": init(d, 3 * hidden), f"U{way}": init(hidden, 3 * hidden), f"B{way}": init(3 * hidden) * 0}
        self.p |= {"attend": init(2 * hidden), "out": init(2 * hidden), "bias": np.zeros(1, np.float32)}

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.table_bits)).astype(np.int64)

    def evidence(self, words: Words) -> np.ndarray:
        """Of each distinct word: its own log-odds, and the highest and the mean of its n-grams'."""
        cell, counts = self.gram_cells(words)
        odds, begins = self.gram_odds[cell], np.cumsum(counts) - counts
        own = self.word_odds[self.cells(words.hashes)]
        return np.stack([own, np.maximum.reduceat(odds, begins), np.add.reduceat(odds, begins) / counts], 1).astype(np.float32)

    def gram_cells(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The cells of the distinct words' n-grams, word by word, and how many each word has; some words at a time."""
        cells, counts = [], []
        for i in range(0, len(words.hashes), 1 << 15):
            grams, begins = _gram_hashes(_take(words, np.arange(i, min(i + (1 << 15), len(words.hashes)))))
            cells.append(self.cells(grams).astype(np.int32))
            counts.append(np.diff(np.append(begins, len(grams))))
        return np.concatenate(cells), np.concatenate(counts)

    def embed(self, words: Words, fixed: np.ndarray | None = None) -> np.ndarray:
        fixed = self.evidence(words) if fixed is None else fixed
        cell = (words.hashes & np.uint64(4095)).astype(np.int64)
        lengths, late = _late(words)
        letters = self.p["chars"][_LOWER[words.letters]]
        end = np.add.reduceat(letters * late, words.begins, axis=0) / lengths[:, None]
        begin = np.add.reduceat(letters, words.begins, axis=0) / lengths[:, None] - end
        return np.hstack([fixed, self.p["words"][cell], begin.astype(np.float32), end.astype(np.float32)])

    def feed(self, x: np.ndarray, way: str) -> np.ndarray:
        """What each input gives to the gates of one way, and a last row for places beyond a window's end."""
        return np.vstack([x @ self.p["W" + way] + self.p["B" + way], np.zeros((1, 3 * self.hidden), np.float32)])

    def run(self, x: np.ndarray, at: np.ndarray, keep: bool = False, fed_both: dict | None = None):
        """Logits of windows; x: inputs of distinct words, at: their index per window and place, -1 beyond its end.

        fed_both: feed() of both ways, where it is known.
        """
        h, (n, length) = self.hidden, at.shape
        live = (at >= 0).astype(np.float32)
        out = np.empty((length, n, 2 * h), np.float32)
        whole = live.all(0)
        saved = {}
        for k, way in enumerate("fb"):
            fed = fed_both[way] if fed_both else self.feed(x, way)
            u, state = self.p["U" + way], np.zeros((n, h), np.float32)
            steps = []
            for t in range(length) if way == "f" else range(length - 1, -1, -1):
                a, m = fed.take(at[:, t], axis=0, mode="wrap"), live[:, t : t + 1]
                s = state @ u
                g = _sigmoid(a[:, : 2 * h] + s[:, : 2 * h])
                z, r = g[:, :h], g[:, h:]
                c = np.tanh(a[:, 2 * h :] + r * s[:, 2 * h :])
                new = state - c
                new *= z
                new += c
                if not whole[t]:
                    new = state + m * (new - state)
                if keep:
                    steps.append((t, state, z, r, c, s[:, 2 * h :], m))
                state = new
                out[t, :, k * h : (k + 1) * h] = state
            saved[way] = steps
        score = np.where(live.T > 0, out @ self.p["attend"], -1e9)
        score = np.exp(score - score.max(0))
        share = score / score.sum(0)
        pooled = np.einsum("tn,tnh->nh", share, out)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, out, share, pooled, saved) if keep else logit

    def gradients(self, words: Words, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        h, d = self.hidden, self.embedded
        logit, out, share, pooled, saved = self.run(x, at, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dl = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g["bias"][0], g["out"] = dl.sum(), pooled.T @ dl
        dp = dl[:, None] * self.p["out"]
        dshare = np.einsum("tnh,nh->tn", out, dp)
        dscore = share * (dshare - (share * dshare).sum(0))
        g["attend"] = np.einsum("tn,tnh->h", dscore, out)
        dout = share[:, :, None] * dp[None] + dscore[:, :, None] * self.p["attend"]
        dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        for k, way in enumerate("fb"):
            u, w = self.p["U" + way], self.p["W" + way]
            carry = np.zeros((len(y), h), np.float32)
            for t, state, z, r, c, s, m in reversed(saved[way]):
                dh = dout[t, :, k * h : (k + 1) * h] + carry
                dnew = dh * m
                dc = dnew * (1 - z) * (1 - c * c)
                dz = dnew * (state - c) * z * (1 - z)
                dr = dc * s * r * (1 - r)
                da = np.hstack([dz, dr, dc])
                ds = np.hstack([dz, dr, dc * r])
                carry = dh * (1 - m) + dnew * z + ds @ u.T
                g["U" + way] += state.T @ ds
                g["B" + way] += da.sum(0)
                fed = np.where(m > 0, x[at[:, t]], 0)
                g["W" + way] += fed.T @ da
                np.add.at(dx, at[:, t], (da @ w.T) * m)
        dx = dx[:-1]
        used = np.flatnonzero(np.abs(dx).sum(1))
        lengths, late = _late(words)
        cell = (words.hashes & np.uint64(4095)).astype(np.int64)
        np.add.at(g["words"], cell[used], dx[used, 3 : 3 + d])
        own = _ragged(words.begins[used], lengths[used])
        begin, end = (np.repeat(dx[used, 3 + i * d : 3 + (i + 1) * d] / lengths[used, None], lengths[used], axis=0) for i in (1, 2))
        np.add.at(g["chars"], _LOWER[words.letters[own]], begin * (1 - late[own]) + end * late[own])
        return g


def _late(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' lengths, and how far towards its word's end each letter stands, from 0 to 1."""
    lengths = np.diff(np.append(words.begins, len(words.letters)))
    place = np.arange(len(words.letters)) - np.repeat(words.begins, lengths)
    return lengths, ((place + 0.5) / np.repeat(lengths, lengths)).astype(np.float32)[:, None]


def windows(words: Words, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows, the last ones shorter: word indices (-1 beyond the end), and each one's document."""
    begin = np.concatenate([[0], words.upto[:-1]])
    count = words.upto - begin
    per = np.where(count > 0, 1 + -(-np.maximum(count - size, 0) // stride), 0)
    doc = np.repeat(np.arange(len(count)), per)
    start = _ragged(np.zeros(len(per), np.int64), per) * stride
    place = start[:, None] + np.arange(size)
    inside = place < count[doc][:, None]
    at = np.where(inside, (begin[doc][:, None] + place), 0)
    return np.where(inside, words.index[at], -1) if len(doc) else np.zeros((0, size), np.int64), doc


def _texts(texts: pa.Array):
    """Buffers of some texts at a time: data, offsets."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + _STEP, side="right")) - 1), len(texts))
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _logits(net: Network, x: np.ndarray, at: np.ndarray, block: int = 2048) -> np.ndarray:
    fed = {way: net.feed(x, way) for way in "fb"}
    return np.concatenate([net.run(x, at[i : i + block], fed_both=fed) for i in range(0, len(at), block)] or [np.zeros(0, np.float32)])


def score_texts(net: Network | None, texts: pa.Array, size: int, stride: int) -> np.ndarray:
    """Per text its highest window's score; 0 for texts without words, or without a network."""
    out = []
    for data, offsets in _texts(texts):
        best = np.full(len(offsets) - 1, -np.inf)
        if net is not None:
            words = read_words(data, offsets)
            if len(words.index):
                at, doc = windows(words, size, stride)
                np.maximum.at(best, doc, _logits(net, net.embed(words), at))
        out.append(np.where(np.isfinite(best), _sigmoid(best), 0.0))
    return np.concatenate(out) if out else np.zeros(0)


def _counts(cells: int, cell: np.ndarray, counts: np.ndarray, begins: np.ndarray, doc: np.ndarray, word: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many documents of each of four groups hold each cell; some documents at a time.

    doc, word: which document holds which distinct word, in order of documents.
    """
    out = np.zeros((4, cells), np.int64)
    i = 0
    while i < len(doc):
        j = int(np.searchsorted(doc, doc[min(i + 100_000, len(doc) - 1)], side="right"))
        w, d = word[i:j], doc[i:j]
        seen = np.unique(np.repeat(d, counts[w]) * cells + cell[_ragged(begins[w], counts[w])])
        for g in range(4):
            out[g] += np.bincount((seen % cells)[group[seen // cells] == g], minlength=cells)
        i = j
    return out


def _odds(with_label: np.ndarray, without: np.ndarray, n1: int, n0: int, smooth: float = 1.0) -> np.ndarray:
    """Smoothed log-odds of each cell from the number of documents of either label that hold it."""
    odds = np.log((with_label + smooth) / (n1 + 2 * smooth)) - np.log((without + smooth) / (n0 + 2 * smooth))
    return odds.astype(np.float32)


def _take(words: Words, used: np.ndarray) -> Words:
    """Some of the distinct words."""
    lengths = np.diff(np.append(words.begins, len(words.letters)))[used]
    letters = words.letters[_ragged(words.begins[used], lengths)]
    return Words(np.zeros(0, np.int64), words.upto, words.hashes[used], letters, np.cumsum(lengths) - lengths)


def train(
    texts: list[str | None] | pa.Array, labels: np.ndarray, size: int, stride: int, rounds: int = 3, rate: float = 0.02, seed: int = 7
) -> Network | None:
    """A network from labelled texts; None if a label is missing.

    A text's label is that of its highest window: each round takes that window
    of every text, and as many others of the texts labelled 0, then learns from
    them. The evidence that a text shows in training is counted over the other
    half of the texts, so the network learns how far to trust evidence on new ones.
    """
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        return None
    net, rng = Network(seed=seed), np.random.default_rng(seed)
    n_texts = len(texts)
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    words = _together([read_words(data, offsets) for data, offsets in _texts(texts)])
    del texts
    if not len(words.index):
        return None
    n = len(words.hashes)
    half = np.zeros(n_texts, np.int64)
    for y in (0, 1):
        half[np.flatnonzero(labels == y)[1::2]] = 1
    doc_of_word = np.repeat(np.arange(n_texts), np.diff(np.concatenate([[0], words.upto])))
    held = np.unique(doc_of_word * n + words.index)
    del doc_of_word
    doc, word = held // n, held % n
    gram_cell, counts = net.gram_cells(words)
    begins = np.cumsum(counts) - counts
    group, cells = labels + 2 * half, 1 << net.table_bits
    one = np.ones(n, np.int64)
    of_words = _counts(cells, net.cells(words.hashes), one, np.arange(n), doc, word, group)
    of_grams = _counts(cells, gram_cell, counts, begins, doc, word, group)
    docs_in = np.bincount(group, minlength=4)
    del held, doc, word, gram_cell, counts, begins, one

    def count(halves: list[int]) -> None:
        g0, g1 = [2 * h for h in halves], [2 * h + 1 for h in halves]
        of = docs_in[g1].sum(), docs_in[g0].sum()
        net.word_odds = _odds(of_words[g1].sum(0), of_words[g0].sum(0), *of)
        net.gram_odds = _odds(of_grams[g1].sum(0), of_grams[g0].sum(0), *of)

    fixed = []
    for h in (0, 1):
        count([1 - h])
        fixed.append(net.evidence(words))
    count([0, 1])
    fixed = np.concatenate(fixed)
    both = _take(words, np.tile(np.arange(n), 2))
    at, doc = windows(words, size, stride)
    at = np.where(at >= 0, at + n * half[doc][:, None], -1).astype(np.int32)
    evidence = np.where(at >= 0, (fixed[:, 0] + fixed[:, 1])[at], 0).max(1)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    for round_ in range(rounds):
        logit = evidence if round_ == 0 else _logits(net, net.embed(both, fixed), at)
        order = np.lexsort((-logit, doc))
        top = order[np.append(True, doc[order][1:] != doc[order][:-1])]
        rest = np.flatnonzero(labels[doc] == 0)
        chosen = np.concatenate([top, rng.choice(rest, min(len(rest), len(top)), replace=False)])
        batches = [x for _ in range(max(2, 4000 // len(chosen))) for x in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 128))]
        for part in batches:
            used, local = np.unique(at[part], return_inverse=True)
            local = local.reshape(len(part), -1) - (used[0] == -1)
            used = used[used >= 0]
            own = _take(both, used)
            y = labels[doc[part]].astype(np.float32)
            g = net.gradients(own, net.embed(own, fixed[used]), local, y, np.ones(len(y), np.float32))
            step += 1
            now = rate / (1 + round_)
            for k in net.p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                net.p[k] -= (now * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(
    texts: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str, label_col: str, sample_rows: int, window: int, stride: int
) -> Network | None:
    """A network from at most sample_rows documents of either label, none of them held out."""
    source = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(label_id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label")]
    picked = [marks.where(F.col("label") == y).orderBy(*order).limit(sample_rows) for y in (0, 1)]
    # at most 2 * sample_rows rows: the documented bound of the sample
    sample = source.join(F.broadcast(picked[0].unionAll(picked[1])), "doc_id").select("doc_id", "text", "label").toArrow()
    sample = sample.sort_by([(c, "ascending") for c in ("doc_id", "label", "text")]).combine_chunks()
    texts, labels = sample["text"].combine_chunks(), sample["label"].to_numpy()
    del sample
    return train(texts, labels, window, stride)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def with_scores(df: DataFrame, net: Network | None, text_col: str, score_col: str, window: int, stride: int) -> DataFrame:
    """df with each row's score in a further column."""
    model = df.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType())])
    at = df.columns.index(text_col)

    def score(batches):
        for batch in batches:
            scores = pa.array(score_texts(model.value, batch.column(at), window, stride), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=schema.names)

    return df.mapInArrow(score, schema)


def toxicity_scores(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "toxic",
    threshold: float = 0.3,
    sample_rows: int = 2000,
    window: int = 32,
    stride: int = 16,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The network is fitted on at most sample_rows labelled documents of either
    label (those of the smallest hashes of their ids), none of them held out:
    a document is held out where crc32(id as text) mod 4 is 2. Every window of
    `window` words, `stride` apart, of every whole text is scored; the
    document's score is the highest window's.

    Null and empty texts, and texts without letters, score 0. A row with a null
    id is not held out, and not learned from. Null labels are not learned from;
    without both labels every score is 0. Repeated rows are each returned. Extra
    columns are ignored. An empty table gives no rows.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    net = fit(docs, labels, "doc_id", "text", label_id_col, label_col, sample_rows, window, stride)
    scored = with_scores(docs, net, "text", "score", window, stride)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    sample_rows: int = 2000,
    window: int = 32,
    stride: int = 16,
) -> DataFrame:
    """The rows of df that score below the threshold, with all their columns; see toxicity_scores."""
    net = fit(df, labels, id_col, text_col, "doc_id", "toxic", sample_rows, window, stride)
    name = "score"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return with_scores(df, net, text_col, name, window, stride).where(F.col(name) < threshold).drop(name)
