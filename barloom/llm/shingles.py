"""Word shingles of whole texts as 64-bit hashes, for a batch of documents at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once; a longer document is worked on alone.
_STEP = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all documents, and the number of words up to each offset."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    upto = np.searchsorted(starts, offsets)
    letters = _BYTE[data[solid]]
    # where each word's letters begin among all letters
    begins = (np.cumsum(solid) - 1)[starts]
    lengths = np.diff(np.append(begins, len(letters)))
    place = np.arange(len(letters)) - np.repeat(begins, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE | np.uint64(1)))
    return mix64(np.add.reduceat(letters * powers[place], begins)), upto


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    words, upto = _words(data, offsets)
    n = len(words)
    if n >= k:
        folded = words[: n - k + 1].copy()
        for i in range(1, k):
            folded *= np.uint64(0xD6E8FEB86659FD93)
            folded += words[i : n - k + 1 + i]
        folded = mix64(folded)
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(folded[a : b - k + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    whole = whole * np.uint64(0xA24BAED4963EE407) + w
            out.append(mix64(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles.

    A-Z are lower-cased; words are runs without \\x20 and \\x09-\\x0D. A text of
    fewer words has its whole sequence as one shingle; null texts and texts
    without words have none.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _STEP, side="right")) - 1)
        j = min(j, len(texts))
        out += _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
        i = j
    return out
