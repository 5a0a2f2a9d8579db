"""Fill-in-the-middle: documents cut in three at token boundaries and put together with the middle last.

A document's token boundaries are a bit for each byte of its text, packed into words with a directory of the
popcounts before each block. The total popcount is the number of tokens; a cut after r tokens is a select of rank r.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")

#: Text bytes worked on at once; a longer document is worked on alone.
_STEP = 1 << 20

_BLOCK_WORDS = 8
_BLOCK_BITS = 64 * _BLOCK_WORDS


class BitVector:
    """A packed vector of bits with rank and select, for many positions at a time."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        # one block more than needed, so that the position after the last bit lies in a block as well
        blocks = len(bits) // _BLOCK_BITS + 1
        self.words = np.zeros(blocks * _BLOCK_WORDS, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int64).reshape(blocks, _BLOCK_WORDS)
        #: ones before each word of its block, and before each block
        self.inner = np.cumsum(counts, axis=1) - counts
        self.directory = np.concatenate([[0], np.cumsum(counts.sum(axis=1))])

    @property
    def total(self) -> int:
        return int(self.directory[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before the bits at these positions."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        inside = np.bitwise_count(self.words[word] & below).astype(np.int64)
        return self.directory[at // _BLOCK_BITS] + self.inner.reshape(-1)[word] + inside

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Positions of the ones that have so many ones before them; each rank is below the total."""
        block = np.searchsorted(self.directory, ranks, side="right") - 1
        left = ranks - self.directory[block]
        inner = self.inner[block]
        place = (inner <= left[:, None]).sum(axis=1) - 1
        left = left - inner[np.arange(len(ranks)), place]
        word = block * _BLOCK_WORDS + place
        bits = np.unpackbits(self.words[word][:, None].view(np.uint8), axis=1, bitorder="little")
        # the first bit up to which there is one more than are left
        return word * 64 + (np.cumsum(bits, axis=1, dtype=np.int16) <= left[:, None]).sum(axis=1)


_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("a") : ord("z") + 1] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def boundaries(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """True at the bytes where a token begins: a run of A-Za-z, or any other code point. No run goes over a text's begin."""
    letter = _LETTER[data]
    first = ~_CONTINUES[data]
    first[1:] &= ~(letter[1:] & letter[:-1])
    first[begins] = True
    return first


_CUTS = StructType([StructField(c, LongType()) for c in ("n", "first", "second")])


def _cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text its tokens and the bytes before both cuts."""
    tokens = BitVector(boundaries(data, offsets[:-1][offsets[:-1] < offsets[1:]]))
    before = tokens.rank(offsets)
    n = np.diff(before)
    cuts = []
    for h in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        inside = h < n
        at = offsets[1:].copy()
        at[inside] = tokens.select(before[:-1][inside] + h[inside])
        cuts.append(at - offsets[:-1])
    return n, *cuts


@arrow_udf(_CUTS)
def token_cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """Tokens of each text, and the bytes before its smaller and its larger cut: h1 and h2 modulo (tokens + 1) tokens."""
    text = text.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    ranks = [h.to_numpy(zero_copy_only=False).astype(np.int64) for h in (h1, h2)]
    made: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _STEP, side="right")) - 1)
        j = min(j, len(text))
        made.append(_cuts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], *(r[i:j] for r in ranks)))
        i = j
    columns = [pa.array(np.concatenate(c)) for c in zip(*made, strict=True)]
    return pa.StructArray.from_arrays(columns, _CUTS.names)


def _checked(marks: tuple[str, str, str]) -> None:
    """Marks that can be found again: none is empty or inside another, and none begins with another's end."""
    pairs = list(permutations(marks, 2))
    inside = any(a in b for a, b in pairs)
    overlap = any(a.endswith(b[:k]) for a, b in [*pairs, *zip(marks, marks, strict=True)] for k in range(1, min(len(a), len(b))))
    if inside or overlap or not all(marks):
        raise ValueError(f"marks {marks} cannot be told apart")


def fill_in_middle(
    docs: DataFrame,
    seed: int = 1,
    percent: int = 90,
    spm_percent: int = 20,
    marks: tuple[str, str, str] = MARKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: its id, n (tokens, `[A-Za-z]+|[^A-Za-z]`), form, prefix_chars, middle_chars and the output text.

    The first four groups of 8 hex digits of sha256("<seed>:<id>") are h1 to h4. The prefix ends after the smaller of
    h1 % (n+1) and h2 % (n+1) tokens, the middle after the larger. Of the texts, `percent` in a hundred are moved (by
    h3), of these `spm_percent` with the suffix first (spm, by h4), the others with the prefix first (psm); the rest
    are plain, and so are empty texts and those that contain a mark.

    Null texts are empty; a null id hashes as an empty one. Repeated rows and ids have their row each, equal ids the
    same hashes. Texts of any length are cut whole. An empty table gives no rows. Other columns are left out, whatever
    they are called. One pass without a shuffle: only the texts' cuts come from Python.
    """
    _checked(marks)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), *hashes)
    cut = rows.withColumn("cut", token_cuts("text", "h1", "h2"))

    def part(begin: Column, size: Column) -> Column:
        return F.substring(F.col("text").cast("binary"), begin + 1, size).cast("string")

    first, second = (F.col(f"cut.{c}").cast("int") for c in ("first", "second"))
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= percent)
    parts = cut.select(
        "doc_id",
        "text",
        F.col("cut.n").alias("n"),
        F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
        part(F.lit(0), first).alias("prefix"),
        part(first, second - first).alias("middle"),
        part(second, F.octet_length("text") - second).alias("suffix"),
    )
    p, s, m = (F.lit(x) for x in marks)
    moved = F.col("form") != "plain"
    return parts.select(
        "doc_id",
        "n",
        "form",
        F.when(moved, F.char_length("prefix").cast("long")).alias("prefix_chars"),
        F.when(moved, F.char_length("middle").cast("long")).alias("middle_chars"),
        F.when(~moved, F.col("text"))
        .when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle"))
        .otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
        .alias("output"),
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output and its form were made of: prefix, middle and suffix as its marks tell them apart."""
    _checked(marks)
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks))
    one, two, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
