"""Packing documents into fixed windows with source proportions held by deficit round-robin."""

from __future__ import annotations

import json
import zlib
from collections.abc import Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: GPT-2's split of a text into pieces; a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Proportions are whole multiples of this share.
_UNIT = 1 << 20
#: Bytes of text tokenized at once.
_STEP = 1 << 20


@lru_cache(maxsize=2)
def _encoder(path: str, added: bool):
    """The byte-level BPE of a tokenizers JSON file, run by tiktoken: the same ids at several times the speed.

    added: whether the file's added tokens are found in texts.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the printable characters that stand for bytes in byte-level vocabularies
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    before = spec.get("pre_tokenizer") or {}
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False or spec.get("normalizer"):
        raise ValueError("only byte-level vocabularies with the plain split and no normaliser are supported")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if added and any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take blanks or whole words only are not supported")
    if added and any(a != b and a in b for a in special for b in special):
        raise ValueError("added tokens that hold one another are not supported")
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special if added else {})


def _slices(batch: pa.RecordBatch):
    """A batch in runs of rows with about _STEP bytes of text each; a longer text is a run of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        before = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, before + _STEP, side="right")))
        yield batch.slice(i, j - i)
        i = j


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, added_tokens: bool = False) -> DataFrame:
    """Of (doc_id, source, text): doc_id, source, n, ids (little-endian, with end_id last), part, before.

    part numbers the task, before counts the tokens of the same source earlier in it. added_tokens: as in pack_documents.
    """

    def encode(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer_path, added_tokens)
        seen: dict[str | None, int] = {}
        for batch in batches:
            for rows in _slices(batch):
                ids, before, ns = [], [], []
                for source, text in zip(rows.column("source").to_pylist(), rows.column("text"), strict=True):
                    found = encoder.encode_to_numpy(text.as_py() or "", allowed_special="all")
                    x = np.append(found, np.uint32(end_id)).astype("<u4", copy=False)
                    ids.append((x.astype("<u2") if x.max() < 65536 else x).tobytes())
                    ns.append(len(x))
                    before.append(seen.get(source, 0))
                    seen[source] = before[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("source"), pa.array(ns, pa.int64()), pa.array(ids, pa.binary()), pa.array(np.full(len(ns), part), pa.int32()), pa.array(before, pa.int64())],
                    names=["doc_id", "source", "n", "ids", "part", "before"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(encode, f"doc_id {kind}, source string, n long, ids binary, part int, before long")


class Rounds:
    """Where the sources' quanta stand in the stream of all sources.

    Deficit round-robin serves, time and again, the source that is furthest
    behind its share. A source of weight w is due with its j-th quantum at
    (2 j + 1) / w; the order of these times is the order of service, and the quanta of
    any source before a given time can be counted directly. So a task knows where
    its tokens go without the windows before them: deficits carry across windows
    and tasks by arithmetic alone.

    Sources of the same weight are always due together, so one is not told
    from the other but by its number of quanta: kinds are (weight, quanta), with how many sources
    and tokens they have. However many sources there are, their weights, whole numbers that sum up to about
    _UNIT, have some 1,500 different values at most. Ties go by weight, then to the source with more quanta, then by rank.
    """

    def __init__(self, kinds: list[tuple[int, int, int, int]], quantum: int):
        """kinds: (weight, quanta, sources, tokens), each (weight, quanta) once."""
        self.quantum = quantum
        self.classes = []
        table = np.array(sorted(kinds), np.int64).reshape(-1, 4)
        for w in np.unique(table[:, 0]).tolist():
            own = table[table[:, 0] == w]
            sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(own[:, 2:], axis=0)])
            self.classes.append((w, own[:, 1].copy(), sums))

    def _served(self, quanta: np.ndarray, sums: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Tokens of a class's sources in their first k quanta each."""
        at = np.searchsorted(quanta, k, side="right")
        return sums[at, 1] + self.quantum * k * (sums[-1, 0] - sums[at, 0])

    def start(self, j: np.ndarray, weight: np.ndarray, quanta: np.ndarray, rank: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Tokens in the stream before quanta j, each of a source of this weight and number of quanta.

        rank, before: how many sources of the same kind come before it, and their tokens.
        """
        q = self.quantum
        out = q * j
        for w, counts, sums in self.classes:
            # quanta k with (2 k + 1) / w before (2 j + 1) / weight
            ahead = (2 * j + 1) * w - weight
            k = np.where(w < weight, ahead // (2 * weight) + 1, -(-ahead // (2 * weight)))
            own = w == weight
            k = np.maximum(np.where(own, j, k), 0)
            out = out + self._served(counts, sums, k)
            # of its own class: those with more quanta, and those of its kind with a lower rank, have had one more
            more = sums[-1, 0] - sums[np.searchsorted(counts, quanta, side="right"), 0]
            alike = np.where(j < quanta - 1, q * rank, before - rank * q * (quanta - 1))
            out = out + np.where(own, q * more + alike - q * j, 0)
        return out


def _pieces(begin: np.ndarray, n: np.ndarray, sources: tuple, rounds: Rounds, window: int) -> tuple[np.ndarray, ...]:
    """Of documents that start at `begin` of their source's queue: the pieces' documents, starts, lengths and places.

    sources: of each document's source the weight, quanta, rank and tokens before it, see Rounds.
    """
    q = rounds.quantum
    first = begin // q
    per = (begin + n - 1) // q - first + 1
    doc = np.repeat(np.arange(len(n)), per)
    j = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = np.maximum(j * q, begin[doc])
    length = np.minimum((j + 1) * q, (begin + n)[doc]) - start
    place = rounds.start(j, *(x[doc] for x in sources)) + start - j * q
    start = start - begin[doc]
    # quanta of a document that follow each other in the stream are one piece
    fresh = np.append(True, (place[1:] != place[:-1] + length[:-1]) | (doc[1:] != doc[:-1]))
    at = np.flatnonzero(fresh)
    doc, start, place, length = doc[at], start[at], place[at], np.add.reduceat(length, at)
    # cut at the windows' bounds
    first, last = place // window, (place + length - 1) // window
    per = last - first + 1
    which = np.repeat(np.arange(len(place)), per)
    w = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(per) - per, per)
    low = np.maximum(place[which], w * window)
    high = np.minimum((place + length)[which], (w + 1) * window)
    return doc[which], start[which] + low - place[which], high - low, low


def _queues(totals: DataFrame, proportions: Mapping[str | None, float] | None, exponent: float, quantum: int) -> DataFrame:
    """Of (source, total): source, weight, quanta, rank, tokens_before: the sources' queues, see Rounds."""
    if proportions:
        known = totals.sparkSession.createDataFrame([(s, float(v)) for s, v in proportions.items()], "of string, share double")
        shared = totals.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("of")), "left").select("source", "total", F.coalesce("share", F.lit(0.0)).alias("share"))
    else:
        shared = totals.select("source", "total", F.pow(F.col("total").cast("double"), exponent).alias("share"))
    shared = written(shared, "shares")
    whole = shared.agg(F.sum("share")).first()[0] or 1.0
    weighed = shared.select(
        "source",
        "total",
        F.greatest(F.lit(1), F.round(F.col("share") / F.lit(whole) * _UNIT)).cast("long").alias("weight"),
        F.ceil(F.col("total") / quantum).cast("long").alias("quanta"),
    )
    kind = Window.partitionBy("weight", "quanta").orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return weighed.select(
        "*", F.count(F.lit(1)).over(kind).alias("rank"), F.coalesce(F.sum("total").over(kind), F.lit(0)).cast("long").alias("tokens_before")
    )


def pack_documents(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    proportions: Mapping[str | None, float] | None = None,
    window: int = 2048,
    exponent: float = 1.0,
    quantum: int = 256,
    end_id: int = 1,
    broadcast_rows: int = 500_000,
    added_tokens: bool = True,
) -> DataFrame:
    """Pieces of documents in windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its tokens and end_id. Each source is a queue of its
    documents' tokens; deficit round-robin deals the queues in quanta to one
    stream, cut into windows: any run of windows has every source's
    share of tokens to within a quantum, while the source lasts. Only the last
    window of all is short, to be padded. proportions: target shares by source; sources without a share
    count as the least. Without them a source's share goes with its tokens to the power of exponent: at 1 all sources
    last to the end, below it small ones come sooner.

    The ids are those that tokenizers gives with add_special_tokens=False: a string of one of the file's added tokens
    in a text is that token's one id. With added_tokens=False such strings are ordinary text.

    Tokens are made once and kept in the shared folder; the tasks' sums per
    source then give each document's place, so no tokens are shuffled. Sources are a table, however many there are; what
    tasks hold of them all are the kinds of their queues (see Rounds).

    Null and empty texts are the end id alone. Null ids and sources are ordinary
    values. Repeated rows are packed each. Extra columns are ignored. An empty table gives no rows.
    """
    docs = df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")
    )
    tokens = written(tokenized(docs, tokenizer_path, end_id, added_tokens), "tokens")
    sums = written(tokens.groupBy("source", "part").agg(F.sum("n").alias("part_n")), "token-sums")
    queues = written(_queues(sums.groupBy("source").agg(F.sum("part_n").alias("total")), proportions, exponent, quantum), "queues")
    kinds = queues.groupBy("weight", "quanta").agg(F.count(F.lit(1)).alias("n"), (F.sum("total")).alias("tokens")).collect()
    rounds = Rounds([tuple(r) for r in kinds], quantum)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", F.col("part").alias("p"), F.coalesce(F.sum("part_n").over(earlier), F.lit(0)).alias("base"))
    named = queues.select(F.col("source").alias("s"), "weight", "quanta", "rank", "tokens_before")
    bases = written(bases.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("source"), "bases")
    if bases.count() <= broadcast_rows:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))

    def cut(batches):
        for batch in batches:
            begin, n, *sources = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("begin", "n", "weight", "quanta", "rank", "tokens_before"))
            doc, start, length, place = _pieces(begin, n, tuple(sources), rounds, window)
            crc, held, raw = [], -1, b""
            ids = batch.column("ids")
            for d, a, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
                if d != held:
                    held, own = d, ids[d].as_buffer()
                    raw = memoryview(np.frombuffer(own, "<u2" if own.size == 2 * n[d] else "<u4").astype("<u4")).cast("B")
                crc.append(zlib.crc32(raw[4 * a : 4 * (a + m)]))
            at = pa.array(doc, pa.int64())
            columns = (pa.array(x, pa.int64()) for x in (start, length, crc, n[doc], place // window, place % window))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), *columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.select("doc_id", "n", (F.col("base") + F.col("before")).alias("begin"), "weight", "quanta", "rank", "tokens_before", "ids").mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
