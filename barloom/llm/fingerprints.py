"""Document fingerprints: MinHash signatures, how like an edited text's and a neighbour's they are, and twins by bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .common import bounded, joined_by_class, written
from .shingles import mix64, shingle_sets

#: A pair at similarity 0.8 shares none of 25 bands of 5 samples with a chance of 5e-5; one above it with less.
BANDS, BAND_SAMPLES = 25, 5
SAMPLES = BANDS * BAND_SAMPLES

#: Sizes of a fingerprint's samples, the lowest 16 bits of each minimum.
_BYTES = 2

#: Text bytes worked on at once; a longer document is worked on alone.
_STEP = 1 << 20

#: Pairs with one document beyond which that document's text is sent to more than one task.
_PER_TASK = 1_000

#: x to (a * x + b) mod p is a permutation of the numbers below the prime p, and a universal family over a and b.
_PRIME = np.uint64(2**31 - 1)
_SEEDS = mix64(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64))
_A = _SEEDS[:SAMPLES] % (_PRIME - np.uint64(1)) + np.uint64(1)
_B = _SEEDS[SAMPLES:] % _PRIME


def _permuted(x: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    y = x * a
    y += b
    # twice, as the product has up to 62 bits; what is then left is below 2 * p
    for _ in range(2):
        high = y >> np.uint64(31)
        y &= _PRIME
        y += high
    return np.where(y >= _PRIME, y - _PRIME, y)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Per set of shingle hashes the lowest 16 bits of each permutation's minimum; those of an empty set are all ones."""
    out = np.full((len(sets), SAMPLES), 0xFFFF, np.uint16)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        x = np.concatenate([sets[i] for i in full]) % _PRIME
        begins = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for k in range(SAMPLES):
            out[full, k] = (np.minimum.reduceat(_permuted(x, _A[k], _B[k]), begins) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of samples that are equal: estimates the Jaccard similarity of the sets, 1 for equal ones."""
    return (a == b).mean(axis=1)


def _ranges(docs: DataFrame) -> list[int]:
    """Ids that split the documents into about as many ranges as the shuffle has partitions."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)] or [0.5]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 20 * n).alias("ids")).first()["ids"]
    return sorted(set(found or []))


_HOMES = ArrayType(StructType([StructField("range", IntegerType()), StructField("guard", BooleanType())]))


def _homes(docs: DataFrame) -> tuple[Column, int]:
    """An array of (range, guard) for a doc_id, and the number of ranges.

    An id has its own range, and if it is the first of it, it stands as a guard after the range before as well; the first
    of all stands after the last.
    """
    splits = np.array(_ranges(docs), np.int64)

    def ranges(ids: pa.Array) -> np.ndarray:
        # null is the smallest id
        at = np.searchsorted(splits, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), side="right")
        at[ids.is_null().to_numpy(zero_copy_only=False)] = 0
        return at

    @arrow_udf(IntegerType())
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(ranges(ids), pa.int32())

    # a row for each range
    ids = docs.select("doc_id", range_of("doc_id").alias("range")).groupBy("range")
    firsts = ids.agg(F.min("doc_id").alias("first"), F.bool_or(F.col("doc_id").isNull()).alias("no_id")).orderBy("range").collect()
    begin = {r["range"]: None if r["no_id"] else r["first"] for r in firsts}
    order = list(begin)
    before = dict(zip(order, [*order[-1:], *order[:-1]], strict=True))

    @arrow_udf(_HOMES)
    def homes_of(ids: pa.Array) -> pa.Array:
        out = []
        for i, r in zip(ids.to_pylist(), ranges(ids).tolist(), strict=True):
            home = [{"range": r, "guard": False}]
            if i == begin[r]:
                home.append({"range": before[r], "guard": True})
            out.append(home)
        return pa.array(out, pa.list_(pa.struct([("range", pa.int32()), ("guard", pa.bool_())])))

    return homes_of("doc_id"), len(splits) + 1


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts compressed: they are shuffled once, at less than half their size."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [pack.compress(t.as_py().encode() if t.is_valid else b"") for t in batch.column("text")]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()))


_PRINTS = (
    "row long, doc_id long, n_chars long, n_shingles long, text_sha256 binary, print binary, edited_sha256 binary, edited_print binary, "
    "near_edited double, near_next double"
)


class _Walk:
    """One task's ranges: each row waits for the next one of its range, which completes it."""

    def __init__(self, words: int):
        self.words, self.held, self.range, self.n = words, None, None, 0

    def _row(self) -> int:
        self.n += 1
        return (self.range << 40) + self.n

    def feed(self, rows: list[tuple]) -> Iterator[tuple]:
        """Of rows (range, guard, doc_id, text) in order, what is complete."""
        sets = shingle_sets(pa.array([r[3] for r in rows], pa.large_string()), self.words)
        prints = signatures(sets)
        ready, edits = [], []
        for (range_, guard, doc_id, text), shingles, own in zip(rows, sets, prints, strict=True):
            if range_ != self.range:
                self.range, self.n, self.held = range_, 0, None
            if self.held is not None:
                kept = self.held[1][: len(self.held[1]) - len(self.held[1]) // 4]
                edits.append(kept + text[: len(self.held[1]) // 4])
                ready.append((*self.held, own))
            self.held = None if guard else (doc_id, text, len(shingles), own, self._row())
        if not ready:
            return
        edited = signatures(shingle_sets(pa.array(edits, pa.large_string()), self.words))
        near_edited = likeness(np.array([r[3] for r in ready]), edited)
        near_next = likeness(np.array([r[3] for r in ready]), np.array([r[5] for r in ready]))
        for (doc_id, text, size, own, row, _), edit, signature, e, x in zip(ready, edits, edited, near_edited.tolist(), near_next.tolist(), strict=True):
            digests = [hashlib.sha256(t.encode()).digest() for t in (text, edit)]
            big = [s.astype(f">u{_BYTES}").tobytes() for s in (own, signature)]
            yield row, doc_id, len(text), size, digests[0], big[0], digests[1], big[1], e, x


def _walked(words: int):
    types = [pa.int64()] * 4 + [pa.binary()] * 4 + [pa.float64()] * 2
    names = [f.split()[0] for f in _PRINTS.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, state = zstandard.ZstdDecompressor(), _Walk(words)
        for batch in batches:
            rows, size = [], 0
            for i, (range_, guard, doc_id, packed) in enumerate(zip(*(batch.column(c) for c in ("range", "guard", "doc_id", "text")), strict=True)):
                text = unpack.decompress(packed.as_py())
                rows.append((range_.as_py(), guard.as_py(), doc_id.as_py(), text.decode()))
                size += len(text)
                if size >= _STEP or i + 1 == batch.num_rows:
                    made = list(state.feed(rows))
                    rows, size = [], 0
                    if made:
                        columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return walk


def fingerprint_rows(docs: DataFrame, words: int) -> DataFrame:
    """Of docs (doc_id, text): per row, in order of the ids, its fingerprint, its edited text's, and their likeness; see _PRINTS."""
    homes, n = _homes(docs)
    placed = docs.mapInArrow(_packed, "doc_id long, text binary").withColumn("home", F.explode(homes))
    placed = placed.select("home.range", "home.guard", "doc_id", "text")
    dealt = placed.repartitionById(n, F.col("range")).sortWithinPartitions("range", "guard", F.asc_nulls_first("doc_id"), "text")
    return dealt.mapInArrow(_walked(words), _PRINTS)


def band_keys(print_: Column) -> Column:
    """A key for each band of a fingerprint: its number and its samples."""
    size = BAND_SAMPLES * _BYTES
    return F.array(*[F.xxhash64(F.lit(i), F.substring(print_, i * size + 1, size)) for i in range(BANDS)])


def _similar(percent: int, words: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for batch in batches:
            found = []
            for row, lead, text, lead_text in zip(*(batch.column(c) for c in ("row", "lead", "text", "lead_text")), strict=True):
                if known[0] != lead.as_py():
                    known = lead.as_py(), shingle_sets(pa.array([lead_text.as_py()], pa.large_string()), words)[0]
                own = shingle_sets(pa.array([text.as_py()], pa.large_string()), words)[0]
                shared = len(np.intersect1d(own, known[1], assume_unique=True))
                found.append(100 * shared >= percent * (len(own) + len(known[1]) - shared))
            yield batch.select(["row", "lead"]).filter(pa.array(found, pa.bool_()))

    return check


def twins(prints: DataFrame, docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """text_sha256, first, first_id, lead_id, copies: of each text that has a twin, the first row with it, and its smallest verified lead.

    A band's lead is its row of the smallest id. A text's candidates are its bands' leads, so there are at most as many
    as bands, whatever the size of a bucket; they are leads of texts other than its own. A candidate holds if the
    shingle sets of both whole texts have a Jaccard similarity of `percent` or more. Texts without shingles have none.
    """
    heads = prints.groupBy("text_sha256").agg(F.min("row").alias("first"), F.min_by("doc_id", "row").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    heads = written(heads, "heads")
    keyed = prints.where("n_shingles > 0").select("row", F.explode(band_keys(F.col("print"))).alias("key"))
    # copies of a text are in the same buckets, so a bucket's lead is the first row with its text
    leads = written(keyed.groupBy("key").agg(F.min("row").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"), "leads")
    offered = joined_by_class(keyed, leads, "key", "n").where("lead < row").select("row", "lead").distinct()
    firsts = heads.select(F.col("first").alias("row"))
    pairs = written(offered.join(bounded(firsts), "row", "left_semi"), "pairs")
    rows = written(pairs.select("row").union(pairs.select("lead")).distinct().join(prints.select("row", "doc_id", "text_sha256"), "row"), "paired")
    texts = docs.withColumn("text_sha256", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    by_text = bounded(rows.withColumnRenamed("doc_id", "row_id"))
    same = (texts["text_sha256"] == by_text["text_sha256"]) & texts["doc_id"].eqNullSafe(by_text["row_id"])
    texts = written(texts.join(by_text, same).select("row", "text").dropDuplicates(["row"]), "texts")
    sizes = pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / _PER_TASK).cast("int").alias("parts"))
    sizes = written(sizes, "lead-sizes")
    shared = joined_by_class(pairs, sizes, "lead", "n").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    sides = texts.select(F.col("row").alias("lead"), F.col("text").alias("lead_text")).join(sizes.select("lead", "parts"), "lead")
    sides = sides.select("lead", "lead_text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = shared.drop("parts").join(texts, "row").join(sides, ["lead", "part"]).select("row", "lead", "text", "lead_text")
    kept = both.mapInArrow(_similar(percent, words), "row long, lead long").groupBy("row").agg(F.min("lead").alias("lead"))
    ids = rows.select(F.col("row").alias("lead"), F.col("doc_id").alias("lead_id"))
    kept = kept.join(ids, "lead").select(F.col("row").alias("first"), "lead_id")
    return heads.join(written(kept, "verified"), "first", "left").where("copies > 1 OR lead_id IS NOT NULL")


def fingerprint_documents(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A fingerprint of every document, as 500 hex digits, and how like others' it is.

    doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, twin_id. A
    fingerprint has 125 MinHash samples of 16 bits over the distinct shingles of `words` words of the whole text (of fewer
    words, the whole sequence); likeness is the share of equal samples. The edited text is the text whose last quarter of
    code points is replaced by as many from the next document's begin, or all that it has; documents stand in ascending order of their ids,
    the first after the last. twin_id is the smallest id among documents with the same text, and those that lead one
    of the document's bands and are similar in full (Jaccard of the sets, `percent`); null if there is none before it.

    Ids are integers; a null id is the smallest. Rows that share an id stand in a fixed order of their texts, repeated rows
    one after another. Null texts are empty; empty texts and those without words have all-ones fingerprints, which are alike,
    and no twin but for equal texts. An only document is next to itself. An empty table gives no rows. Other columns are left out, whatever
    they are called. Texts are shuffled once, compressed, by ranges of the id; a task holds a megabyte of text, or one document.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    prints = written(fingerprint_rows(rows, words), "prints")
    found = written(twins(prints, rows, percent, words), "twins")
    made = joined_by_class(prints, found, "text_sha256", "copies")
    return made.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        F.lower(F.hex("print")).alias("fingerprint"),
        F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.coalesce("lead_id", F.when(F.col("row") != F.col("first"), F.col("first_id"))).alias("twin_id"),
    )
