"""Near-duplicate detection: MinHash bands, odd sketches, exact confirmation."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, discard, joined_by_class, written
from .components import components
from .shingles import mix64, shingle_sets

#: Buckets up to this size give all their pairs; larger ones give a forest.
_SMALL = 8


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash samples of one non-empty set of shingle hashes."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = None
    for i in range(0, len(h), 1024):
        part = (a[:, None] * h[None, i : i + 1024] + b[:, None]).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """The samples' parity bitmap: bit i tells whether an odd number of (position, sample) pairs hash to i."""
    pairs = samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))
    return np.packbits(np.bincount((mix64(pairs) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1)


def odd_estimate(differing_bits: float, samples: int, bits: int) -> float:
    """Similarity estimated from the population count of two sketches' XOR."""
    return 1 + bits / (4 * samples) * math.log(max(1 - 2 * differing_bits / bits, 1e-9))


def bit_limit(similarity: float, samples: int, bits: int, sigmas: float = 6.0) -> int:
    """The XOR count that a pair of at least this similarity exceeds with a chance of a normal's sigmas.

    Its variance has two parts: the number of differing samples, and how they fall into bits.
    """
    differ = 2 * samples * (1 - similarity)
    mean = bits / 2 * (1 - math.exp(-2 * differ / bits))
    from_samples = 2 * math.sqrt(samples * similarity * (1 - similarity)) * math.exp(-2 * differ / bits)
    from_bits = math.sqrt(max(mean * (1 - mean / bits), 1))
    return min(bits, math.ceil(mean + sigmas * math.hypot(from_samples, from_bits)))


def signatures(docs: DataFrame, shingle_words: int, bands: int, rows: int, bits: int) -> DataFrame:
    """Of (doc_id, text): doc_id, n (size of the set), print (128-bit digest of the set), keys (of bands), sketch."""

    def sign(batches):
        a, b = _coefficients(bands * rows)
        band = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            ns, prints, keys, sketches = [], [], [], []
            for s in shingle_sets(batch.column("text"), shingle_words):
                ns.append(len(s))
                if not len(s):
                    for x in (prints, keys, sketches):
                        x.append(None)
                    continue
                least = minhash(s, a, b)
                key = band.copy()
                for row in least.reshape(bands, rows).T:
                    key = mix64(key + row)
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(key.view(np.int64))
                sketches.append(odd_sketch(least, bits).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(ns, pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                names=["doc_id", "n", "print", "keys", "sketch"],
            )

    return docs.mapInArrow(sign, "doc_id long, n long, print binary, keys array<long>, sketch binary")


def _runs(batches):
    """Arrow batches regrouped so that no run of equal keys (first column, sorted) is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        last = len(key) - 1 - int(np.argmax((key != key[-1])[::-1])) if (key != key[-1]).any() else -1
        # rows up to `last` belong to runs that end in this batch
        if last >= 0:
            yield pa.Table.from_batches([*held, batch.slice(0, last + 1)])
            held = [batch.slice(last + 1)]
        elif held and held[0].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: np.ndarray, sketch: np.ndarray, fits) -> list[tuple[int, int]]:
    """Edges of a forest over a bucket's likely pairs that takes the most similar first (Prim)."""
    m, inf = len(n), np.iinfo(np.int64).max
    best, via = np.full(m, inf), np.full(m, -1)
    todo = np.ones(m, bool)
    out = []
    for _ in range(m):
        i = int(np.argmin(np.where(todo, best, inf)))
        if not todo[i]:
            i = int(np.argmax(todo))
        if best[i] < inf:
            out.append((int(via[i]), i))
        todo[i] = False
        apart, ok = fits(np.full(m, i), np.arange(m))
        closer = todo & ok & (apart < best)
        best[closer], via[closer] = apart[closer], i
    return out


def likely_pairs(buckets: DataFrame, percent: int, limit: int) -> DataFrame:
    """Of rows (key, node, n, sketch), each key's in one partition and sorted: (a, b, tree).

    A pair is likely if the sizes allow the similarity and the sketches' XOR has at most `limit` bits.
    Small buckets give all likely pairs, larger ones a forest of them, marked tree.
    """

    def pairs(batches):
        for run in _runs(batches):
            key = run["key"].to_numpy()
            node = run["node"].to_numpy()
            n = run["n"].to_numpy()
            sketch = np.frombuffer(b"".join(run["sketch"].to_pylist()), np.uint64).reshape(len(key), -1)

            def fits(i, j, n=n, sketch=sketch):
                apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
                return apart, (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (apart <= limit)

            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            size = np.repeat(sizes, sizes)
            found = []
            for d in range(1, _SMALL):
                i = np.flatnonzero((key[d:] == key[:-d]) & (size[d:] <= _SMALL)) if len(key) > d else np.zeros(0, int)
                ok = fits(i, i + d)[1]
                found.append((i[ok], i[ok] + d, np.zeros(ok.sum(), bool)))
            for start, m in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
                part = slice(start, start + m)
                edges = _forest(n[part], sketch[part], lambda i, j, s=start: fits(i + s, j + s))
                edges = np.array(edges, int).reshape(-1, 2) + start
                found.append((edges[:, 0], edges[:, 1], np.ones(len(edges), bool)))
            i, j, tree = (np.concatenate(x) for x in zip(*found, strict=True))
            real = node[i] != node[j]
            i, j, tree = i[real], j[real], tree[real]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.array(tree)],
                names=["a", "b", "tree"],
            )

    return buckets.mapInArrow(pairs, "a long, b long, tree boolean")


def confirmed(pairs: DataFrame, docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    texts = written(docs.join(bounded(asked), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "pair-texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def confirm(batches):
        for batch in batches:
            left = shingle_sets(batch.column("text_a"), shingle_words)
            right = shingle_sets(batch.column("text_b"), shingle_words)
            keep = []
            for x, y in zip(left, right, strict=True):
                joined = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((joined[1:] == joined[:-1]).sum())
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"]
            )

    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


def _common(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of the sets up to `split` with those from it on, as products of 0-1 matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, column = owner[seen[column] > 1], column[seen[column] > 1]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((split, len(sets) - split), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        a, b = np.searchsorted(column, [first, first + 8192])
        marks = np.zeros((len(sets), 8192), np.float32)
        marks[owner[a:b], column[a:b] - first] = 1
        out += marks[:split] @ marks[split:].T
    return out.astype(np.int64)


def links_across(blocks: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Of rows (key, side, node, root, text), each key's in one partition and sorted: links (a, b).

    Side 0 of a key is compared with side 1 in full, or with itself where there is no side 1. Of the pairs that are
    links and whose roots differ, a forest is returned.
    """

    def compare(batches):
        for run in _runs(batches):
            key = run["key"].to_numpy()
            found = [np.zeros((0, 2), np.int64)]
            bounds = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = run.slice(start, end - start)
                side, node, root = (part[c].to_numpy() for c in ("side", "node", "root"))
                order = np.argsort(side, kind="stable")
                sets = shingle_sets(part["text"].combine_chunks(), shingle_words)
                left, right = order[side[order] == 0], order[side[order] == 1]
                if not len(right):
                    right = left
                common = _common([sets[i] for i in [*left, *right]], len(left))
                n = np.array([len(x) for x in sets])
                union = n[left][:, None] + n[right][None, :] - common
                linked = (common > 0) & (100 * common >= percent * union) & (root[left][:, None] != root[right][None, :])
                found.append(_spanning(linked, node[left], node[right]))
            edges = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    return blocks.mapInArrow(compare, "a long, b long")


def _spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A forest of the two-sided graph."""
    fresh_left, fresh_right = np.ones(len(left), bool), np.ones(len(right), bool)
    edges = []
    for first in np.flatnonzero(linked.any(axis=1)).tolist():
        todo = [first] if fresh_left[first] else []
        fresh_left[first] = False
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(linked[i] & fresh_right).tolist():
                fresh_right[j] = False
                edges.append((left[i], right[j]))
                for k in np.flatnonzero(linked[:, j] & fresh_left).tolist():
                    fresh_left[k] = False
                    edges.append((left[k], right[j]))
                    todo.append(k)
    return np.array(edges, np.int64).reshape(-1, 2)


def _block_pairs(members: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Members of groups as rows for each pair of blocks of their group that their block is in: with `key` and `side`.

    Groups of up to `block` members are one block, and keep their key.
    """
    own, other = F.col("own"), F.col("other")
    return (
        members.withColumn("blocks", F.ceil(F.col(size) / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("side", F.when(own <= other, 0).otherwise(1))
        .withColumn(
            "key",
            F.when(F.col("blocks") == 1, F.col(key)).otherwise(
                F.xxhash64(key, F.least(own, other), F.greatest(own, other))
            ),
        )
        .drop("blocks", "own", "other")
    )


def _torn_blocks(members: DataFrame, block: int) -> DataFrame:
    """Members (cluster, node, root) of torn clusters as rows of the pairs of blocks that they are in: with `key`, `side`.

    A cluster's largest component is not compared with itself: the others are compared with one another, and with it.
    So a large group with few strays costs as much as it has members, times the blocks of its strays.
    """
    parts = members.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("m"))
    sizes = parts.groupBy("cluster").agg(F.sum("m").alias("all"), F.max(F.struct("m", "root")).alias("top"))
    # one row for each torn cluster
    sizes = sizes.select("cluster", F.col("top.root").alias("top"), F.col("top.m").alias("n_top"), (F.col("all") - F.col("top.m")).alias("n_rest"))
    rows = members.join(bounded(written(sizes, "torn-sizes")), "cluster").withColumns(
        {"in_top": F.col("root") == F.col("top"), "rest": F.ceil(F.col("n_rest") / block).cast("int"), "tops": F.ceil(F.col("n_top") / block).cast("int")}
    )
    own = F.pmod(F.xxhash64("node"), F.when(F.col("in_top"), F.col("tops")).otherwise(F.col("rest"))).cast("int")

    def place(kind: int, low: Column, high: Column, side: Column | int) -> Column:
        return F.struct(F.xxhash64("cluster", F.lit(kind), low, high).alias("key"), (F.lit(side) if isinstance(side, int) else side).alias("side"))

    def each(n: str, f) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)

    with_rest = each("rest", lambda i: place(0, F.least(i, F.col("own")), F.greatest(i, F.col("own")), F.when(F.col("own") <= i, 0).otherwise(1)))
    with_top = each("tops", lambda j: place(1, F.col("own"), j, 0))
    from_top = each("rest", lambda i: place(1, i, F.col("own"), 1))
    places = F.when(F.col("in_top"), from_top).otherwise(F.concat(with_rest, with_top))
    return rows.withColumn("own", own).select("node", "root", F.explode(places).alias("place")).select("node", "root", "place.key", "place.side")


def minhash_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = 30,
    rows: int = 5,
    bits: int = 512,
    bucket_block: int = 2048,
    text_block: int = 512,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest id that links reach, kept tells
    whether that is the document itself.

    1. MinHash samples per document give band keys and an odd sketch (a parity
       bitmap of the samples). A pair at the threshold misses all bands with a
       chance of (1 - s**rows)**bands: 7e-6 at 30 bands of 5 and 0.8.
    2. Documents with the same set are one node; copies never meet pairwise.
    3. Nodes are dealt by band key. Sizes and the population count of the
       sketches' XOR tell likely pairs. Buckets of up to eight nodes give all
       of them; larger ones a forest that joins all that likely pairs join, so
       what a bucket gives is linear in its size. A bucket of more than
       bucket_block nodes is worked on as pairs of blocks, a task's group each.
    4. Likely pairs are confirmed on the full shingle sets.
    5. Where a forest's edge is refuted and its ends are not in one component by
       other links, other pairs of that cluster (what likely pairs join) may
       still be links. Such clusters are compared in full across components,
       in pairs of blocks of text_block texts, and only links leave a task; the
       largest component of a cluster is compared with the others only.

    Empty and null texts have n_shingles 0 and stand alone. Rows that share an
    id are one document for links (each is returned). A row with a null id links
    nothing; its component_id is that of rows with its very set, or null. Extra
    columns are ignored. An empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(docs, shingle_words, bands, rows, bits), "signatures")
    sets = signed.where("n > 0")
    # copies of a set have the same keys and sketch: a class takes any one's, and combines within tasks first
    classes = written(
        sets.groupBy("print")
        .agg(
            F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "keys", "sketch")]
        )
        .where("node IS NOT NULL"),
        "classes",
    )
    nodes = written(classes.select("node", "n", "keys", "sketch").dropDuplicates(["node"]), "nodes")
    keyed = nodes.select(F.explode("keys").alias("band"), "node")
    shared = keyed.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("band"))).where("m > 1")
    buckets = _block_pairs(shared.join(nodes.select("node", "n", "sketch"), "node"), "band", "m", bucket_block)
    buckets = buckets.select("key", "node", "n", "sketch").repartition("key").sortWithinPartitions("key")
    likely = written(likely_pairs(buckets, percent, bit_limit(percent / 100, bands * rows, bits)), "likely")
    pairs = likely.select("a", "b").distinct()
    links = written(confirmed(pairs, docs, shingle_words, percent), "links")
    roots = components(links)
    ends = (
        likely.where("tree")
        .join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    )
    torn = written(ends.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a").distinct(), "torn")
    if not torn.isEmpty():
        clusters = components(pairs).withColumnRenamed("root", "cluster")
        open_ = clusters.join(torn.withColumnRenamed("a", "node"), "node", "left_semi").select("cluster").distinct()
        members = clusters.join(open_, "cluster").join(roots, "node", "left")
        members = written(members.select("cluster", "node", F.coalesce("root", "node").alias("root")), "members")
        ids = members.select(F.col("node").alias("doc_id"))
        texts = docs.join(bounded(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "node")
        blocks = _torn_blocks(members, text_block).join(texts, "node")
        blocks = blocks.select("key", "side", "node", "root", "text").repartition("key").sortWithinPartitions("key")
        more = links_across(blocks, shingle_words, percent)
        joined = written(links.unionAll(more), "links")
        discard(roots)
        roots = components(joined)
    component = F.coalesce("root", "node")
    known = written(classes.join(roots, "node", "left").select("print", "copies", component.alias("component")), "class-roots")
    placed = joined_by_class(signed.select("doc_id", "n", "print"), known, "print", "copies")
    component = F.coalesce("component", "doc_id")
    return placed.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
