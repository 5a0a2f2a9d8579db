"""Exact top-k inner-product search by tiled matrix products."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Below these bounds on a score, products of float64 and of int64 are exact; beyond them Python's integers are used.
_EXACT_FLOAT, _EXACT_LONG = 2**53, 2**62
#: The score of a query's own rows: below all others of int64, and of objects.
_OWN, _FAR = -(2**63) + 1, -(10**700)


def _tile_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, queries x rows, of float64 that are whole numbers: int64, or objects if these are too small."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    bound = int(np.abs(queries).max()) * int(np.abs(rows).max()) * queries.shape[1]
    if bound < _EXACT_FLOAT:
        return (queries @ rows.T).astype(np.int64)
    if bound < _EXACT_LONG:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return whole(queries) @ whole(rows).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per line the k highest scores, ties to the smaller id."""
    if scores.dtype == object:
        at = np.array([heapq.nsmallest(k, range(len(s)), key=lambda i: (-s[i], i_[i])) for s, i_ in zip(scores, ids.tolist(), strict=True)])
        return np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    if scores.shape[1] > k:
        at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        edge = np.take_along_axis(scores, at[:, k - 1 : k], axis=1)
        tied = (scores >= edge).sum(axis=1) > k
        if tied.any():  # the k-th score occurs again: its smallest ids count
            at[tied] = np.lexsort((ids[tied], -scores[tied]), axis=1)[:, :k]
        scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -scores), axis=1)
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _order_key(score: int) -> bytes:
    """Bytes that sort as the integers do, of any size."""
    if -(2**63) <= score < 2**63:
        return b"\x02" + (score + 2**63).to_bytes(8, "big")
    size = (score.bit_length() + 8) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x03" + raw if score > 0 else b"\x01" + bytes(255 - b for b in raw)


class _Cell:
    """The queries of one cell of the grid, and their best rows so far."""

    def __init__(self, k: int, tile_rows: int):
        self.k, self.tile_rows = k, tile_rows
        self.asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.tops: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def ask(self, by_dim: dict) -> None:
        for dim, (ids, vectors) in by_dim.items():
            if dim in self.asked:
                ids, vectors = np.concatenate([self.asked[dim][0], ids]), np.vstack([self.asked[dim][1], vectors])
            self.asked[dim] = ids, vectors

    def meet(self, by_dim: dict) -> None:
        """Multiplies tiles of rows with tiles of queries, and keeps each query's k best rows between tiles."""
        for dim in by_dim.keys() & self.asked.keys():
            (ids, vectors), (q_ids, q) = by_dim[dim], self.asked[dim]
            for i in range(0, len(ids), self.tile_rows):
                for j in range(0, len(q_ids), self.tile_rows):
                    s = _tile_scores(q[j : j + self.tile_rows], vectors[i : i + self.tile_rows])
                    c = np.broadcast_to(ids[i : i + self.tile_rows], s.shape)
                    own = c == q_ids[j : j + self.tile_rows, None]
                    s, c = np.where(own, _OWN if s.dtype == np.int64 else _FAR, s), np.where(own, np.iinfo(np.int64).max, c)
                    if (dim, j) in self.tops:
                        before, known = self.tops[dim, j]
                        if object in (s.dtype, before.dtype):
                            s, before = (np.where(x == _OWN, _FAR, x.astype(object)) if x.dtype == np.int64 else x for x in (s, before))
                        s, c = np.hstack([before, s]), np.hstack([known, c])
                    self.tops[dim, j] = _best(s, c, self.k)

    def lists(self):
        """query, row, score (null beyond 64 bits), order."""
        for (dim, j), (s, c) in self.tops.items():
            asking = self.asked[dim][0][j : j + self.tile_rows]
            real = s != (_OWN if s.dtype == np.int64 else _FAR)
            values = [int(x) for x in s[real].tolist()]
            yield (
                np.broadcast_to(asking[:, None], s.shape)[real],
                c[real],
                [x if -(2**63) <= x < 2**63 else None for x in values],
                [_order_key(x) for x in values],
            )


def _by_dim(ids: np.ndarray, vectors: pa.Array, scale: float) -> dict:
    """floor(scale * x) of the vectors with their ids, by length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    offsets = np.cumsum(sizes) - sizes
    out = {}
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        out[dim] = ids[at], np.floor(scale * flat[offsets[at][:, None] + np.arange(dim)])
    return out


def topk_search(
    df: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 1024.0,
    tile_rows: int = 512,
    block_mb: float = 32,
    fan_in: int = 32,
) -> DataFrame:
    """Each query's k highest integer inner products with all rows of df but itself: query_id, rank, vec_id, score.

    Components become floor(scale * x). Queries and rows meet in a grid: queries
    are dealt into blocks of at most about block_mb megabytes, rows into shares,
    as many as the shuffle has partitions at least, and each pair of block and
    share is a cell. A task has a cell's queries in memory, streams its rows past
    them, multiplies tile with tile, and keeps k rows per query between tiles.
    So queries are copied once for each share, rows once for each block of queries, and
    neither passes the driver. The cells' short lists meet in a tree: fan_in shares first, then all.

    Rows with a null id, and vectors that are null, empty, or hold a component that is null or, times scale, not
    finite, take no part. Vectors of different lengths are not
    compared. Rows that carry the query's own id are not its candidates; a
    query id that is given twice with different vectors is taken once (the
    vector that sorts first). Equal candidate rows are each listed. Extra columns are ignored;
    an empty table gives no rows. Ranks are exact for scores of any size; a score beyond 64 bits itself is null.
    """
    spark = df.sparkSession

    def usable(rows: DataFrame) -> DataFrame:
        v = F.col("v")
        return (
            rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & v.isNotNull() & (F.size("v") > 0))
            .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == F.lit(float("inf")))))
        )

    asked = usable(queries).groupBy("id").agg(F.min("v").alias("v"))
    size = asked.agg(F.sum((F.size("v") + 1) * 8)).first()[0] or 0
    blocks = max(1, math.ceil(size / (block_mb * 2**20)))
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(rows: DataFrame, side: int, own: int, others: int) -> DataFrame:
        """rows once for each of the others, in the cells of their own line of the grid."""
        line = F.pmod(F.xxhash64("id", F.lit(side)), F.lit(own)).cast("int")
        copy = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        at = rows.withColumn("line", line).withColumn("copy", copy)
        share, block = ("copy", "line") if side == 0 else ("line", "copy")
        return at.select((F.col(block) * shares + F.col(share)).alias("cell"), F.lit(side).alias("side"), F.col(share).alias("share"), "id", "v")

    grid = dealt(asked, 0, blocks, shares).unionAll(dealt(usable(df), 1, shares, blocks))
    grid = grid.repartition(F.col("cell")).sortWithinPartitions("cell", "side")

    def search(batches):
        def told(cell: _Cell, share: int):
            for ask, row, score, order in cell.lists():
                if len(ask):
                    columns = (ask, pa.int64()), (row, pa.int64()), (score, pa.int64()), (order, pa.binary()), (np.full(len(ask), share), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=["query_id", "vec_id", "score", "order", "share"])

        cell, at, share = _Cell(k, tile_rows), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, sides, shares_, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if cells[a] != at:
                    yield from told(cell, share)
                    cell, at, share = _Cell(k, tile_rows), cells[a], int(shares_[a])
                (cell.meet if sides[a] else cell.ask)(_by_dim(ids[a:b], batch.column(4).slice(a, b - a), scale))
        yield from told(cell, share)

    lists = written(grid.mapInArrow(search, "query_id long, vec_id long, score long, order binary, share int"), "tile-tops")
    order = [F.col("order").desc(), F.col("vec_id")]
    first = Window.partitionBy("query_id", "branch").orderBy(*order)
    last = Window.partitionBy("query_id").orderBy(*order)
    merged = (
        lists.withColumn("branch", F.floor(F.col("share") / fan_in))
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= k)
        .withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= k)
    )
    return merged.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
