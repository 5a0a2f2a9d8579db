"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A probability this close to 0 or 1 is taken as it.
_TINY = 1e-9


def source_targets(
    sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0
) -> DataFrame:
    """Of one row per source (source, source_size): the same with target.

    Sources in order of code points, null last, get the weights in turn. The
    targets share `share` times all sizes by weight, but stop at `limit` times
    their source's size; the excess is shared again by weight among the rest.
    That is min(limit * size, level * weight) for one level, found from running
    sums over the sources in the order in which they reach their limit. One
    task does this: its rows are sources, not documents.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int")
    )
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    return (
        sources.withColumn("weight", weight)
        .withColumn("most", F.lit(float(limit)) * F.col("source_size"))
        .withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", level)
        # the first source whose limit lies above the level that is left for it and all after it sets the level;
        # after it, what seems to be left only falls
        .withColumn("level", F.max(F.when(F.col("fill") > F.col("level"), F.col("level"))).over(whole))
        .withColumn("target", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))))
        .select("source", "source_size", "n_docs", "target")
    )


def _flight(sizes: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """The cube method's flight: probabilities after it, all 0 or 1 but at most two.

    Balanced on words and documents: sum(p * size) and sum(p) stay as they are.
    Three undecided documents at a time have one direction that leaves both sums
    alone; a step along it decides one of them, and the next takes its place.
    Both ends of the line are drawn with the odds that keep each p's mean.
    """
    p = probs.astype(float).copy()
    rng = np.random.default_rng(np.array([len(p), int(sizes.sum()) & 0xFFFFFFFF], np.uint64))
    draws = rng.random(len(p) + 2)
    todo = np.flatnonzero((p > _TINY) & (p < 1 - _TINY)).tolist()[::-1]
    s, p = sizes.tolist(), p.tolist()
    held: list[int] = []
    n_draws = 0
    while True:
        while len(held) < 3 and todo:
            held.append(todo.pop())
        if len(held) < 3:
            break
        a, b, c = held
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(u):
            u = (1, -1, 0)
        up = down = float("inf")
        for i, x in zip(held, u, strict=True):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, p[i] / -x), min(down, (1 - p[i]) / -x)
        step = up if draws[n_draws] * (up + down) < down else -down
        n_draws += 1
        for i, x in zip(held, u, strict=True):
            p[i] += step * x
            if p[i] < _TINY:
                p[i] = 0.0
            elif p[i] > 1 - _TINY:
                p[i] = 1.0
        held = [i for i in held if 0.0 < p[i] < 1.0]
    return np.array(p)


def _fly(chunk: pd.DataFrame) -> pd.DataFrame:
    chunk = chunk.sort_values(["draw", "doc_id"], kind="stable").reset_index(drop=True)
    return chunk.assign(p=_flight(chunk["size"].to_numpy(), chunk["p"].to_numpy()))


def mix_sources(
    df: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    limit: float = 2.0,
    chunk_rows: int = 1024,
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken.

    size: an expression for a document's size in words.

    A source's documents are each to be taken target / source_size times, that
    is some whole times and a fraction. The fraction is an inclusion probability,
    decided by the cube method: within chunks of chunk_rows documents of a
    source the probabilities move through the null space of the balancing
    constraints (words and documents), which leaves two undecided at most; the
    undecided of all chunks form new chunks, and so on until each source has one
    chunk. That one's last two land: the words still due are taken as a part
    of a document. Rounds read their chunks from a hash of the id, so
    a large source is many tasks, and reruns agree.

    copies is the number of whole copies, taken the words, copies * size plus a
    part for the landing document; no document exceeds limit times its size.
    Documents of size 0 take nothing. A null source is a source. Null ids are
    ordinary rows. Repeated rows count each. Other columns are ignored. An empty
    table gives no rows.
    """
    docs = written(
        df.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size")
        ),
        "mix-sizes",
    )
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = written(source_targets(sources, weights, share, limit), "mix-targets")
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    known = targets.withColumnRenamed("source", "s").withColumn("ratio", ratio)
    rows = docs.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.floor(F.col("ratio") + _TINY)
    rows = rows.select(
        "*",
        whole.alias("copies"),
        F.when(F.col("size") > 0, F.greatest(F.col("ratio") - whole, F.lit(0.0))).otherwise(0.0).alias("p"),
        F.xxhash64("doc_id", "size").alias("draw"),
        F.ceil(F.col("n_docs") / chunk_rows).alias("chunks"),
    )
    fixed = rows.where(F.col("p") <= _TINY)
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    open_ = rows.where(F.col("p") > _TINY)
    done = [fixed]
    level = 0
    while True:
        key = F.pmod(F.xxhash64("draw", F.lit(level)), F.greatest(F.col("chunks"), F.lit(1)))
        flown = open_.withColumn("chunk", key).groupBy("source", "chunk").applyInPandas(
            _fly, schema=open_.withColumn("chunk", key).schema
        )
        flown = written(flown.drop("chunk"), "mix-flight")
        left = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.where(~left))
        open_ = flown.where(left).withColumn("chunks", F.ceil(F.col("chunks") * 2 / chunk_rows))
        level += 1
        if most <= chunk_rows:
            break
        most = -(-most // chunk_rows) * 2
    # two documents at most of each source
    done.append(open_)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    part = F.when(F.col("p") >= 1, F.col("size")).otherwise(F.round(F.col("p") * F.col("size")))
    return out.select(
        "doc_id",
        "size",
        "source",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (F.col("copies") + F.when(F.col("p") >= 1, 1).otherwise(0)).cast("long").alias("copies"),
        (F.col("copies") * F.col("size") + part).cast("long").alias("taken"),
    )
