"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b): every node with the smallest node that it reaches: node, root.

    Each round hangs every node below its smallest neighbour, lets all nodes jump
    to the top of what they hang below, and moves the edges to the tops; the
    edges left are fewer each time, and jumps double their reach. So a chain
    of n links takes about log2(n) steps, not n. Links stay in tables
    throughout; the driver learns only whether some are left.

    Edges with a null end, and those from a node to itself, link nothing; repeated edges count once. Further columns
    are ignored. No edges give no rows.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    edges = written(tidy(edges), "edges")
    roots = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tops = _tops(written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")), "hangs"))
        if roots is None:
            composed = tops.select("node", F.col("up").alias("root"))
        else:
            up = tops.select(F.col("node").alias("root"), "up")
            composed = roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        composed = written(composed, "roots")
        moved = edges.join(tops.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
        moved = moved.join(tops.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        left = written(tidy(moved.select(F.col("ua").alias("a"), F.col("ub").alias("b"))), "edges")
        discard(edges, tops, roots)
        edges, roots = left, composed
        if edges.isEmpty():
            discard(edges)
            return roots


def _tops(hangs: DataFrame) -> DataFrame:
    """Of (node, up): the same with each node's top, by jumps from up to its up until none moves."""
    while True:
        # what hangs below a top need not jump, so tops, which may have many nodes below them, are no keys here
        higher = hangs.where("up <> node").select(F.col("node").alias("up"), F.col("up").alias("higher"))
        jumped = hangs.join(higher, "up", "left").select("node", F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("moved"))
        jumped = written(jumped, "hangs")
        discard(hangs)
        if jumped.where("moved").isEmpty():
            return jumped
        hangs = jumped
