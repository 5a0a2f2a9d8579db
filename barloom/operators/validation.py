"""Walk-forward folds with purge and embargo, class priors, and the pre-gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.config import FoldParams


def folds(spark: SparkSession, start: str, end: str, p: FoldParams = FoldParams()) -> DataFrame:
    """Expanding folds within [start, end]: fold_id, train_start, val_start, oot_start, oot_end."""
    first = F.lit(start).cast("date")
    step = F.col("fold_id") - 1
    val = F.add_months(first, p.train_months + step * p.step_months)
    oot = F.add_months(val, p.val_months)
    made = spark.range(1, 1201).select(F.col("id").cast("int").alias("fold_id")).select(
        "fold_id",
        first.alias("train_start"),
        val.alias("val_start"),
        oot.alias("oot_start"),
        F.add_months(oot, p.oot_months).alias("oot_end"),
    )
    return made.where(F.col("oot_end") <= F.lit(end).cast("date"))


def data_range(rows: DataFrame, ts: str) -> DataFrame:
    """First month of the data, and the month after its last."""
    return rows.agg(
        F.trunc(F.min(ts), "MM").alias("data_start"), F.add_months(F.trunc(F.max(ts), "MM"), 1).alias("data_end")
    )


def split(rows: DataFrame, fold_rows: DataFrame, ts: str, tie: str, p: FoldParams = FoldParams()) -> DataFrame:
    """rows once for each fold and role (train, val, oot) that they are in.

    The last `purge` rows of a training part go if it has more than these, and
    so do the first `embargo` of an out-of-time part. The folds are a calendar
    (a few per year), so they are broadcast.
    """
    t = F.col(ts)
    role = (
        F.when((t >= F.col("train_start")) & (t < F.col("val_start")), "train")
        .when((t >= F.col("val_start")) & (t < F.col("oot_start")), "val")
        .when((t >= F.col("oot_start")) & (t < F.col("oot_end")), "oot")
    )
    near = (t >= F.col("train_start")) & (t < F.col("oot_end"))
    placed = rows.join(F.broadcast(fold_rows), near).withColumn("role", role)
    part = Window.partitionBy("fold_id", "role")
    numbered = placed.withColumns(
        {
            "n": F.count(F.lit(1)).over(part),
            "up": F.row_number().over(part.orderBy(ts, tie)),
            "down": F.row_number().over(part.orderBy(F.desc(ts), F.desc(tie))),
        }
    )
    purged = (F.col("role") == "train") & (F.col("n") > p.purge) & (F.col("down") <= p.purge)
    kept_back = (F.col("role") == "oot") & (F.col("n") > p.embargo) & (F.col("up") <= p.embargo)
    return numbered.where(~purged & ~kept_back).drop("n", "up", "down", "train_start", "val_start", "oot_start", "oot_end")


def usable_folds(split_rows: DataFrame, min_rows: int) -> DataFrame:
    """Folds whose val and oot parts have at least min_rows rows."""
    sizes = split_rows.groupBy("fold_id").agg(
        F.count_if(F.col("role") == "train").alias("n_train"),
        F.count_if(F.col("role") == "val").alias("n_val"),
        F.count_if(F.col("role") == "oot").alias("n_oot"),
    )
    return sizes.where((F.col("n_val") >= min_rows) & (F.col("n_oot") >= min_rows))


def entropy(labelled: DataFrame, label: str, *keys: str) -> DataFrame:
    """Entropy of the classes' shares, by key."""
    counts = labelled.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(1)))
    share = counts.withColumn("p", F.col("n") / total)
    return share.groupBy(*keys).agg(F.sum(-F.col("p") * F.ln("p")).alias("entropy"))


def log_loss(probs: Column, label: Column) -> Column:
    """Mean of -ln of the probability of the label, an index into the array."""
    return F.avg(-F.ln(F.least(F.greatest(F.get(probs, label), F.lit(1e-15)), F.lit(1.0))))


def pre_gate(ratios: DataFrame, limit: float = 0.99, first: int = 6, needed: int = 4) -> DataFrame:
    """Of rows (fold_id, ratio): how many of the first folds stay below the limit, and whether that is enough."""
    early = ratios.withColumn("k", F.row_number().over(Window.orderBy("fold_id"))).where(F.col("k") <= first)
    return early.agg(F.count_if(F.col("ratio") < limit).alias("n_pass")).withColumn("passed", F.col("n_pass") >= needed)
