"""Exact deduplication by content sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import without_ids, written

#: Characters of a text that lead its sort key, and their bytes (four a character at most).
_HEAD = 8
#: Sampled keys per range.
_SAMPLES = 40


def _sort_key(norm: Column) -> Column:
    """A text's first bytes and its SHA-256, of one length for all texts: rows of the same key stand together."""
    head = F.rpad(F.encode(F.substring(norm, 1, _HEAD), "UTF-8"), 4 * _HEAD, F.lit(b"\x00"))
    return F.concat(head, F.unhex(F.sha2(norm, 256)))


def _splitters(keys: DataFrame, ranges: int) -> list[str]:
    """Bounds (hexadecimal) that cut the keys into about so many ranges of equal rows, from a sample.

    At most some _SAMPLES short keys per range come to the driver, however long the texts are.
    """
    n = keys.count()
    if ranges < 2 or n < 2:
        return []
    sample = keys.sample(min(1.0, _SAMPLES * ranges / n), seed=11).select(F.hex("key").alias("key"))
    found = sorted(r["key"] for r in sample.collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def _range_of(key: Column, splitters: list[str]) -> Column:
    """How many splitters are not above the key: halving steps over their sorted array."""
    if not splitters:
        return F.lit(0)
    # a constant: computed once, not for each row
    bounds = F.expr(f"array({', '.join(f"X'{s}'" for s in splitters)})")
    steps = [1 << i for i in range(len(splitters).bit_length())][::-1]
    n = F.lit(len(splitters))
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when((at + s <= n) & (F.get(bounds, at + s - 1) <= key), at + s).otherwise(at),
    )


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A content sort:

    1. Splitters from a sample cut the normalised texts, in order of their first
       bytes, their SHA-256 and a hash of the id, into `ranges` ranges (default
       four for each shuffle partition). The keys are short for texts of any
       length. As the id counts, splitters fall inside a large group of equal
       texts too, and deal it over many ranges.
    2. A range is sorted outside memory by key, whole text and id, so equal
       texts are neighbours, and each text is compared in full with the one
       before it. A run of equal texts has its best id and its size.
    3. A run at a range's end may go on in the next range: the last text of a
       range and the first of the next are compared in full, and runs that go on
       are added up. This reads two rows a range.

    keep: "min" or "max", which id of equal texts stays.
    normalise: applied to the text before the comparison; default none.

    Null texts count as empty, and empty texts equal each other. A null id is
    taken last of its group. Of repeated rows with the same id, one is kept.
    Other columns of the input are ignored. An empty table gives no rows.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    pick = F.max if keep == "max" else F.min
    spark = df.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), (normalise(text) if normalise else text).alias("norm"))
    keyed = rows.select("id", "norm", _sort_key(F.col("norm")).alias("content"))
    slot = F.unhex(F.lpad(F.hex(F.xxhash64("id")), 16, "0"))
    key = F.concat("content", slot)
    splitters = _splitters(keyed.select(key.alias("key")), ranges)
    placed = keyed.withColumn("range", _range_of(key, splitters)).repartition(F.col("range"))
    best = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()
    order = Window.partitionBy("range").orderBy("content", "norm", best)
    fresh = ~F.col("norm").eqNullSafe(F.lag("norm").over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.select(
        "range",
        "id",
        F.substring(F.col("content"), 4 * _HEAD + 1, 32).alias("digest"),
        F.row_number().over(order).alias("row"),
        fresh.alias("fresh"),
        # the range's first and last text, for the comparison across ranges
        F.when(F.row_number().over(order) == 1, F.col("norm")).alias("first_text"),
        F.when(F.lead(F.lit(1)).over(order).isNull(), F.col("norm")).alias("last_text"),
        "content",
        "norm",
    )
    numbered = numbered.withColumn("run", F.sum(F.col("fresh").cast("int")).over(upto)).drop("content", "norm")
    run = Window.partitionBy("range", "run")
    runs = written(
        numbered.select(
            "range",
            "run",
            "id",
            "digest",
            "first_text",
            "last_text",
            (F.row_number().over(run.orderBy("row")) == 1).alias("leads"),
            pick("id").over(run).alias("best"),
            F.count(F.lit(1)).over(run).alias("n"),
        ),
        "content-runs",
    )
    ends = _stitched(runs, pick)
    # two rows a range at most
    joined = runs.join(F.broadcast(ends), ["range", "run"], "left")
    keep_id = F.when(F.col("whole_n").isNull(), F.col("best")).otherwise(F.col("whole_best"))
    return joined.select(
        F.col("id").alias("doc_id"),
        keep_id.alias("keep_id"),
        F.coalesce("whole_n", "n").cast("long").alias("group_size"),
        (F.col("leads") & F.col("id").eqNullSafe(keep_id)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _stitched(runs: DataFrame, pick: Callable) -> DataFrame:
    """Of the runs at the ranges' ends that go on across them: range, run, whole_best, whole_n of the run as a whole.

    Its rows are at most two a range, so ordering all of them is one small task.
    """
    edges = runs.where("first_text IS NOT NULL OR last_text IS NOT NULL")
    at_ends = edges.groupBy("range", "run").agg(
        F.max("first_text").alias("first_text"), F.max("last_text").alias("last_text"), F.first("best").alias("best"), F.first("n").alias("n")
    )
    order = Window.orderBy("range", "run")
    goes_on = F.coalesce(F.col("first_text") == F.lag("last_text").over(order), F.lit(False))
    chained = at_ends.withColumn("chain", F.sum((~goes_on).cast("int")).over(order))
    chain = Window.partitionBy("chain")
    made = chained.select(
        "range", "run", pick("best").over(chain).alias("whole_best"), F.sum("n").over(chain).alias("whole_n"), F.count(F.lit(1)).over(chain).alias("parts")
    )
    return made.where("parts > 1").drop("parts")


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of df that exact_dedup keeps, with all their columns.

    Ids that several rows carry, and null ids, are looked up together with their text; of rows equal in both, one
    stays. Null and empty texts equal each other. Whatever further columns are called, they stay as they are. An empty
    table gives no rows.
    """
    judged = written(exact_dedup(df, id_col, text_col, keep), "judged")
    many = written(judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "ids")
    if many.isEmpty():
        return without_ids(df, judged.where(~F.col("kept")).select("doc_id"), id_col)
    single = without_ids(df, judged.where(~F.col("kept")).select("doc_id").unionAll(many), id_col)
    single = single.where(F.col(id_col).isNotNull()) if not many.where("doc_id IS NULL").isEmpty() else single
    again = many.withColumnRenamed("doc_id", "many_id")
    some = df.join(again, df[id_col].eqNullSafe(again["many_id"]), "left_semi")
    kept = judged.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    digest = F.sha2(F.coalesce(some[text_col], F.lit("")), 256)
    stay = some.join(kept, some[id_col].eqNullSafe(kept["kept_id"]) & (digest == kept["kept_sha"]), "left_semi")
    return single.unionByName(stay.dropDuplicates([id_col, text_col]))
