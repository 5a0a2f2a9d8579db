"""Importance resampling towards a target: documents whose n-grams a target has more often than the corpus are drawn first.

The features' strings stand in one dictionary: each distinct string is counted over all texts and hashed once. Its
hash is the bucket whose gain it takes; gains are joined back to the documents' own counts of the strings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from barloom.operators.scan import positions

from .common import written

#: A word: letters and digits of ASCII, and all that is beyond it (in UTF-8 each byte of it is), after A-Z are lower-cased.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Distinct features after which a batch of counts is handed on.
_STEP = 200_000


#: Strings whose gains are broadcast at most: some tens of megabytes.
FREQUENT = 200_000


def _features(words: list[bytes], longest: int) -> Counter:
    counts = Counter(words)
    for n in range(2, longest + 1):
        counts.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return counts


def feature_counts(texts: DataFrame, longest: int, *kept: str) -> DataFrame:
    """texts with n_words, features (distinct strings) and counts (how often the text has each), and of its columns `kept`.

    Features are the runs of 1 to `longest` words, joined by a space. Null and empty texts have none.
    """
    rows = texts.select(*kept, "text")
    schema = rows.select(*kept).schema.add("n_words", "long")
    schema = schema.add("features", ArrayType(StringType())).add("counts", ArrayType(LongType()))
    names = list(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            begin, held = 0, []
            for i, text in enumerate(texts):
                words = _WORD.findall(text.as_py().encode().lower()) if text.is_valid else []
                held.append((len(words), _features(words, longest)))
                if i + 1 == len(texts) or sum(len(c) for _, c in held) >= _STEP:
                    part = batch.slice(begin, len(held))
                    columns = [part.column(c) for c in names]
                    columns.append(pa.array([n for n, _ in held], pa.int64()))
                    columns.append(pa.array([list(c) for _, c in held], pa.list_(pa.binary())).cast(pa.list_(pa.string())))
                    columns.append(pa.array([list(c.values()) for _, c in held], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "features", "counts"])
                    begin, held = i + 1, []

    return rows.mapInArrow(count, schema)


def _strings(counts: DataFrame, name: str) -> DataFrame:
    """feature and how often all texts have it."""
    pairs = counts.select(F.explode(F.arrays_zip("features", "counts")).alias("pair"))
    return pairs.groupBy(F.col("pair.features").alias("feature")).agg(F.sum("pair.counts").alias(name))


def dictionary(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """feature, raw and aim (how often corpus and target have it), bucket: a row for each distinct string, hashed once."""
    zero = F.lit(0).cast("long")
    both = _strings(corpus, "raw").withColumn("aim", zero).unionByName(_strings(target, "aim").withColumn("raw", zero))
    return both.groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("aim").alias("aim")).withColumn(
        "bucket", F.crc32(F.col("feature").cast("binary")) % buckets
    )


def bucket_gains(strings: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: 1000 times the log ratio of the target's share of the bucket to the corpus', both with one more a bucket."""
    each = strings.groupBy("bucket").agg(F.sum("raw").alias("s"), F.sum("aim").alias("t"))
    # a row for each bucket that occurs, at most `buckets`
    all_ = Window.partitionBy()
    s, t, s_all, t_all = (c.cast("double") for c in (F.col("s"), F.col("t"), F.sum("s").over(all_), F.sum("t").over(all_)))
    ratio = ((t + 1) * (s_all + buckets)) / ((s + 1) * (t_all + buckets))
    return each.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def _least_count(priced: DataFrame) -> int:
    """The least power of two that at most FREQUENT strings reach with their count.

    Of n features in all, no string that stays below it has more than 2 * n / FREQUENT.
    """
    # at most 64 rows: one for each number of binary digits
    digits = priced.groupBy(F.length(F.bin("raw")).alias("digits")).count().orderBy(F.desc("digits")).collect()
    least, strings = 1 << 62, 0
    for r in digits:
        strings += r["count"]
        if strings > FREQUENT:
            break
        least = 1 << (r["digits"] - 1)
    return least


def document_weights(counts: DataFrame, priced: DataFrame) -> DataFrame:
    """row, weight: the gains of each row's features, repeats counted; priced (a table of written()) has feature, gain, raw.

    Frequent strings' gains are broadcast, so that those pairs of row and feature stay where they are; only the rare
    strings' pairs are shuffled, and no rare string has many.
    """
    pairs = counts.select("row", F.explode(F.arrays_zip("features", "counts")).alias("pair"))
    pairs = pairs.select("row", F.col("pair.features").alias("feature"), F.col("pair.counts").alias("times"))
    often = F.col("raw") >= _least_count(priced)
    frequent, rare = F.broadcast(priced.where(often).drop("raw")), priced.where(~often).drop("raw")
    hot = pairs.join(frequent, "feature")
    cold = pairs.join(frequent.select("feature"), "feature", "left_anti").join(rare, "feature")
    return hot.unionByName(cold).groupBy("row").agg(F.sum(F.col("gain") * F.col("times")).alias("weight"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """A thousand times a Gumbel variate from the first 8 hex digits of sha256("<seed>:<id>"), rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document of docs; target's texts are what is aimed at.

    Features are runs of 1 to `longest` words. A bucket's gain is floor(1000 * ln of the target's smoothed share over the corpus').
    weight is the sum of the gains of a document's features, repeats counted; score adds a Gumbel variate of the id, so
    that the highest scores are a draw without replacement by weight. Of N documents with `least_words` words or more,
    floor(percent * N / 100) are drawn by score, ties to the smaller id; rank is null for the others.

    Null and empty texts have no features and weight 0. A null id is the smallest, and hashes as an empty one. Repeated rows
    count, and are drawn, each; rows that share id and score are ranked in any order. Without documents there are no
    rows; without a target all gains come from its smoothing alone. Other columns are left out, whatever they are called.
    Texts are counted whole, once; the counts are written, and no text is shuffled.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = feature_counts(rows, longest, "doc_id")
    counts = written(counts.withColumn("row", F.monotonically_increasing_id()), "features")
    aims = feature_counts(target.select(F.col(f"`{target_col}`").cast("string").alias("text")), longest)
    strings = written(dictionary(counts, aims, buckets), "dictionary")
    gains = written(bucket_gains(strings, buckets), "gains")
    # gains has at most `buckets` rows, a parameter
    priced = written(strings.where("raw > 0").join(F.broadcast(gains), "bucket").select("feature", "gain", "raw"), "prices")
    weights = document_weights(counts, priced)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    heads = counts.select("row", "doc_id", "n_words", total.alias("n_features"))
    weighed = heads.join(weights, "row", "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))
    able = F.col("n_words") >= least_words
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), able.alias("able"))
    placed = positions(scored, [], [F.desc("able"), F.desc("score"), F.asc("doc_id")], "place")
    drawn = counts.agg(F.count_if(able).alias("n")).first()["n"] * percent // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
