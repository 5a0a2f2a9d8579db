"""License scans: MinHash bands over text windows, then exact shingle containment."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, written

#: Notices of public licenses; fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
    "except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    'and associated documentation files (the "Software"), to deal in the Software without restriction, including '
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to whom the Software is furnished to do so",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
    "(at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE",
    "MIT-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.",
}

#: Words of a shingle.
WORDS = 5
#: Shingles of a window. Windows of texts begin every _STRIDE shingles, those of templates at every shingle.
_WINDOW, _STRIDE = 6, 3
#: Templates of fewer shingles are also retrieved by windows of a single one.
_SHORT = 10


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column, size: Column | int) -> Column:
    """Distinct runs of `size` words as texts."""
    last = F.size(words) - size + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _run_hashes(words: Column, size: int) -> Column:
    """A hash for each run of `size` words in order."""
    last = F.size(words) - size
    return F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    ).otherwise(F.array().cast("array<bigint>"))


def _sample(j: int):
    """The j-th order of hashes, whose least and greatest are a window's samples."""
    return lambda h: F.xxhash64(h, F.lit(j))


def _with_band_keys(rows: DataFrame, stride: int, bands: int, band_rows: int, short: Column, lengths: list[int]) -> DataFrame:
    """rows (words, ..) with `keys`: structs of place (the window's first word) and the key of one of its bands.

    short: whether runs of fewer than a window's shingles, and those of fewer than five words (of `lengths`), have keys too.
    """
    rows = rows.withColumn("singles", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("hashes", _run_hashes(F.col("singles"), WORDS))
    # the least and the greatest hash of a window are two samples
    n = (bands * band_rows + 1) // 2
    rows = rows.withColumns({f"p{j}": F.transform("hashes", _sample(j)) for j in range(n)})
    last = F.size("hashes") - _WINDOW

    def key(kind: int, *values: Column) -> Column:
        return F.xxhash64(F.lit(kind), *values)

    def window(i: Column) -> Column:
        # several references keep the planner from computing the arrays anew for every window
        samples = [pick(*[F.get(F.col(f"p{j}"), i + k) for k in range(_WINDOW)]) for pick in (F.least, F.greatest) for j in range(n)]
        bands_ = [key(b, *samples[b * band_rows : (b + 1) * band_rows]) for b in range(bands)]
        return F.transform(F.array(*bands_), lambda k: F.struct(i.alias("place"), k.alias("key")))

    none = F.array().cast("array<struct<place:int,key:bigint>>")
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), window))
    parts = [F.when(last >= 0, whole).otherwise(none)]

    def each(hashes: Column, size: int) -> Column:
        made = F.transform(hashes, lambda h, i: F.struct(i.alias("place"), key(100 + size, h).alias("key")))
        return F.when(short, made).otherwise(none)

    parts += [each(F.col("hashes"), WORDS)] + [each(_run_hashes(F.col("singles"), m), m) for m in lengths if m < WORDS]
    return rows.withColumn("keys", F.concat(*parts)).drop("singles", "hashes", *[f"p{j}" for j in range(n)])


def scan_licenses(
    df: DataFrame,
    templates: Mapping[str, str] | DataFrame = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
    containment: float = 0.8,
    bands: int = 2,
    band_rows: int = 2,
) -> DataFrame:
    """One row per document and template found in it: doc_id, license, containment, first_word, windows.

    Texts are lower-cased runs of letters and digits. containment is the share of a template's distinct five-word
    shingles that are in the document, compared as texts; a template is found from `containment` on, if a window
    retrieves it.

    Windows of six shingles begin at every third shingle of a text, and at every one of a template. Each has `bands` keys,
    of band_rows MinHash samples each; windows whose shingle sets have similarity s share one with a chance of
    1 - (1 - s**band_rows)**bands, and equal ones surely. A copy with eight shingles in a row unchanged has an equal
    window: so have all with a containment of 0.8 in a template of ten shingles or more, since changing a word costs
    five shingles. Templates of fewer shingles are also retrieved by single shingles. first_word is the first
    retrieving window's place, windows the number of windows that retrieve.

    templates: license and text, as a mapping or as a DataFrame of any size: band keys are matched by a join, which
    is broadcast only if they are few. Templates of fewer than five words are one shingle of as many words.

    A row with a null or empty text yields nothing, nor does a null or empty template. Rows that share an id (null too) are
    one document: the best containment counts. Repeated rows count their windows each. Extra
    columns are ignored. An empty table, or no templates, gives no rows.
    """
    spark = df.sparkSession
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    known = templates.select("license", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    known = known.withColumn("shingles", _shingles(F.col("words"), F.least(F.size("words"), F.lit(WORDS))))
    known = written(known, "licenses")
    short = F.size("shingles") < _SHORT
    lengths = known.where(short).select(F.least(F.size("words"), F.lit(WORDS)).alias("n")).distinct().orderBy("n")
    # five values at most
    lengths = [r["n"] for r in lengths.collect()]
    own_length = F.least(F.size("words"), F.lit(WORDS))
    keys = _with_band_keys(known.withColumn("n", own_length), 1, bands, band_rows, short, lengths)
    keys = keys.select("license", F.explode_outer("keys").alias("k")).select("license", "k.key").distinct()
    keys = written(keys, "license-keys")

    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    tag = F.xxhash64("text")
    cut = docs.select("doc_id", tag.alias("tag"), words_of(F.col("text")).alias("words"))
    cut = _with_band_keys(cut, _STRIDE, bands, band_rows, F.lit(bool(lengths)), lengths)
    # only ids, places and keys meet the templates; texts come back for the few documents that are retrieved
    # outer: else the planner asks below the explosion whether there are keys, by computing them there anew
    met = cut.select("doc_id", "tag", F.explode_outer("keys").alias("k")).select("doc_id", "tag", "k.place", "k.key").join(bounded(keys), "key")
    hits = met.groupBy("doc_id", "tag", "license").agg(F.min("place").alias("first_word"), F.countDistinct("place").alias("windows"))
    hits = written(hits.select(F.col("doc_id").alias("hit_id"), F.col("tag").alias("hit_tag"), "license", "first_word", "windows"), "license-hits")
    found = docs.join(bounded(hits), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (tag == F.col("hit_tag")))
    found = found.join(bounded(known.select("license", "shingles", own_length.alias("n"))), "license")
    words = found.withColumn("words", words_of(F.col("text"))).drop("text")
    share = F.size(F.array_intersect("shingles", _shingles(F.col("words"), F.col("n")))) / F.size("shingles")
    shares = words.select("doc_id", "license", share.alias("share"), "first_word", "windows")
    # shares are looked at after the aggregate: the planner would compute them twice for a filter before it
    right = F.col("share") >= containment
    return (
        shares.groupBy("doc_id", "license")
        .agg(
            F.max("share").alias("containment"),
            F.min(F.when(right, F.col("first_word"))).cast("long").alias("first_word"),
            F.sum(F.when(right, F.col("windows"))).cast("long").alias("windows"),
        )
        .where(F.col("containment") >= containment)
    )
