"""What sequential functions need to go through sorted rows batch by batch."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def streamed(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """rows with each key's in one partition, one after another in this order; the sort spills to disk."""
    dealt = rows.repartition(*keys) if keys else rows.coalesce(1)
    return dealt.sortWithinPartitions(*[F.col(k) for k in keys], *order)


def runs(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """key, begin and end of the batch's runs of equal keys; nan equals nan."""
    if not batch.num_rows:
        return
    ends = {batch.num_rows}
    for k in keys:
        column = batch.column(k)
        if pa.types.is_floating(column.type):
            column = pc.if_else(pc.is_nan(column), math.nan, column).cast(pa.float64()).view(pa.int64())
        ends.update(pc.run_end_encode(column).run_ends.to_pylist())
    begin = 0
    for end in sorted(ends):
        values = (batch.column(k)[begin].as_py() for k in keys)
        yield tuple("nan" if v != v else v for v in values), begin, end
        begin = end
