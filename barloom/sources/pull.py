"""A source of numbered records that are pulled page by page, such as a REST endpoint; partitioned by ranges of ids."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: The one-letter fields of a page's records, fixed values of the wire format, and what they are called here.
FIELDS = ("a", "p", "q", "f", "l", "T", "m", "M")
RECORD = "agg_id bigint, price string, qty string, first_id bigint, last_id bigint, epoch bigint, is_buyer_maker boolean, best_match boolean"


@dataclass
class Ids(InputPartition):
    """The ids from first on, up to but without end."""

    first: int
    end: int


class PullSource(DataSource):
    """format("tick_pull"), of streams and batches.

    Options: fetch ("module:function"), newest (the same; optional), start (first id, 0), page (1000 records), pages (per task,
    50). fetch(from_id, limit, **more) returns records in order of their id `a`, from from_id on, fewer than
    the limit only if there are no more; newest(**more) the largest id, or None. Without newest it is searched by single
    records. more: all options that begin with "fetch.", such as a symbol.

    A trigger takes the ids from its offset to the newest; each task pulls page * pages ids of its own, a page at a time, so
    neither the driver nor a task holds more however far behind the stream is. The checkpoint holds the next id wanted,
    so a restart neither loses nor repeats one, and ids that don't exist are passed over. What a failed task pulled
    is pulled again.
    """

    @classmethod
    def name(cls) -> str:
        return "tick_pull"

    def schema(self) -> str:
        return RECORD

    def streamReader(self, schema: StructType) -> PullStream:
        return PullStream(self.options)

    def reader(self, schema: StructType) -> PullBatch:
        return PullBatch(self.options)


def _named(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _Pull:
    def __init__(self, options: dict):
        self.fetch = _named(options["fetch"])
        self.known = _named(options["newest"]) if options.get("newest") else None
        self.more = {k.removeprefix("fetch."): v for k, v in options.items() if k.startswith("fetch.")}
        self.start, self.page, self.pages = (int(options.get(k, d)) for k, d in (("start", 0), ("page", 1000), ("pages", 50)))

    def end(self, at: int) -> int:
        """One more than the largest id, at least `at`; some tens of requests for one record each, if it must be searched."""
        if self.known is not None:
            newest = self.known(**self.more)
            return at if newest is None else max(at, newest + 1)

        def reaches(first: int) -> bool:
            return bool(self.fetch(first, 1, **self.more))

        if not reaches(at):
            return at
        low, step = at, 1
        while reaches(low + step):
            low, step = low + step, step * 2
        high = low + step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if reaches(middle) else (low, middle)
        return high

    def split(self, first: int, end: int) -> list[Ids]:
        width = self.page * self.pages
        return [Ids(a, min(a + width, end)) for a in range(first, end, width)]

    def read(self, partition: Ids) -> Iterator[tuple]:
        first = partition.first
        while first < partition.end:
            limit = min(self.page, partition.end - first)
            records = self.fetch(first, limit, **self.more)
            for r in records:
                if r["a"] >= partition.end:
                    return
                yield tuple(r[k] for k in FIELDS)
            if len(records) < limit:
                return
            first = records[-1]["a"] + 1


class PullStream(_Pull, DataSourceStreamReader):
    """The offset is the next id that is wanted."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.at = self.start

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def latestOffset(self) -> dict:
        return {"next": self.end(self.at)}

    def partitions(self, start: dict, end: dict) -> list[Ids]:
        # the search for the newest id goes on from here
        self.at = end["next"]
        return self.split(start["next"], end["next"])


class PullBatch(_Pull, DataSourceReader):
    """All ids from `start` to the newest."""

    def partitions(self) -> list[Ids]:
        return self.split(self.start, self.end(self.start))
