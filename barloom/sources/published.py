"""Archives that are published by day or month below a base address: read in tasks, one archive each, and caught up with."""

from __future__ import annotations

import hashlib
import io
import urllib.error
import urllib.request
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from barloom.functions.streams import runs, streamed
from barloom.functions.ticks import complete_months, days_to_catch_up
from barloom.sources.archive import member, ticks, to_load, upsert
from barloom.sources.tables import add_ticks, write_ticks

#: Where a symbol's archive of a period stands below the base, and its checksum beside it; fixed values of the publisher.
NAME = "{symbol}/{symbol}-aggTrades-{period}.zip"
CHECKSUM = ".CHECKSUM"

#: Bytes copied, and lines handed on, at once.
_CHUNK = 1 << 20
_LINES = 20_000


class ArchiveError(RuntimeError):
    """An archive that is not what its checksum says, or has none."""


class Address:
    """A folder that archives stand below: of http(s), or of any file system that Arrow opens by a URI or a path."""

    def __init__(self, base: str):
        self.base = base.rstrip("/")
        self.web = self.base.startswith(("http://", "https://"))
        if not self.web:
            self.store, self.folder = pafs.FileSystem.from_uri(self.base)

    def open(self, name: str):
        """A stream of the file's bytes, or None if there is no such file; other failures raise."""
        try:
            if self.web:
                return urllib.request.urlopen(f"{self.base}/{name}", timeout=120)  # noqa: S310
            return self.store.open_input_file(f"{self.folder}/{name}")
        except FileNotFoundError:
            return None
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            raise

    def has(self, name: str) -> bool:
        if not self.web:
            return self.store.get_file_info(f"{self.folder}/{name}").type == pafs.FileType.File
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{self.base}/{name}", method="HEAD"), timeout=120):  # noqa: S310
                return True
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return False
            raise

    def digest(self, name: str) -> str | None:
        """SHA-256 of a file, or None if there is none."""
        found = self.open(name)
        if found is None:
            return None
        with found:
            return _copied(found)

    def fetched(self, name: str, source: Address, told: str) -> None:
        """Brings source's file here. It gets its name when it is whole and right, so that no reader sees part of it.

        A file of that name that is whole is kept; one that is not is replaced. Each attempt writes under a name of its
        own, so attempts at the same file don't disturb each other.
        """
        if self.digest(name) == told:
            return
        target = f"{self.folder}/{name}"
        part = f"{target}.{uuid.uuid4().hex}.part"
        self.store.create_dir(target.rpartition("/")[0], recursive=True)
        found = source.open(name)
        if found is None:
            raise ArchiveError(f"{name} has a checksum, but is not there")
        try:
            with found, self.store.open_output_stream(part) as out:
                made = _copied(found, out)
            if made != told:
                raise ArchiveError(f"checksum mismatch: {name}")
            if self.has(name):
                self.store.delete_file(target)
            self.store.move(part, target)
        except BaseException:
            if self.store.get_file_info(part).type == pafs.FileType.File:
                self.store.delete_file(part)
            raise


def _copied(source, target=None) -> str:
    """SHA-256 of what source has, written to target a chunk at a time."""
    digest = hashlib.sha256()
    while chunk := source.read(_CHUNK):
        digest.update(chunk)
        if target is not None:
            target.write(chunk)
    return digest.hexdigest()


def told_sum(source: Address, name: str) -> str:
    """The SHA-256 that the file's checksum file ("<sha256>  <file>") tells."""
    found = source.open(name + CHECKSUM)
    if found is None:
        raise ArchiveError(f"no checksum for {name}")
    with found:
        words = found.read().decode().split()
    if not words or len(words[0]) != 64:
        raise ArchiveError(f"bad checksum for {name}: {words[:1]}")
    return words[0].lower()


@dataclass
class Archive(InputPartition):
    symbol: str
    period: str

    def name(self, pattern: str) -> str:
        return pattern.format(symbol=self.symbol, period=self.period)


class PublishedSource(DataSource):
    """format("tick_archive"): symbol, period (yyyy-MM-dd or yyyy-MM), file, sha256, line of each line of the archives' CSVs.

    Options: base (address), symbols and periods (comma-separated), name (pattern below the base), into (a folder that all
    executors share; needed where base is a web address), missing (what an archive that isn't published
    does: fail, skip, or stop, which ends the symbol's periods before it), sums (true: a row for each archive, its checksum file's sum, no line; archives are not read).

    Each archive is a task. With `into` it is copied there first, under another name until it is whole, and not copied again if it is there
    already. Its bytes are checked against the checksum file before any line is handed on; a wrong or missing sum fails
    the read. The zip is read where it stands, a batch of lines at a time, never whole.
    """

    @classmethod
    def name(cls) -> str:
        return "tick_archive"

    def schema(self) -> str:
        return "symbol string, period string, file string, sha256 string, line string"

    def reader(self, schema: StructType) -> PublishedReader:
        return PublishedReader(self.options)


class PublishedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.into = options["base"], options.get("into")
        self.symbols, self.periods = ([x for x in options[k].split(",") if x] for k in ("symbols", "periods"))
        self.pattern = options.get("name", NAME)
        self.missing, self.sums = options.get("missing", "fail"), options.get("sums", "false").lower() == "true"
        if self.missing not in ("fail", "skip", "stop"):
            raise ValueError(f"missing is fail, skip or stop, not {self.missing}")
        if self.into is None and Address(self.base).web and not self.sums:
            raise ValueError("archives of a web address need a shared folder `into`")

    def partitions(self) -> list[Archive]:
        made, base = [], Address(self.base)
        for symbol in self.symbols:
            for period in self.periods:
                archive = Archive(symbol, period)
                if self.missing == "fail" or base.has(archive.name(self.pattern)):
                    made.append(archive)
                elif self.missing == "stop":
                    break
        # without partitions Spark would ask read() for None
        return made or [Archive("", "")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.symbol:
            return
        name, source = partition.name(self.pattern), Address(self.base)
        told = told_sum(source, name)
        if self.sums:
            yield self._batch(partition, name, told, [None])
            return
        place = source
        if self.into is not None:
            place = Address(self.into)
            place.fetched(name, source, told)
        elif source.digest(name) != told:
            raise ArchiveError(f"checksum mismatch: {name}")
        with place.open(name) as raw, zipfile.ZipFile(raw) as z, z.open(member(z.namelist())) as csv:
            held: list[str] = []
            for text in io.TextIOWrapper(csv, "utf-8"):
                held.append(text.rstrip("\r\n"))
                if len(held) == _LINES:
                    yield self._batch(partition, name, told, held)
                    held = []
            if held:
                yield self._batch(partition, name, told, held)

    def _batch(self, partition: Archive, name: str, told: str, lines: list) -> pa.RecordBatch:
        file = name.rpartition("/")[2]
        same = [pa.array([x] * len(lines), pa.string()) for x in (partition.symbol, partition.period, file, told)]
        return pa.RecordBatch.from_arrays([*same, pa.array(lines, pa.string())], names=["symbol", "period", "file", "sha256", "line"])


def read_archives(spark: SparkSession, base: str, symbols: list[str], periods: list[str], **options) -> DataFrame:
    """The lines of the archives of these symbols and periods; see PublishedSource."""
    spark.dataSource.register(PublishedSource)
    given = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if v is not None}
    return spark.read.format("tick_archive").options(base=base, symbols=",".join(symbols), periods=",".join(periods), **given).load()


def publish(lines: DataFrame, into: str, order: list[str], header: str | None = None, pattern: str = NAME) -> DataFrame:
    """Writes lines (symbol, period, line, and what they are ordered by) as archives with checksums: symbol, period, sha256, n_lines.

    Each archive is written by one task as its sorted lines come, under another name until it is whole; its checksum follows.
    Nothing is written before the result is computed, and what a repeated task writes is the same again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, open_ = Address(into), None

        def begin(key: tuple) -> tuple:
            name = pattern.format(symbol=key[0], period=key[1])
            target = f"{place.folder}/{name}"
            place.store.create_dir(target.rpartition("/")[0], recursive=True)
            part = f"{target}.{uuid.uuid4().hex}.part"
            raw = place.store.open_output_stream(part)
            z = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
            info = zipfile.ZipInfo(name.rpartition("/")[2].replace(".zip", ".csv"))
            info.compress_type = zipfile.ZIP_DEFLATED
            csv = z.open(info, "w", force_zip64=True)
            if header:
                csv.write(f"{header}\n".encode())
            return key, name, part, raw, z, csv

        def end(one: tuple, n: int) -> pa.RecordBatch:
            key, name, part, raw, z, csv = one
            csv.close()
            z.close()
            raw.close()
            with place.store.open_input_stream(part) as made:
                digest = _copied(made)
            target = f"{place.folder}/{name}"
            place.store.move(part, target)
            with place.store.open_output_stream(target + CHECKSUM) as sums:
                sums.write(f"{digest}  {name.rpartition('/')[2]}\n".encode())
            return pa.RecordBatch.from_pylist([{"symbol": key[0], "period": key[1], "sha256": digest, "n_lines": n}])

        n = 0
        for batch in batches:
            for key, a, b in runs(batch, ["symbol", "period"]):
                if open_ is None or open_[0] != key:
                    if open_ is not None:
                        yield end(open_, n)
                    open_, n = begin(key), 0
                text = "\n".join(batch.column("line").slice(a, b - a).to_pylist())
                open_[5].write(f"{text}\n".encode())
                n += b - a
        if open_ is not None:
            yield end(open_, n)

    dealt = streamed(lines, ["symbol", "period"], [F.col(c) for c in order]).select("symbol", "period", "line")
    return dealt.mapInArrow(write, "symbol string, period string, sha256 string, n_lines long")


def _last_day(spark: SparkSession, path: str, symbol: str) -> date | None:
    """The UTC day of the symbol's newest tick in the table at path."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        return None
    newest = F.timestamp_add("MICROSECOND", F.unix_micros(F.max("ts")), F.expr("timestamp_ntz'1970-01-01'"))
    return table.where(F.col("symbol") == symbol).agg(F.to_date(newest)).first()[0]


def catch_up(spark: SparkSession, path: str, base: str, symbol: str, today: date, most: int = 14, into: str | None = None) -> dict:
    """Adds the days after the table's last one up to yesterday, `most` of them at most, up to the first that isn't published.

    Returns reason (empty_table: load months first; no_new_archive; complete), last_day_before, last_day_after and
    days. Ticks that the table has are not added again, so it may be repeated after a failure; a failed run adds nothing.
    """
    last = _last_day(spark, path, symbol)
    told = {"reason": "empty_table", "last_day_before": last, "last_day_after": last, "days": []}
    if last is None:
        return told
    asked = spark.range(1).select(days_to_catch_up(F.lit(last), F.lit(today), most)).first()[0]
    base_ = Address(base)
    days: list[str] = []
    for day in map(str, asked):
        if not base_.has(NAME.format(symbol=symbol, period=day)):
            break
        days.append(day)
    if not days:
        return told | {"reason": "no_new_archive"}
    months = sorted({d[:7] for d in days})
    add_ticks(ticks(read_archives(spark, base, [symbol], days, into=into), symbol), path, months)
    return told | {"reason": "complete", "last_day_after": _last_day(spark, path, symbol), "days": days}


def months_after(spark: SparkSession, start: date, today: date) -> list[str]:
    """yyyy-MM of the months from start's on that have ended by today."""
    return [f"{m:%Y-%m}" for m in spark.range(1).select(complete_months(F.lit(start), F.lit(today))).first()[0]]


def backfill(spark: SparkSession, path: str, log: DataFrame, base: str, symbol: str, start: date, today: date, into: str | None = None) -> DataFrame:
    """Loads the complete months that the log (symbol, month, sha256, n_rows, version) lacks or has with another sum; returns the new log.

    A month is replaced as a whole, so one that is published anew leaves no old tick. The log is of the caller, who keeps it
    once this has returned: a failed run is repeated.
    """
    months = months_after(spark, start, today)
    if not months:
        return log
    sums = read_archives(spark, base, [symbol], months, missing="stop", sums=True)
    published = sums.select("symbol", F.to_date("period", "yyyy-MM").alias("month"), "sha256")
    # as many rows as months
    wanted = to_load(published, log).orderBy("month").collect()
    if not wanted:
        return log
    lines = read_archives(spark, base, [symbol], [f"{r['month']:%Y-%m}" for r in wanted], into=into)
    write_ticks(ticks(lines, symbol), path)
    have = spark.read.parquet(path).where(F.col("symbol") == symbol).groupBy(F.to_date("month", "yyyy-MM").alias("month"))
    counts = have.agg(F.count(F.lit(1)).alias("n_rows"))
    news = spark.createDataFrame(wanted, published.schema).join(counts, "month", "left")
    version = (log.agg(F.max("version")).first()[0] or 0) + 1
    entries = news.select(
        "symbol", "month", "sha256", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), F.lit(version).cast("int").alias("version")
    )
    return upsert(log, entries, ["symbol", "month"], "version")

