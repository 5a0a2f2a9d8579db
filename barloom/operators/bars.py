"""Event bars: the CUSUM filter, and what is reported of bars."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.streams import runs
from barloom.operators.scan import positions
from barloom.sources.scratch import written

#: What a bar carries, in order.
BAR_COLUMNS = (
    "symbol string, seq long, bar_open_ts timestamp_ntz, bar_close_ts timestamp_ntz, open double, high double, "
    "low double, close double, volume double, n_trades long, cusum_pos double, cusum_neg double"
)


#: Ticks of a bar that are walked one by one before whole stretches are.
_SINGLE = 24


class Cusum:
    """The filter's state for one symbol: both sums, the last log price, and the open bar."""

    __slots__ = ("bar", "closed_at", "last", "limit", "seq", "sneg", "spos", "threshold")

    def __init__(self, threshold: float, max_hours: float):
        self.threshold, self.limit = threshold, int(max_hours * 3_600_000_000)
        self.spos = self.sneg = 0.0
        self.last: float | None = None
        self.bar: list | None = None
        self.seq = 0
        self.closed_at: list[int] = []

    def feed(self, ts: np.ndarray, log_price: np.ndarray, price: np.ndarray, qty: np.ndarray) -> list[tuple]:
        """Bars that these ticks close (closed_at: at which of them); ts in microseconds. The last, partial bar stays open.

        Short bars are walked tick by tick, what is beyond in stretches: with C the running sums of returns in a
        stretch, the positive sum is C + max(the sum before it, -min(C so far)), and the negative one its mirror.
        """
        ts, log_price, price, qty = (np.asarray(x) for x in (ts, log_price, price, qty))
        n = len(ts)
        self.closed_at = []
        if not n:
            return []
        step = np.diff(log_price, prepend=log_price[0] if self.last is None else self.last)
        self.last = float(log_price[-1])
        out, at = [], 0
        while at < n:
            if self.bar is None:
                self.bar = [int(ts[at]), float(price[at]), -np.inf, np.inf, 0.0, 0]
            end, closed = self._next_close(ts, step, at)
            bar, part = self.bar, slice(at, end)
            bar[2], bar[3] = max(bar[2], float(price[part].max())), min(bar[3], float(price[part].min()))
            bar[4] += float(qty[part].sum())
            bar[5] += end - at
            if closed:
                t, o, h, low, v, k = bar
                out.append((self.seq, t, int(ts[end - 1]), o, h, low, float(price[end - 1]), v, k, self.spos, self.sneg))
                self.closed_at.append(end - 1)
                self.seq += 1
                self.spos = self.sneg = 0.0
                self.bar = None
            at = end
        return out

    def _next_close(self, ts: np.ndarray, step: np.ndarray, at: int) -> tuple[int, bool]:
        """The place after the next tick that closes the bar, or the end; sums are moved up to there."""
        threshold, opened, limit = self.threshold, self.bar[0], self.limit
        spos, sneg = self.spos, self.sneg
        stop = min(at + _SINGLE, len(ts))
        for i, (t, x) in enumerate(zip(ts[at:stop].tolist(), step[at:stop].tolist(), strict=True), at):
            spos = spos + x if spos + x > 0 else 0.0
            sneg = sneg + x if sneg + x < 0 else 0.0
            if spos >= threshold or -sneg >= threshold or t - opened >= limit:
                self.spos, self.sneg = spos, sneg
                return i + 1, True
        size = 4 * _SINGLE
        while stop < len(ts):
            part = slice(stop, stop + size)
            c = np.cumsum(step[part])
            pos = c + np.maximum(spos, -np.minimum.accumulate(c))
            neg = c + np.minimum(sneg, -np.maximum.accumulate(c))
            hit = (pos >= threshold) | (-neg >= threshold) | (ts[part] - opened >= limit)
            k = int(hit.argmax())
            if hit[k]:
                self.spos, self.sneg = float(pos[k]), float(neg[k])
                return stop + k + 1, True
            spos, sneg = float(pos[-1]), float(neg[-1])
            stop, size = stop + len(c), min(2 * size, 1 << 16)
        self.spos, self.sneg = spos, sneg
        return len(ts), False

    def state(self) -> tuple:
        return (self.spos, self.sneg, self.last, *(self.bar or [None] * 6))

    def resume(self, state: tuple) -> Cusum:
        self.spos, self.sneg, self.last = state[:3]
        self.bar = None if state[3] is None else list(state[3:9])
        return self


#: A filter's state at the end of a stretch of the tape.
_STATE = ["spos", "sneg", "last", "bar_t", "bar_open", "bar_high", "bar_low", "bar_volume", "bar_n"]
_WALKED = (
    "symbol string, chunk long, seq long, open_t long, close_t long, open double, high double, low double, close double, "
    "volume double, n_trades long, cusum_pos double, cusum_neg double, close_id long, spos double, sneg double, last double, "
    "bar_t long, bar_open double, bar_high double, bar_low double, bar_volume double, bar_n long"
)


def _walked(tape: DataFrame, threshold: float, max_hours: float) -> DataFrame:
    """The bars of each (symbol, chunk) of a sorted tape, from its entry state on (null: a fresh start), and a last row with its end state (seq null)."""
    names = [f.split()[0] for f in _WALKED.split(", ")]

    def walk(batches):
        key, state = None, None

        def end():
            if key is not None:
                row = dict.fromkeys(names) | dict(zip(("symbol", "chunk"), key, strict=True)) | dict(zip(_STATE, state.state(), strict=True))
                yield pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[f.split()[1]]) for n, f in zip(names, _WALKED.split(", "), strict=True)])
        for batch in batches:
            for own, begin, stop in runs(batch, ["symbol", "chunk"]):
                part = batch.slice(begin, stop - begin)
                if own != key:
                    yield from end()
                    key, state = own, Cusum(threshold, max_hours)
                    entry = part.column("entry")[0].as_py() if "entry" in part.schema.names else None
                    if entry is not None:
                        state.resume(tuple(entry[c] for c in _STATE))
                bars = state.feed(*(part.column(c).to_numpy(zero_copy_only=False) for c in ("t", "lp", "price", "qty")))
                if bars:
                    ids = part.column("agg_id").to_numpy(zero_copy_only=False)[state.closed_at]
                    columns = [[own[0]] * len(bars), [own[1]] * len(bars), *zip(*bars, strict=True), ids]
                    columns += [[None] * len(bars)] * len(_STATE)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        yield from end()

    return tape.mapInArrow(walk, _WALKED)


def cusum_bars(
    ticks: DataFrame, threshold: float, max_hours: float = 168.0, log_price: Column | None = None, chunk_hours: float | None = 24.0 * 7
) -> DataFrame:
    """Bars of ticks (symbol, agg_id, ts, price, qty): BAR_COLUMNS.

    Both sums of log returns grow from zero (one never below, the other never
    above); a bar closes when either reaches the threshold or it is max_hours
    old at a tick, and the sums start anew, while the next bar's first return
    still counts from this bar's close. The trailing open bar is no bar yet.

    A symbol's tape is cut into chunks of chunk_hours, which are walked in parallel, each streaming in order of
    (ts, agg_id) with a fresh start at its first tick. Then each chunk's
    beginning is walked again from the state in which the chunk before ended. Where both walks close a bar at the same
    tick they agree from there on, so only what lies before is replaced; that is usually a few bars. Where they never
    meet, the chunk's own end state changes, and the next chunk is walked again with it. The result is that of one walk
    over the whole tape. chunk_hours=None walks each symbol in one task. Ticks without a symbol are left out.
    log_price: default ln(price).
    """
    lp = F.ln("price") if log_price is None else log_price
    if ticks.schema["ts"].dataType.typeName() == "timestamp_ntz":
        micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("ts"))
    else:
        micros = F.unix_micros("ts")
    width = int(chunk_hours * 3_600_000_000) if chunk_hours else None
    tape = ticks.where("symbol IS NOT NULL").select(
        "symbol",
        (F.floor(micros / width) if width else F.lit(0)).cast("long").alias("chunk"),
        micros.alias("t"),
        "agg_id",
        lp.cast("double").alias("lp"),
        F.col("price").cast("double").alias("price"),
        F.col("qty").cast("double").alias("qty"),
    )
    tape = tape.withColumn("agg_id", F.col("agg_id").cast("long"))

    def sorted_(rows: DataFrame) -> DataFrame:
        # dealt by an expression of its own: a join's shuffle by symbol and chunk may be split where a partition is large
        return rows.repartition(F.xxhash64("symbol", "chunk")).sortWithinPartitions("symbol", "chunk", "t", "agg_id")

    walked = _walked(sorted_(tape), threshold, max_hours)
    bars = walked.where("seq IS NOT NULL")
    if width:
        walked = written(walked, "cusum-chunks")
        bars = _stitched(tape, walked, lambda rows: _walked(sorted_(rows), threshold, max_hours))
    order = Window.partitionBy("symbol").orderBy("chunk", "seq")
    epoch = F.expr("timestamp_ntz'1970-01-01'")
    return bars.select(
        "symbol",
        (F.row_number().over(order) - 1).cast("long").alias("seq") if width else "seq",
        F.timestamp_add("MICROSECOND", F.col("open_t"), epoch).alias("bar_open_ts"),
        F.timestamp_add("MICROSECOND", F.col("close_t"), epoch).alias("bar_close_ts"),
        *["open", "high", "low", "close", "volume", "n_trades", "cusum_pos", "cusum_neg"],
    )


def _stitched(tape: DataFrame, walked: DataFrame, walk) -> DataFrame:
    """The bars of one walk over the whole tape, from those of the chunks' own walks.

    The tables of states have a row for each symbol and chunk, those of closes one for each bar.
    """
    key = ["symbol", "chunk"]
    by_chunk = Window.partitionBy("symbol").orderBy("chunk")
    own = walked.where("seq IS NOT NULL")
    closes = own.select(*key, "close_t", "close_id", F.col("seq").alias("own_seq"))
    state = F.struct(*_STATE)
    # the state in which each chunk ends, as far as is known by now
    ends = walked.where("seq IS NULL").select(*key, state.alias("end"))
    own_ends = ends.withColumnRenamed("end", "own_end")
    entered = ends.select(*key, F.lag("end").over(by_chunk).alias("entry")).where("entry IS NOT NULL")
    todo, fixed, few = written(entered, "cusum-entries"), None, 8
    while not todo.isEmpty():
        # up to the close of some bars of the chunk's own walk; all of the chunk if that was not enough
        reach = own.where(F.col("seq") == few - 1).select(*key, F.col("close_t").alias("reach")) if few else None
        asked = todo.join(reach, key, "left") if few else todo.withColumn("reach", F.lit(None).cast("long"))
        some = tape.join(F.broadcast(asked) if todo.count() <= 100_000 else asked, key).where(F.col("reach").isNull() | (F.col("t") <= F.col("reach"))).drop("reach")
        again = written(walk(some), "cusum-again")
        met = again.where("seq IS NOT NULL").join(closes, [*key, "close_t", "close_id"])
        met = met.groupBy(*key).agg(F.min_by(F.struct("seq", "own_seq"), "seq").alias("at"))
        last = again.where("seq IS NULL").select(*key, state.alias("new_end"))
        whole = asked.select(*key, F.col("reach").isNull().alias("whole"))
        judged = written(last.join(met, key, "left").join(whole, key), "cusum-met")
        short = judged.where("at IS NULL AND NOT whole").select(*key)
        done = judged.where("at IS NOT NULL OR whole")
        # bars of the second walk up to where both close, then those of the first
        made = again.where("seq IS NOT NULL").join(done, key).where("at IS NULL OR seq <= at.seq").select(*again.columns)
        kept = done.select(*key, F.coalesce("at.own_seq", F.lit(2**62)).alias("from_seq"))
        fixed = (made, kept) if fixed is None else tuple(
            old.join(new_keys, key, "left_anti").unionByName(new) for old, new, new_keys in ((fixed[0], made, kept.select(*key)), (fixed[1], kept, kept.select(*key)))
        )
        # where the walks never meet, the next chunk begins from another state than it was given
        news = done.join(own_ends, key).select(*key, F.when(F.col("at").isNull(), F.col("new_end")).otherwise(F.col("own_end")).alias("other"))
        moved = F.col("other").isNotNull() & ~F.col("other").eqNullSafe(F.col("end"))
        ends = ends.join(news, key, "left").select(*key, F.coalesce("other", "end").alias("end"), moved.alias("moved"))
        if judged.where("at IS NULL").isEmpty() and few:
            break  # all walks met, so no end has moved
        ends = written(ends, "cusum-ends")
        after = ends.select(*key, F.lag("end").over(by_chunk).alias("entry"), F.lag("moved").over(by_chunk).alias("anew")).where("anew")
        entries = ends.select(*key, F.lag("end").over(by_chunk).alias("entry")).join(short, key, "left_semi")
        todo = written(entries.unionByName(after.drop("anew")).dropDuplicates(key), "cusum-entries")
        few = 0
        ends = ends.drop("moved")
    if fixed is None:
        return own
    rest = own.join(fixed[1], key, "left").where("from_seq IS NULL OR seq > from_seq").drop("from_seq")
    # the second walk's bars come first; a chunk's own keep their order behind them
    return fixed[0].withColumn("seq", F.col("seq") - F.lit(2**40)).unionByName(rest)


def count_bars(ticks: DataFrame, size: int, number: Column | None = None) -> DataFrame:
    """Bars of `size` consecutive ticks of a symbol: bar_id, OHLC, volume; a short last one is left out.

    number: a column with the ticks' places from 1 in their symbol by (ts, agg_id), where they are known already.
    """
    if number is None:
        numbered = positions(ticks, ["symbol"], [F.col("ts"), F.col("agg_id")], "n")
    else:
        numbered = ticks.withColumn("n", number)
    first, last = F.struct("n", "price"), F.struct("n", "price")
    return (
        numbered.groupBy("symbol", F.floor((F.col("n") - 1) / size).alias("bar_id"))
        .agg(
            F.min("ts").alias("bar_open_ts"),
            F.max("ts").alias("bar_close_ts"),
            F.min(first)["price"].alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max(last)["price"].alias("close"),
            F.sum("qty").alias("volume"),
            F.count(F.lit(1)).alias("n_trades"),
        )
        .where(F.col("n_trades") == size)
    )


def close_reason(threshold: float) -> Column:
    return F.when(F.greatest(F.col("cusum_pos"), -F.col("cusum_neg")) >= threshold, "cusum").otherwise("timeout")


def ohlcv(ticks: DataFrame, *keys: str) -> DataFrame:
    """Open, high, low, close, volume and count of ticks by key."""
    place = F.struct("ts", "agg_id")
    return ticks.groupBy(*keys).agg(
        F.min_by("price", place).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", place).alias("close"),
        F.sum("qty").alias("volume"),
        F.count(F.lit(1)).alias("n_trades"),
    )


def seconds(bar_open: str = "bar_open_ts", bar_close: str = "bar_close_ts") -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(bar_open), F.col(bar_close)) / 1e6


def index_percentile(values: Column, q: float) -> Column:
    """sorted[int(n * q)] of a small group, as an aggregate: it holds the group in one row; see index_percentiles."""
    return F.element_at(F.array_sort(F.collect_list(values)), (F.floor(F.count(values) * q) + 1).cast("int"))


def index_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key, for each name in `shares`, sorted[int(n * share)]: an element of the group, not interpolated.

    Values are numbered by a scan over ranges, so a group of any size is many tasks, and nothing of it is collected. Nulls are left out; a key
    without values has no row. A share of 1 and more has none to name: null.
    """
    placed = positions(rows.where(F.col(value).isNotNull()).select(*keys, value), keys, [F.col(value)], "_place")
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).select(F.struct(*keys).alias("_key"), "_rows")
    sized = placed.join(counts, F.struct(*keys).eqNullSafe(F.col("_key")))
    wanted = {n: F.col("_place") == F.floor(F.col("_rows") * q) + 1 for n, q in shares.items()}
    return sized.groupBy(*keys).agg(*[F.max(F.when(at, F.col(value))).alias(n) for n, at in wanted.items()])


def ordered_digest(
    rows: DataFrame, keys: list[str], text: Column, order: list[Column], out: str = "print", chunk: int = 256, levels: int | None = None
) -> DataFrame:
    """Per key an md5 of its rows' texts in order: of chunks of so many rows (joined by |), then of as many of these, until one is left.

    So it is the md5 of the joined texts of a key of at most `chunk` rows, and no task holds more than a chunk of a group. Null
    texts are left out of what is joined. Rows that are equal in the order make the digest undefined: give an order that is total.
    With `levels` it ends after so many: a key of more than chunk ** levels rows has a digest, and a row, for each such stretch of them.
    """
    names = [f"_o{i}" for i in range(len(order))]
    rows = rows.select(*keys, text.alias("_text"), *[c.alias(n) for c, n in zip(order, names, strict=True)])
    level, first = positions(rows, keys, [F.col(n) for n in names], "_n").select(*keys, "_text", "_n"), True
    for made in itertools.count(1):
        part = F.sort_array(F.collect_list(F.struct("_n", "_text")))
        digest = F.md5(F.array_join(F.transform(part, lambda r: r["_text"]), "|"))
        if not first:
            # a key of one digest is done, whatever the others are
            digest = F.when((F.count(F.lit(1)) == 1) & (F.max("_n") == 1), F.max("_text")).otherwise(digest)
        level = level.groupBy(*keys, F.floor((F.col("_n") - 1) / chunk).alias("_chunk")).agg(digest.alias("_text"))
        level, first = written(level.select(*keys, "_text", (F.col("_chunk") + 1).alias("_n")), "digests"), False
        if made == levels or level.where("_n > 1").isEmpty():
            return level.select(*keys, F.col("_text").alias(out))
