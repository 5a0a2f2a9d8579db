"""Column expressions for raw tick records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_to_timestamp(epoch: Column) -> Column:
    """Milliseconds or, above 10**14, microseconds."""
    return F.when(epoch > 10**14, F.timestamp_micros(epoch)).otherwise(F.timestamp_millis(epoch))


def bool_lenient(token: Column) -> Column:
    """true and 1 are true, all else is false."""
    return F.coalesce(F.lower(F.trim(token)).isin("true", "1"), F.lit(False))


def bool_strict(token: Column) -> Column:
    """true, 1, false and 0; anything else fails the query."""
    t = F.lower(F.trim(token))
    return (
        F.when(t.isin("true", "1"), True)
        .when(t.isin("false", "0"), False)
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(token, F.lit("null")))))
    )


def symbol_short(symbol: Column) -> Column:
    """BTCUSDT becomes btc."""
    return F.lower(F.regexp_replace(F.upper(symbol), "USDT$", ""))


def complete_months(start: Column, today: Column) -> Column:
    """First days of the months from start's to the last one that ended before today's; empty if none."""
    first, last = F.trunc(start, "MM"), F.add_months(F.trunc(today, "MM"), -1)
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))).otherwise(
        F.array().cast("array<date>")
    )


def days_to_catch_up(last: Column, today: Column, most: int = 14) -> Column:
    """The days after the last one loaded, up to yesterday; the first `most` of them, none if there are none."""
    first, end = F.date_add(last, 1), F.least(F.date_sub(today, 1), F.date_add(last, most))
    return F.when(first <= end, F.sequence(first, end, F.expr("interval 1 day"))).otherwise(F.array().cast("array<date>"))


def parse_line(line: Column) -> dict[str, Column]:
    """Columns of one archive line: agg_id, price, qty, first_id, last_id, epoch, is_buyer_maker[, best_match].

    agg_id is null on a header line.
    """
    part = F.split(line, ",")

    def number(i: int, kind: str) -> Column:
        return F.get(part, F.lit(i)).try_cast(kind)

    price, qty = number(1, "double"), number(2, "double")
    return {
        "agg_id": number(0, "bigint"),
        "ts": epoch_to_timestamp(number(5, "bigint")),
        "price": price,
        "qty": qty,
        "quote_qty": price * qty,
        "is_buyer_maker": bool_lenient(F.get(part, F.lit(6))),
    }
