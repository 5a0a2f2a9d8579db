"""The place in the week's range, by hours, against plain Python."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from barloom.operators import tier1

_WEEK = timedelta(days=7)


def _rows() -> list[tuple]:
    """Bars of two symbols over 17 days; whole hours, the same times again and again, and times before 1970."""
    rng = np.random.default_rng(3)
    rows = []
    for symbol, start in (("A", datetime(2024, 1, 1)), ("B", datetime(1969, 12, 24))):
        minutes = np.sort(rng.integers(0, 17 * 24 * 2, 400)) * 30
        for i, m in enumerate(minutes.tolist()):
            close = float(rng.integers(80, 120))
            rows.append((symbol, i, start + timedelta(minutes=m), close, close + float(rng.integers(0, 9)), close - float(rng.integers(0, 9))))
    return rows


def _place(rows: list[tuple], row: tuple, peers: bool) -> float:
    symbol, bar, ts, close = row[:4]
    seen = [r for r in rows if r[0] == symbol and ts - _WEEK <= r[2] <= ts and (peers or r[2] < ts or r[1] <= bar)]
    top, bottom = max(r[4] for r in seen), min(r[5] for r in seen)
    return 0.5 if top == bottom else min(max((close - bottom) / (top - bottom), 0.0), 1.0)


@pytest.mark.parametrize("peers", [False, True])
def test_week_position_with_equal_times(spark, peers):
    rows = _rows()
    bars = spark.createDataFrame(rows, "symbol string, bar_id long, bar_close_ts timestamp_ntz, close double, high double, low double")
    made = tier1.week_position(bars, peers)
    assert made.columns == [*bars.columns, "weekly_range_pos"]
    found = {(r["symbol"], r["bar_id"]): r["weekly_range_pos"] for r in made.collect()}
    assert len(found) == len(rows)
    for row in rows:
        assert found[row[:2]] == pytest.approx(_place(rows, row, peers))
    assert any(_place(rows, r, True) != _place(rows, r, False) for r in rows)
