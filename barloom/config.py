"""Parameters of the pipeline in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BarParams:
    threshold: float = 0.02
    max_hours: float = 168.0


@dataclass(frozen=True)
class LabelParams:
    tp: float = 0.05
    sl: float = 0.05
    vertical: int = 24

    def __post_init__(self) -> None:
        if self.tp <= 0 or self.sl <= 0 or self.vertical < 1:
            raise ValueError("barriers must be positive and the vertical barrier at least one bar")


@dataclass(frozen=True)
class FoldParams:
    train_months: int = 24
    val_months: int = 3
    oot_months: int = 3
    step_months: int = 3
    purge: int = 24
    embargo: int = 24
    min_rows: int = 100


@dataclass(frozen=True)
class BacktestParams:
    threshold: float = 0.60
    cost_bps: float = 11.0
    max_concurrent: int = 1
    start_equity: float = 10_000.0


#: Round-trip cost scenarios in basis points; fixed values.
COST_SCENARIOS = {
    "optimistic": 5.0,
    "realistic": 7.0,
    "baseline": 9.0,
    "current_default": 11.0,
    "conservative": 15.0,
}
#: Periods of the feature contract; fixed values.
EMA_PERIODS = (5, 10, 15, 20, 50)
STD_PERIODS = (5, 10, 15, 20, 50)
RSI_PERIODS = (6, 10, 14)
LONG, SHORT, NEUTRAL, UNLABELED = 0, 1, 2, -1
