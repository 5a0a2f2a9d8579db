"""Table schemas, declared once. Symbols and thresholds are columns, not table names."""

from __future__ import annotations

from pyspark.sql.types import StructType


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


TICKS = _schema(
    "symbol string, agg_id bigint, ts timestamp, price double, qty double, quote_qty double, is_buyer_maker boolean"
)
BARS = _schema(
    "symbol string, threshold_bp int, seq bigint, bar_open_ts timestamp, bar_close_ts timestamp, open double, "
    "high double, low double, close double, volume double, n_trades int, cusum_pos double, cusum_neg double"
)
LABELS = _schema(
    "bar_id bigint, label int, exit_bar_id bigint, exit_reason string, holding_bars int, exit_price double"
)
INGEST_LOG = _schema("symbol string, month date, sha256 string, n_rows bigint, ingested_at timestamp")
SESSIONS = _schema(
    "session_id bigint, name string, started_at timestamp, ended_at timestamp, status string, initial_equity double"
)
PAPER_TRADES = _schema(
    "trade_id bigint, session_id bigint, bar_id bigint, direction int, status string, entry_ts timestamp, "
    "entry_price double, exit_ts timestamp, exit_price double, exit_reason string, pnl_bps double"
)
PAPER_DECISIONS = _schema(
    "decision_id bigint, session_id bigint, bar_id bigint, bar_close_ts timestamp, decision string, p_long double, "
    "p_short double, p_neutral double, reason string"
)
RUNS = _schema("run_id string, created_at timestamp, symbol string, config string, n_trades bigint")
TRADES = _schema(
    "run_id string, fold_id int, bar_id bigint, entry_ts timestamp, exit_ts timestamp, entry_price double, "
    "exit_price double, direction int, exit_reason string, holding_bars int, pnl_bps_gross double, pnl_bps_net double"
)
