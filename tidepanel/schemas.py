"""Explicit schemas of the panel, the universe and the account ledgers."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["date", "ticker"]
PRICES = ["open", "high", "low", "close", "adjusted_close"]
BAR_COLUMNS = [*KEYS, *PRICES, "volume", "value_traded"]

BAR_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        *[T.StructField(name, T.DoubleType()) for name in PRICES],
        T.StructField("volume", T.LongType()),
        T.StructField("value_traded", T.DoubleType()),
    ]
)

MONEY = T.DecimalType(38, 12)


def _fields(spec: str) -> T.StructType:
    """Build a schema from ``name:type`` items; types: s, d, t, q (quantity), m (money), b, i, f."""
    types = {
        "s": T.StringType(),
        "d": T.DateType(),
        "t": T.TimestampType(),
        "q": T.LongType(),
        "m": MONEY,
        "b": T.BooleanType(),
        "i": T.IntegerType(),
        "f": T.DoubleType(),
    }
    items = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(name, types[kind]) for name, kind in items])


# Ledger column names and their order.
LEDGERS: dict[str, T.StructType] = {
    "signals": _fields(
        "account_id:s signal_id:s data_asof_date:d signal_date:d intended_execution_date:d ticker:s "
        "model_name:s horizon_days:i score:f predicted_rank:i created_at:t"
    ),
    "target_weights": _fields(
        "account_id:s portfolio_id:s signal_date:d intended_execution_date:d ticker:s issuer_group:s "
        "target_weight:m rebalance_flag:b created_at:t"
    ),
    "orders": _fields(
        "account_id:s order_id:s signal_id:s order_date:d intended_execution_date:d ticker:s side:s "
        "requested_quantity:q estimated_price:m requested_value:m status:s reason_code:s created_at:t"
    ),
    "executions": _fields(
        "account_id:s execution_id:s order_id:s execution_date:d ticker:s side:s filled_quantity:q "
        "execution_price:m gross_value:m commission:m tax:m slippage:m net_cash_effect:m created_at:t"
    ),
    "positions": _fields(
        "account_id:s asof_date:d ticker:s issuer_group:s settled_shares:q unsettled_buy_shares:q "
        "pending_sell_shares:q sellable_quantity:q average_cost:m mark_price:m market_value:m weight:m"
    ),
    "cash_ledger": _fields(
        "account_id:s entry_id:s event_date:d settlement_date:d entry_type:s amount:m "
        "settled_cash_delta:m unsettled_cash_delta:m reference_id:s settled_cash_balance:m "
        "unsettled_cash_balance:m created_at:t"
    ),
    "settlement_ledger": _fields(
        "account_id:s settlement_id:s trade_date:d settlement_date:d ticker:s side:s quantity:q "
        "gross_amount:m fees_and_taxes:m status:s settled_at:d reference_id:s"
    ),
    "daily_performance": _fields(
        "account_id:s date:d portfolio_value:m settled_cash:m unsettled_cash:m market_value:m "
        "daily_return:m cumulative_return:m benchmark_value:m benchmark_return:m "
        "cumulative_benchmark_return:m active_return:m drawdown:m turnover:m cash_weight:m "
        "holdings_count:q skipped_trade_count:q"
    ),
    "skipped_trades": _fields(
        "account_id:s skip_id:s order_id:s date:d ticker:s side:s requested_quantity:q "
        "requested_value:m reason_code:s details:s created_at:t"
    ),
}

LEDGER_KEYS: dict[str, list[str]] = {
    "signals": ["account_id", "signal_id"],
    "target_weights": ["account_id", "portfolio_id", "ticker"],
    "orders": ["account_id", "order_id"],
    "executions": ["account_id", "execution_id"],
    "positions": ["account_id", "asof_date", "ticker"],
    "cash_ledger": ["account_id", "entry_id"],
    "settlement_ledger": ["account_id", "settlement_id"],
    "daily_performance": ["account_id", "date"],
    "skipped_trades": ["account_id", "skip_id"],
}
