"""Orders and their executions come from one pass over the lines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalog import accounts
from catalog.registry import QUERIES
from tests.test_trade_totals import DAY, _sorted
from tidepanel.operators import ledger as le
from tidepanel.session import stored


@pytest.mark.parametrize("query", ["m02_batch_status", "m02_marked_orders"])
def test_lines_are_joined_once_for_orders_and_executions(spark, query, monkeypatch):
    calls = []
    lines = accounts._order_lines
    monkeypatch.setattr(accounts, "_order_lines", lambda *args: calls.append(1) or lines(*args))
    QUERIES[query](spark, "/root/testdata/sf0.001").count()
    assert len(calls) == 1


def test_prices_listed_before_give_the_same_executions(spark):
    rows = [(1, "a", "o1", 5), (1, "a", "o1", 7), (1, "b", "o1", 2), (2, None, "o2", 1), (2, "a", None, 1), (3, "a", "o3", None)]
    orders = spark.createDataFrame(rows, "line int, account_id string, order_id string, requested_quantity bigint").select(
        "*", F.lit("T").alias("ticker"), F.lit("SELL").alias("side"), F.lit(DAY).alias("intended_execution_date"), F.lit("PENDING").alias("status")
    )
    price, on = F.col("requested_quantity").cast("decimal(18,6)"), ["account_id", "order_id"]
    listed = stored(le.list_own_prices(orders, price, on, ["line"]))
    got, want = le.price_executions(listed, None), le.price_executions(orders, price, on, dealt_by=["line"])
    assert listed.count() == len(rows) and want.count() == 6
    assert _sorted(got, want.columns) == _sorted(want, want.columns)
