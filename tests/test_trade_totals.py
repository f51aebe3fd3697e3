"""Totals of trades equal those of their events, and values come from one sum."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import ledger as le
from tidepanel.session import stored

DAY = dt.date(2020, 1, 1)
TRADES = (
    "account_id string, ticker string, side string, trade_date date, settlement_date date, quantity bigint, "
    "gross_amount decimal(38,12), net_cash_effect decimal(38,12), reference_id string, settlement_id string"
)


def _trades(spark, rows=300, seed=5):
    rng = random.Random(seed)
    made = []
    for k in range(rows):
        day = None if rng.random() < 0.05 else DAY + dt.timedelta(days=rng.randrange(8))
        later = None if day is None or rng.random() < 0.05 else day + dt.timedelta(days=2)
        quantity = None if rng.random() < 0.1 else rng.randrange(1, 90)
        amount = None if rng.random() < 0.1 else rng.randrange(1, 10**6)
        made.append(
            (rng.choice(["a", "b", "c", "d", None]), rng.choice(["AAA", "BBB", "CCC", None]), rng.choice(["BUY", "SELL", None]),
             day, later, quantity, amount, amount, f"r{k}", f"s{k}")
        )
    texts = [tuple(None if v is None else str(v) for v in r) for r in made]
    frame = spark.createDataFrame(texts, ", ".join(f"{c} string" for c in ("account_id", "ticker", "side", "trade_date", "settlement_date", "quantity", "gross_amount", "net_cash_effect", "reference_id", "settlement_id")))
    return frame.selectExpr(*[f"CAST({c} AS {t}) AS {c}" for c, t in (p.strip().split(" ") for p in TRADES.replace("38,12", "38;12").split(",")) for t in [t.replace(";", ",")]])


def _sorted(frame, columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("rows", [20, 300])
def test_totals_of_trades_are_those_of_their_events(spark, seed, rows):
    trades = stored(_trades(spark, rows, seed))
    asof = DAY + dt.timedelta(days=5)
    deposits = spark.createDataFrame([("a", DAY, 500), ("z", DAY, 7), (None, DAY, 3), ("b", DAY + dt.timedelta(days=9), 1)], "account_id string, event_date date, amount int")
    totals = stored(le.trade_totals(trades, asof, deposits))
    events = stored(le.event_totals(le.account_events(trades, asof, deposits)))
    assert _sorted(totals, events.columns) == _sorted(events, events.columns)
    bought = trades.where((F.col("side") == "BUY") & (F.col("trade_date") <= F.lit(asof))).groupBy("account_id", "ticker").agg(F.sum("gross_amount").alias("bought"))
    assert _sorted(totals.where("purchases > 0"), bought.columns) == _sorted(bought, bought.columns)
    positions = le.share_positions(events)
    assert _sorted(le.summed_positions(totals), positions.columns) == _sorted(positions, positions.columns)
    marks = spark.createDataFrame([("AAA", "3.5"), ("BBB", "-1")], "ticker string, mark string").select("ticker", F.col("mark").cast("decimal(18,6)").alias("mark_price"))
    values = le.portfolio_value(positions, le.balances(events), marks)
    assert _sorted(le.account_values(totals, marks), values.columns) == _sorted(values, values.columns)


def _moves(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_trades_are_moved_once_for_totals_and_positions_not_again(spark):
    trades = stored(_trades(spark))
    totals = le.trade_totals(trades, DAY)
    assert "Generate" not in totals._jdf.queryExecution().executedPlan().toString() and _moves(totals) == 1
    assert _moves(le.summed_positions(totals)) == 1
