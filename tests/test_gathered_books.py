"""Books of accounts that lie together: lines are moved by account once, and nothing else changes."""

from __future__ import annotations

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from catalog import accounts
from tests.test_ledger_moves import _events, _plain, _tables
from tests.test_trade_totals import _sorted
from tidepanel.operators import ledger as le
from tidepanel.session import working_folder

DAY = dt.date(2020, 1, 1)


def _moves(frame):
    """Keys of every shuffle by account."""
    return re.findall(r"Exchange hashpartitioning\((account_id[^)]*), \d+\)", re.sub(r"#\d+L?", "", frame._jdf.queryExecution().executedPlan().toString()))


def _odd_lines(spark, undated=False):
    """Lines with equal ids and other prices, and with null values; undated ones cannot be settled."""
    folder = _tables(spark, 40)
    path = f"{folder}/lineitem.parquet"
    rows = spark.read.parquet(path)
    twice = rows.where("l_orderkey < 3").withColumn("l_quantity", F.col("l_quantity") + 1)
    nulls = [rows.where("l_orderkey = 5").withColumn(c, F.lit(None).cast(t)) for c, t in rows.dtypes if undated or c != "l_shipdate"]
    changed = rows.unionByName(rows.where("l_orderkey = 4")).unionByName(twice)
    for frame in nulls:
        changed = changed.unionByName(frame)
    other = working_folder(spark, "tables")
    changed.write.parquet(f"{other}/lineitem.parquet")
    heads = spark.read.parquet(f"{folder}/orders.parquet")
    heads.withColumn("o_custkey", F.when(F.col("o_orderkey") != 7, F.col("o_custkey"))).write.parquet(f"{other}/orders.parquet")
    spark.read.parquet(f"{folder}/part.parquet").write.parquet(f"{other}/part.parquet")
    return other


def test_stored_lines_give_the_same_executions(spark):
    folder = _odd_lines(spark, undated=True)
    kept = accounts._kept_lines(spark, folder)
    assert "line_id" not in kept.columns and kept.where("size(buy_prices) = 0").count() > 0
    got, want = accounts._executions(spark, folder, accounts._reread_lines(kept)), accounts._executions(spark, folder)
    assert _sorted(got, want.columns) == _sorted(want, want.columns) and want.count() > 60


def test_lines_are_moved_by_account_before_they_become_events(spark):
    folder = _odd_lines(spark)
    kept, asof = accounts._kept_lines(spark, folder), accounts._asof(spark, folder)
    trades, deposits, together = accounts._gathered_trades(spark, folder, kept)
    assert together is None
    found = le.trade_violations(le.account_events(trades, asof, deposits), together)
    # The lines are moved once; accounts with a deposit are told apart and moved.
    moves = _moves(found)
    assert moves == ["account_id"] * len(moves) and len(moves) <= 3, moves
    plain = le.account_events(accounts._trades(spark, folder), asof, accounts._deposits(spark, folder))
    want = le.trade_violations(plain)
    assert _sorted(found, want.columns) == _sorted(want, want.columns)
    ledger, other = le.cash_ledger(le.account_events(trades, asof, deposits), together), le.cash_ledger(plain)
    assert _moves(ledger) == moves
    assert _sorted(ledger, other.columns) == _sorted(other, other.columns) and other.count() > 60


def test_one_large_account_is_not_gathered(spark, monkeypatch):
    folder = _odd_lines(spark)
    monkeypatch.setattr(le, "ROWS_TOGETHER", 10)
    trades, deposits, together = accounts._gathered_trades(spark, folder, accounts._kept_lines(spark, folder))
    assert together == 10
    asof = accounts._asof(spark, folder)
    found = le.trade_violations(le.account_events(trades, asof, deposits), together)
    want = le.trade_violations(le.account_events(accounts._trades(spark, folder), asof, accounts._deposits(spark, folder)), 100_000)
    assert _sorted(found, want.columns) == _sorted(want, want.columns)


def test_pieces_grow_with_the_events(spark, monkeypatch):
    trades = spark.range(1000).select((F.col("id") % 50).cast("string").alias("account_id"))
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert le.account_pieces(trades) == usual and le.account_pieces(trades, 40) is None and le.account_pieces(trades.limit(0)) == usual
    monkeypatch.setattr(le, "ROWS_PER_TASK", 100)
    assert le.account_pieces(trades) == 2050 // 100 + 1


@pytest.mark.parametrize("by", [[0], [0, 1]])
@pytest.mark.parametrize("together", [None, 100_000, 120, 1])
def test_kept_rows_have_the_same_totals(spark, by, together):
    made, events = _events(spark)
    names = [events.columns[k] for k in by]
    got = le.running_totals(events, {"delta": "total"}, names, "event_date", ["phase", "entry_id"], together, keep=True)
    want = _plain(made, by)
    assert got.columns == [*events.columns, "total"]
    assert {r["entry_id"]: r["total"] for r in got.collect()} == {r[4]: want.get(r[4]) for r in made}


@pytest.mark.parametrize("together", [None, 100_000, 5])
def test_violations_of_a_ledger(spark, together):
    """Every rule on its own and together, with null accounts, dates and entries."""
    draw = random.Random(5)
    types = ["INITIAL_DEPOSIT", "BUY_EXECUTION", "SELL_SETTLEMENT"]
    rows = []
    for k in range(200):
        account = draw.choice(["a", "b", "c", "d", "e", None])
        day = None if draw.random() < 0.05 else DAY + dt.timedelta(days=draw.randrange(5))
        entry = None if draw.random() < 0.02 else f"e{k if draw.random() < 0.9 else draw.randrange(9)}-{k if account in ('a', 'b') else 0}"
        rows.append((account, entry, day, draw.choice(types), Decimal(draw.randrange(-3, 9)), Decimal(1), Decimal(0), Decimal(0)))
    schema = "account_id string, entry_id string, event_date date, entry_type string, settled_cash_delta decimal(38,12), unsettled_cash_delta decimal(38,12), settled_cash_balance decimal(38,12), unsettled_cash_balance decimal(38,12)"
    ledger = le.running_totals(
        spark.createDataFrame(rows, schema).drop("settled_cash_balance"), {"settled_cash_delta": "settled_cash_balance"},
        ["account_id"], "event_date", ["entry_id"], keep=True,
    )
    count = F.lit(0).cast("decimal(38,12)")
    ledger = ledger.withColumn("settled_cash_balance", F.coalesce("settled_cash_balance", count))
    none = F.lit(None).cast("string").alias("ticker")
    want = (
        ledger.groupBy("account_id", "entry_id").count().where("count > 1").select("account_id", none, F.lit("duplicate_entry").alias("violation"))
        .unionByName(ledger.where("settled_cash_balance < 0 OR unsettled_cash_balance < 0").select("account_id", none, F.lit("negative_balance").alias("violation")).distinct())
        .unionByName(le.balance_problems(ledger).select("account_id", none, F.lit("wrong_running_balance").alias("violation")).distinct())
    )
    got = le._ledger_violations(ledger, together)
    assert _sorted(got, want.columns) == _sorted(want, want.columns)
    assert {r["violation"] for r in want.collect()} == {"duplicate_entry", "negative_balance", "wrong_running_balance"}
    together = ledger.repartition(3, "account_id")
    assert _moves(le._ledger_violations(together, None)) == _moves(together)
