"""Spending of cash by running sums, against a walk over one purchase after the other."""

from __future__ import annotations

import random
from collections import Counter
from decimal import ROUND_FLOOR, Decimal

import pytest
from pyspark.sql import functions as F

from tidepanel.functions.ranking import in_blocks, numbered
from tidepanel.operators import orders as om

SCHEMA = (
    "account_id string, ticker string, predicted_rank bigint, allowed bigint, price decimal(18,6), "
    "lot_value decimal(38,12), spendable decimal(38,12)"
)


def walk(rows, rules):
    """(account, ticker) -> cash before, by hand."""
    lot = 1 if rules.allow_odd_lots else rules.round_lot_size
    rate = 1 + Decimal(rules.commission_rate) + Decimal(rules.slippage_rate)
    cash, out = {}, {}
    for account, ticker, _, allowed, price, _, spendable in sorted(rows, key=lambda r: (r[0], r[2], -r[5], r[1])):
        left = cash.setdefault(account, spendable)
        out[account, ticker] = left
        fits = 0
        if left > 0:
            fits = int((left / (price * rate)).to_integral_value(ROUND_FLOOR))
            fits -= fits % lot
        quantity = min(allowed, fits)
        if quantity > 0 and quantity * price >= Decimal(rules.min_trade_value):
            cash[account] = left - quantity * price * rate
    return out


def request(account, number, rank, allowed, price, spendable):
    price = Decimal(price)
    return (account, f"T{number:05d}", rank, allowed, price, allowed * price, Decimal(spendable))


def check(spark, rows, rules, block_rows=7):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = om._cash_before_purchases(frame, rules, len(rows), block_rows).collect()
    assert len(got) == len(rows)
    assert {(r["account_id"], r["ticker"]): r["cash_before"] for r in got} == walk(rows, rules)


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("smallest", ["0", "1000"])
def test_cash_before_each_purchase_equals_the_walk(spark, odd, smallest):
    rules = om.Constraints(min_trade_value=smallest, round_lot_size=10, allow_odd_lots=odd)
    draw = random.Random(7)
    rows = []
    for k in range(300):
        # One account has a third of all requests; ranks tie, some requests have nothing to buy.
        account = "hot" if k % 3 == 0 else f"a{draw.randrange(12)}"
        price = f"{draw.choice([0.05, 1, 7.35, 99, 1203.123456]) * draw.choice([1, 3]):.6f}"
        cash = {"hot": "250000.123456", "a0": "0", "a1": "0.01", "a2": "1e9"}.get(account, "60000")
        rows.append(request(account, k, draw.randrange(40), draw.choice([0, 10, 30, 200, 2000]), price, cash))
    check(spark, rows, rules)


def test_dear_and_cheap_requests_in_turn(spark):
    """Cheap ones are paid between dear ones that just miss the cash: the walk does not stop at each."""
    rules = om.Constraints(min_trade_value="0", round_lot_size=1)
    rows = []
    for k in range(60):
        rows.append(request("acc", 2 * k, 2 * k, 1, "1", "1000"))
        rows.append(request("acc", 2 * k + 1, 2 * k + 1, 1, f"{999 - k}", "1000"))
    check(spark, rows, rules)


def test_exactly_covered_and_empty(spark):
    rules = om.Constraints(min_trade_value="0", round_lot_size=1)
    rows = [request("acc", k, k, 10, "100", "2004") for k in range(4)]
    check(spark, rows, rules, block_rows=1)
    none = om._cash_before_purchases(spark.createDataFrame([], SCHEMA), rules, 0, 7)
    assert none.count() == 0


def test_accounts_with_few_purchases_are_walked_without_rounds(spark, monkeypatch):
    """Only an account with many purchases goes by running sums; the others are moved once."""
    rules = om.Constraints(min_trade_value="1000", round_lot_size=10)
    draw = random.Random(9)
    rows = []
    for k in range(400):
        account = "hot" if k % 4 == 0 else f"a{k % 29}"
        price = f"{draw.choice([0.05, 7.35, 99, 1203.123456]):.6f}"
        cash = {"hot": "250000.5", "a1": "0", "a2": "0.01"}.get(account, "30000")
        rows.append(request(account, k, draw.randrange(9), draw.choice([0, 10, 30, 2000]), price, cash))
    by_rounds = []
    stretches = om._cash_by_stretches
    monkeypatch.setattr(om, "_cash_by_stretches", lambda buys, *args: by_rounds.append(buys) or stretches(buys, *args))
    check(spark, rows, rules, block_rows=50)
    assert len(by_rounds) == 1 and {r["account_id"] for r in by_rounds[0].collect()} == {"hot"}
    check(spark, rows, rules, block_rows=100_000)
    assert len(by_rounds) == 1
    monkeypatch.setattr(om, "WALKED", 0)
    check(spark, rows, rules, block_rows=7)
    assert len(by_rounds) == 2


def test_blocks_of_a_large_group_are_bounded_and_numbers_whole(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 100)).alias("g"),
        F.hash("id").alias("v"), "id",
    )
    placed = in_blocks(rows, ["g"], ["v", "id"], 4000, 200).select("g", "block").collect()
    largest = max(Counter(r["block"] for r in placed).values())
    assert largest <= 1000 and len({r["block"] for r in placed if r["g"] == "hot"}) >= 3
    got = numbered(rows, ["g"], ["v", "id"], "n", 4000, 200).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append((r["v"], r["id"], r["n"]))
    assert all([n for *_, n in sorted(group)] == list(range(1, len(group) + 1)) for group in groups.values())
