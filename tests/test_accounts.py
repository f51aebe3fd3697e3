from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.helpers import days
from tidepanel.functions.dates import trading_calendar
from tidepanel.operators import ledger as le
from tidepanel.operators import orders as om
from tidepanel.schemas import LEDGERS
from tidepanel.sources import ledgers as sl

DAYS = days(30)


def _calendar(spark):
    return trading_calendar(spark, dt.date(2020, 1, 1), dt.date(2020, 6, 30))


def _orders(spark, rows):
    schema = "account_id string, order_id string, intended_execution_date date, ticker string, side string, requested_quantity bigint, status string"
    return spark.createDataFrame([(*r, "PENDING") for r in rows], schema)


def _prices(spark, rows):
    return spark.createDataFrame(rows, "ticker string, price string").select(
        "ticker", F.col("price").cast("decimal(18,6)").alias("execution_price")
    )


TRADES = [
    ("acc", "o1", DAYS[0], "AAA", "BUY", 100),
    ("acc", "o2", DAYS[1], "AAA", "BUY", 50),
    ("acc", "o3", DAYS[5], "AAA", "SELL", 60),
    ("acc", "o4", DAYS[6], "BBB", "BUY", 10),
    ("acc", "o5", DAYS[9], "AAA", "SELL", 90),
    ("acc", "o6", DAYS[12], "AAA", "BUY", 7),
]


def _trades(spark, rows=TRADES):
    executions = le.price_executions(_orders(spark, rows), _prices(spark, [("AAA", "10.5"), ("BBB", "20")]))
    return le.settlements(executions, _calendar(spark))


def test_execution_costs_are_exact(spark):
    rows = le.price_executions(_orders(spark, TRADES), _prices(spark, [("AAA", "10.5"), ("BBB", "20")])).orderBy("order_id").collect()
    assert rows[0]["gross_value"] == Decimal("1050") and rows[0]["commission"] == Decimal("1.05")
    assert rows[0]["tax"] == 0 and rows[0]["net_cash_effect"] == Decimal("-1052.1")
    assert rows[2]["tax"] == Decimal("0.63") and rows[2]["net_cash_effect"] == Decimal("628.11")


def test_unpriced_orders_are_reported(spark):
    problems = le.execution_problems(_orders(spark, [*TRADES[:1], TRADES[0], ("acc", "o9", DAYS[0], "ZZZ", "BUY", 5)]), _prices(spark, [("AAA", "10")]))
    assert sorted(r["problem"] for r in problems.collect()) == ["duplicate_order", "missing_price"]


def test_settlement_waits_two_trading_days(spark):
    got = {r["reference_id"]: r["settlement_date"] for r in _trades(spark).collect()}
    assert got["execution-o1"] == DAYS[2] and got["execution-o5"] == DAYS[11]


def test_shares_and_cash_roll_forward(spark):
    deposits = spark.createDataFrame([("acc", dt.date(2020, 1, 1), 10000)], "account_id string, event_date date, amount int")
    events = le.account_events(_trades(spark), DAYS[6], deposits)
    position = {r["ticker"]: r for r in le.share_positions(events).collect()}
    assert position["AAA"]["settled_shares"] == 150 and position["AAA"]["pending_sell_shares"] == 60
    assert position["AAA"]["sellable_quantity"] == 90 and position["BBB"]["unsettled_buy_shares"] == 10
    cash = le.balances(events).first()
    assert cash["unsettled_cash"] == Decimal("628.11")
    spent = Decimal("1052.1") + Decimal("526.05") + Decimal("200.4")
    assert cash["settled_cash"] == Decimal("10000") - spent
    ledger = le.cash_ledger(events).orderBy("event_date", "entry_id").collect()
    assert ledger[-1]["settled_cash_balance"] == cash["settled_cash"]
    status = le.with_settlement_status(_trades(spark).where(F.col("trade_date") <= F.lit(DAYS[6])), DAYS[6])
    assert le.reconcile(le.share_positions(events), le.balances(events), status, le.cash_ledger(events)).count() == 0
    broken = le.share_positions(events).withColumn("pending_sell_shares", F.lit(1).cast("bigint"))
    found = {r["violation"] for r in le.reconcile(broken, le.balances(events), status).collect()}
    assert found == {"pending_sell_mismatch"}


def _fold(trades):
    """Average cost after the last trade, one step at a time."""
    held, average = 0, 0.0
    for side, quantity, cost in trades:
        if side == "BUY":
            average = (average * held + cost) / (held + quantity)
            held += quantity
        else:
            held -= quantity
            average = 0.0 if held == 0 else average
    return average


@pytest.mark.parametrize("same_day", [False, True])
def test_average_cost_matches_a_fold(spark, same_day):
    import random

    random.seed(4)
    rows, folds = [], {}
    for name in ("AAA", "BBB", "CCC"):
        held, steps = 0, []
        for i in range(25):
            sell = held > 0 and random.random() < 0.5
            quantity = random.choice([held, max(1, held // 2)]) if sell else random.randint(1, 40)
            date = DAYS[i // 6 if same_day else i]
            price = Decimal(random.randint(100, 900)) / 10
            rows.append(("acc", name, date, f"r{i:03d}", "SELL" if sell else "BUY", quantity, price * quantity, Decimal(1)))
            steps.append(("SELL" if sell else "BUY", quantity, float(price * quantity) + 1))
            held += -quantity if sell else quantity
        folds[name] = _fold(steps)
    frame = spark.createDataFrame(
        rows,
        "account_id string, ticker string, trade_date date, reference_id string, side string, quantity bigint, "
        "gross_amount decimal(38,12), fees_and_taxes decimal(38,12)",
    )
    got = {r["ticker"]: r["average_cost"] for r in le.average_costs(frame).collect()}
    for name, want in folds.items():
        assert got[name] == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("days_used", [1, 25])
def test_average_cost_of_thousands_of_partial_sales(spark, days_used):
    """Each sale keeps half; a product of the remaining shares would soon be zero."""
    rows, steps = [], []
    for i in range(5000):
        side, quantity = ("BUY", 10) if i % 2 == 0 else ("SELL", 10 if i > 1 else 5)
        price = Decimal(100 + i % 37) / 10
        date = DAYS[i * days_used // 5000]
        rows.append(("acc", "AAA", date, f"r{i:05d}", side, quantity, price * quantity, Decimal(0)))
        steps.append((side, quantity, float(price * quantity)))
    schema = (
        "account_id string, ticker string, trade_date date, reference_id string, side string, quantity bigint, "
        "gross_amount decimal(38,12), fees_and_taxes decimal(38,12)"
    )
    got = le.average_costs(spark.createDataFrame(rows, schema)).first()["average_cost"]
    assert got == pytest.approx(_fold(steps), rel=1e-9)


def test_executions_that_cannot_settle_are_refused(spark):
    weekend, late = dt.date(2020, 1, 4), dt.date(2020, 6, 30)
    orders = _orders(spark, [("acc", "o1", DAYS[0], "AAA", "BUY", 5), ("acc", "o2", weekend, "AAA", "BUY", 5), ("acc", "o3", late, "AAA", "BUY", 5)])
    executions = le.price_executions(orders, _prices(spark, [("AAA", "10")]))
    found = le.settlement_problems(executions, _calendar(spark)).collect()
    assert {(r["execution_id"], r["problem"]) for r in found} == {
        ("execution-o2", "not_a_trading_day"), ("execution-o3", "calendar_ends_before_settlement"),
    }
    with pytest.raises(Exception, match="no settlement for an execution on 2020-0"):
        le.settlements(executions, _calendar(spark)).collect()
    dates = {r["reference_id"]: r["settlement_date"] for r in le.settlements(executions, _calendar(spark), refuse=False).collect()}
    assert dates["execution-o1"] is not None and dates["execution-o2"] is None and dates["execution-o3"] is None


def _money_in(spark, amount):
    return spark.createDataFrame([("acc", DAYS[0], amount)], "account_id string, event_date date, amount int")


def test_trades_the_books_do_not_cover_are_listed(spark):
    rows = [
        ("acc", "o1", DAYS[0], "AAA", "BUY", 100),
        ("acc", "o2", DAYS[1], "AAA", "SELL", 100),  # bought the day before, not settled yet
        ("acc", "o3", DAYS[1], "BBB", "BUY", 10),  # paid with proceeds that have not come in
        ("acc", "o4", DAYS[9], "BBB", "SELL", 10),
    ]
    events = le.account_events(_trades(spark, rows), DAYS[20], _money_in(spark, 1060))
    found = {(r["entry_id"], r["violation"]) for r in le.trade_violations(events).collect()}
    assert found == {("cash-execution-o2-execution", "oversold"), ("cash-execution-o3-execution", "overspent")}
    assert le.trade_violations(le.account_events(_trades(spark), DAYS[20], _money_in(spark, 10_000))).count() == 0


def test_a_replay_finds_a_changed_balance(spark):
    ledger = le.cash_ledger(le.account_events(_trades(spark), DAYS[20], _money_in(spark, 10_000)))
    assert le.balance_problems(ledger).count() == 0
    for side in ("settled_cash", "unsettled_cash"):
        wrong = F.when(F.col("entry_id") == "cash-execution-o3-execution", F.col(f"{side}_balance") + 1).otherwise(F.col(f"{side}_balance"))
        changed = ledger.withColumn(f"{side}_balance", wrong.cast("decimal(38,12)"))
        assert [tuple(r) for r in le.balance_problems(changed).collect()] == [("acc", "cash-execution-o3-execution", f"{side}_balance")]


def test_recording_a_batch_twice_does_nothing(spark):
    orders = _orders(spark, TRADES)
    executions = le.price_executions(orders, _prices(spark, [("AAA", "10.5"), ("BBB", "20")]))
    empty = executions.limit(0)
    assert le.batch_status(executions, empty, orders).first()["decision"] == "record"
    assert le.batch_status(executions, executions, orders).first()["decision"] == "no_op"
    assert le.batch_status(executions, executions.limit(1), orders).first()["decision"] == "reject_overlap"
    assert le.batch_status(executions, empty, orders.limit(2)).first()["decision"] == "reject_missing_order"
    done = le.mark_executed(orders, executions)
    assert le.batch_status(executions, empty, done).first()["decision"] == "reject_not_pending"


def test_ledger_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "orders")
    sl.create_ledger(spark, "orders", path)
    row = ("acc", "o1", "s1", DAYS[0], DAYS[1], "AAA", "BUY", 100, Decimal("10"), Decimal("1000"), "PENDING", "", dt.datetime(2020, 1, 1))
    batch = spark.createDataFrame([row], LEDGERS["orders"])
    assert sl.append_rows("orders", batch, path) is True
    assert sl.append_rows("orders", batch, path) is False
    more = spark.createDataFrame([row, (*row[:1], "o2", *row[2:])], LEDGERS["orders"])
    with pytest.raises(ValueError, match="already exist"):
        sl.append_rows("orders", more, path)
    with pytest.raises(ValueError, match="duplicate_identifier"):
        sl.append_rows("orders", batch.unionByName(batch), path)
    assert sl.read_ledger(spark, "orders", path).count() == 1


def test_ledger_csv_needs_the_exact_header(spark, tmp_path):
    header = ",".join(LEDGERS["skipped_trades"].fieldNames())
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text(f"{header}\nacc,k1,o1,2020-01-02,AAA,BUY,100,1000.25,,text,\n")
    bad.write_text(header.replace("account_id,skip_id", "skip_id,account_id") + "\n")
    row = sl.read_ledger_csv(spark, "skipped_trades", str(good)).first()
    assert row["requested_value"] == Decimal("1000.25") and row["reason_code"] is None
    with pytest.raises(ValueError, match="expected"):
        sl.read_ledger_csv(spark, "skipped_trades", str(bad))


def test_daily_performance_by_hand(spark):
    rows = [("acc", d, v) for d, v in zip(DAYS[:4], ("100", "110", "99", "121"))]
    values = spark.createDataFrame(rows, "account_id string, date date, portfolio_value string").select(
        "account_id", "date", F.col("portfolio_value").cast("decimal(38,12)").alias("portfolio_value"),
        F.lit(10).cast("decimal(38,12)").alias("settled_cash"), F.lit(0).cast("decimal(38,12)").alias("unsettled_cash"),
    )
    bench = spark.createDataFrame([(d, 0.01) for d in DAYS[:4]], "date date, benchmark_return double")
    got = le.daily_performance(values, bench).orderBy("date").collect()
    assert got[0]["daily_return"] == 0 and got[0]["cumulative_benchmark_return"] == 0 and got[0]["benchmark_value"] == 100
    assert got[2]["drawdown"] == pytest.approx(-0.1) and got[3]["cumulative_return"] == pytest.approx(0.21)
    assert got[3]["benchmark_value"] == pytest.approx(100 * 1.01**3)
    assert got[1]["active_return"] == pytest.approx(0.09) and got[0]["cash_weight"] == pytest.approx(0.1)


# --- order sizing -----------------------------------------------------------------------

RULES = om.Constraints(min_trade_value="1000", round_lot_size=10)


def _sizing(spark, targets, positions=(), snapshots=(), cash="100000", rules=RULES):
    target_rows = spark.createDataFrame(
        [("acc", t, g, s, Decimal(w), i + 1) for i, (t, g, s, w) in enumerate(targets)],
        "account_id string, ticker string, issuer_group string, sector string, target_weight decimal(18,12), predicted_rank int",
    )
    held = spark.createDataFrame(
        [("acc", t, q, sellable) for t, q, sellable in positions],
        "account_id string, ticker string, economic_quantity bigint, sellable_quantity bigint",
    )
    snaps = spark.createDataFrame(
        [(t, d, Decimal(p) if p else None, Decimal(a) if a else None, pred, c, f) for t, d, p, a, pred, c, f in snapshots],
        "ticker string, data_date date, price decimal(18,6), average_daily_value decimal(24,6), prediction_available boolean, at_ceiling boolean, at_floor boolean",
    )
    balance = spark.createDataFrame([("acc", Decimal(cash), Decimal(0))], "account_id string, settled_cash decimal(38,12), unsettled_cash decimal(38,12)")
    marks = snaps.select("ticker", F.col("price").alias("mark_price"))
    values = le.portfolio_value(held, balance, marks)
    return om.order_plan(target_rows, held, balance, values, snaps, rules, DAYS[0], DAYS[1], DAYS[0]).orderBy("order_id").collect()


def _snapshot(ticker, price="10", adv="10000000", date=None, prediction=True, ceiling=False, floor=False):
    return (ticker, date or DAYS[0], price, adv, prediction, ceiling, floor)


def _pending(rows):
    return {r["ticker"]: (r["side"], r["requested_quantity"]) for r in rows if r["status"] == "PENDING"}


def _reasons(rows):
    return sorted((r["ticker"], r["reason_code"]) for r in rows if r["status"] == "SKIPPED")


def test_buy_is_limited_by_turnover_and_lots(spark):
    rows = _sizing(spark, [("AAA", "g", "s", "0.15")], snapshots=[_snapshot("AAA", "7")])
    # 15000 / 7 = 2142 shares, 2140 in lots of ten.
    assert _pending(rows) == {"AAA": ("BUY", 2140)}
    assert _reasons(rows) == [("AAA", "BELOW_MIN_TRADE_VALUE")]


def test_caps_report_rejected_weight(spark):
    targets = [("AAA", "g", "s1", "0.30"), ("BBB", "g", "s2", "0.15"), ("CCC", "h", "s2", "0.15")]
    rows = _sizing(spark, targets, snapshots=[_snapshot(t) for t in ("AAA", "BBB", "CCC")])
    reasons = _reasons(rows)
    assert ("AAA", "MAX_SINGLE_NAME_WEIGHT_REACHED") in reasons
    assert ("AAA", "MAX_ISSUER_GROUP_WEIGHT_REACHED") in reasons and ("BBB", "MAX_ISSUER_GROUP_WEIGHT_REACHED") in reasons
    assert not any(reason == "MAX_SECTOR_WEIGHT_REACHED" for _, reason in reasons)


@pytest.mark.parametrize(
    ("snapshot", "reason"),
    [
        (_snapshot("AAA", date=DAYS[5]), "STALE_DATA"),
        (_snapshot("AAA", prediction=False), "MISSING_PREDICTION"),
        (_snapshot("AAA", price=None), "MISSING_PRICE"),
        (_snapshot("AAA", ceiling=True), "PRICE_CEILING_BUY_BLOCK"),
        (_snapshot("AAA", adv=None), "ADV_CAPACITY_LIMIT"),
    ],
)
def test_blocked_buys(spark, snapshot, reason):
    rows = _sizing(spark, [("AAA", "g", "s", "0.1")], snapshots=[snapshot])
    assert _pending(rows) == {} and ("AAA", reason) in _reasons(rows)


def test_floor_blocks_sales_and_holds_stay(spark):
    rows = _sizing(
        spark, [("BBB", "g", "s", "0")], positions=[("AAA", 500, 500), ("BBB", 0, 0)],
        snapshots=[_snapshot("AAA", floor=True), _snapshot("BBB")],
    )
    assert ("AAA", "PRICE_FLOOR_SELL_BLOCK") in _reasons(rows)
    assert [r["side"] for r in rows if r["ticker"] == "BBB"] == ["HOLD"]


def test_unsettled_shares_cannot_be_sold(spark):
    rows = _sizing(spark, [], positions=[("AAA", 500, 195)], snapshots=[_snapshot("AAA")])
    assert _pending(rows) == {"AAA": ("SELL", 190)}
    assert ("AAA", "INSUFFICIENT_SELLABLE_QUANTITY") in _reasons(rows)


def test_cash_goes_to_the_best_ranks_first(spark):
    targets = [("AAA", "g", "s1", "0.1"), ("BBB", "h", "s2", "0.1")]
    rows = _sizing(spark, targets, positions=[("ZZZ", 9000, 0)], snapshots=[_snapshot(t) for t in ("AAA", "BBB", "ZZZ")], cash="12000")
    pending = _pending(rows)
    assert pending["AAA"][1] > pending.get("BBB", ("", 0))[1]
    spent = sum(q * 10 * Decimal("1.002") for side, q in pending.values() if side == "BUY")
    assert spent <= Decimal("12000") - Decimal("0.03") * Decimal("102000")
    assert ("BBB", "INSUFFICIENT_SETTLED_CASH") in _reasons(rows)


def test_volume_limit_defers_the_rest(spark):
    rows = _sizing(spark, [("AAA", "g", "s", "0.1")], snapshots=[_snapshot("AAA", adv="40000")])
    assert _pending(rows) == {"AAA": ("BUY", 200)} and ("AAA", "ADV_CAPACITY_LIMIT") in _reasons(rows)


def test_order_ids_count_up_per_account(spark):
    rows = _sizing(spark, [("AAA", "g", "s", "0.1"), ("BBB", "h", "t", "0.1")], snapshots=[_snapshot("AAA"), _snapshot("BBB")])
    assert [r["order_id"] for r in rows] == ["order-20200101-001-AAA-buy", "order-20200101-002-BBB-buy"]
    assert om.overinvested_accounts(
        spark.createDataFrame([("acc", Decimal("0.98"))], "account_id string, target_weight decimal(18,12)"), RULES
    ).count() == 1


def test_scalar_order_rules(spark):
    frame = spark.createDataFrame([(Decimal("1000"), Decimal("9.99"))], "cash decimal(38,12), price decimal(18,6)")
    row = frame.select(
        om.affordable_quantity(F.col("cash"), F.col("price"), RULES).alias("fits"),
        om.cash_effect(F.lit("SELL"), F.col("cash"), RULES).alias("sale"),
        om.desired_quantity(F.lit(100), F.lit(Decimal("555")), F.lit(Decimal("10"))).alias("down"),
        om.desired_quantity(F.lit(10), F.lit(Decimal("555")), F.lit(Decimal("10"))).alias("up"),
    ).first()
    assert row["fits"] == 90 and row["sale"] == Decimal("997") and row["down"] == 56 and row["up"] == 55


@pytest.mark.parametrize("price", [None, "0"])
def test_plans_refuse_held_names_without_a_price_and_dates_out_of_order(spark, price):
    targets = [("AAA", "G", "S", "0.1")]
    with pytest.raises(ValueError, match="no price"):
        _sizing(spark, targets, [("BBB", 10, 10)], [_snapshot("AAA"), _snapshot("BBB", price=price)])
    with pytest.raises(ValueError, match="no price"):
        _sizing(spark, targets, [("CCC", 10, 10)], [_snapshot("AAA")])
    with pytest.raises(ValueError, match="does not follow"):
        om.order_plan(None, None, None, None, None, RULES, DAYS[1], DAYS[1], DAYS[0])
