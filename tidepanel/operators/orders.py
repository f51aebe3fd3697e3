"""Order sizing for many accounts at once.

Caps, turnover, quantities and trade blocks are columns over (account, ticker).  The spending of
cash, where each purchase leaves less for the next, goes by running sums over blocks of an account's
purchases, in a few rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.numeric import truthy
from tidepanel.functions.ranking import BLOCK_ROWS, in_blocks, numbered
from tidepanel.operators.ledger import decimal_ratio, money, times_quantity
from tidepanel.session import checkpoint, stored

WEIGHT = "decimal(18,12)"
# Purchases of an account that one call walks; an account with more goes by running sums.
WALKED = 200
# Entries a plan row can give: every early one and every one of a request.
ENTRIES = 14


@dataclass(frozen=True)
class Constraints:
    """Limits of the account."""

    cash_buffer_weight: str = "0.03"
    max_single_name_weight: str = "0.15"
    max_issuer_group_weight: str = "0.25"
    max_sector_weight: str = "0.35"
    max_daily_turnover: str = "0.25"
    round_lot_size: int = 100
    allow_odd_lots: bool = False
    min_trade_value: str = "500000"
    max_trade_adv_fraction: str = "0.05"
    commission_rate: str = "0.001"
    slippage_rate: str = "0.001"
    sell_tax_rate: str = "0.001"
    block_buy_at_ceiling: bool = True
    block_sell_at_floor: bool = True


def _weight(text: str) -> Column:
    return F.lit(text).cast(WEIGHT)


def round_lot(quantity: Column, rules: Constraints) -> Column:
    """Whole lots; nothing below one lot unless odd lots are allowed."""
    positive = F.greatest(quantity, F.lit(0)).cast("bigint")
    if rules.allow_odd_lots:
        return positive
    return (positive - positive % rules.round_lot_size).cast("bigint")


def whole_quantity(value: Column, price: Column) -> Column:
    """Largest whole quantity the value pays for."""
    return F.floor(F.try_divide(value.cast("decimal(28,6)"), price.cast("decimal(18,6)"))).cast("bigint")


def cash_effect(side: Column, gross: Column, rules: Constraints) -> Column:
    """Estimated cash change: cost of a buy including fees, proceeds of a sale after fees and tax."""
    fees = F.lit(rules.commission_rate).cast("decimal(9,6)") + F.lit(rules.slippage_rate).cast("decimal(9,6)")
    one = F.lit(1).cast("decimal(9,6)")
    amount = gross.cast("decimal(26,6)")
    return (
        F.when(side == "BUY", money(-amount * (one + fees).cast("decimal(9,6)")))
        .when(side == "SELL", money(amount * (one - fees - F.lit(rules.sell_tax_rate).cast("decimal(9,6)")).cast("decimal(9,6)")))
        .otherwise(money(F.lit(0)))
    )


def affordable_quantity(cash: Column, price: Column, rules: Constraints) -> Column:
    """Lots that cash pays for, fees included."""
    unit = -cash_effect(F.lit("BUY"), price, rules)
    whole = F.floor(cash.cast("decimal(32,12)"), F.lit(6)).cast("decimal(26,6)")
    raw = F.floor(F.try_divide(whole, unit.cast("decimal(24,9)"))).cast("bigint")
    return F.when((cash > 0) & (price > 0), round_lot(raw, rules)).otherwise(F.lit(0).cast("bigint"))


def adv_quantity_limit(average_value: Column, price: Column, rules: Constraints) -> Column:
    """Lots within the allowed part of the average daily value."""
    allowed = average_value.cast("decimal(26,6)") * F.lit(rules.max_trade_adv_fraction).cast("decimal(9,6)")
    return F.when((average_value > 0) & (price > 0), round_lot(whole_quantity(allowed, price), rules)).otherwise(
        F.lit(0).cast("bigint")
    )


def block_reason(side: Column, expected_date: object, rules: Constraints) -> Column:
    """First rule that forbids trading a row with snapshot columns."""
    reason = (
        F.when(~F.col("data_date").eqNullSafe(F.lit(expected_date).cast("date")), "STALE_DATA")
        .when(~F.coalesce(F.col("prediction_available"), F.lit(True)), "MISSING_PREDICTION")
        .when(~truthy(F.col("price") > 0), "MISSING_PRICE")
    )
    if rules.block_buy_at_ceiling:
        reason = reason.when((side == "BUY") & truthy(F.col("at_ceiling")), "PRICE_CEILING_BUY_BLOCK")
    if rules.block_sell_at_floor:
        reason = reason.when((side == "SELL") & truthy(F.col("at_floor")), "PRICE_FLOOR_SELL_BLOCK")
    return reason


def desired_quantity(current: Column, target_value: Column, price: Column) -> Column:
    """Whole shares for a target value: rounded down when buying, up when selling."""
    exact = F.try_divide(target_value.cast("decimal(28,6)"), price.cast("decimal(18,6)"))
    return F.when(exact >= current, F.floor(exact)).otherwise(F.ceil(exact)).cast("bigint")


def capped_targets(targets: DataFrame, rules: Constraints) -> DataFrame:
    """Apply the name, issuer-group and sector caps; keep the weight each one rejects.

    Targets hold (account_id, ticker, issuer_group, sector, target_weight, ...).  Scaled
    weights are cut, not rounded, at twelve decimals, so a group never exceeds its cap.
    """

    def cut(value: Column) -> Column:
        return F.floor(value.cast("decimal(32,18)"), F.lit(12)).cast(WEIGHT)

    def scaled(frame: DataFrame, group: str, cap: str, rejected: str) -> DataFrame:
        totals = frame.groupBy("account_id", group).agg(F.sum("weight").alias("__total"))
        limit = _weight(cap)
        scale = limit.cast("decimal(19,18)") / F.col("__total").cast("decimal(19,12)")
        fitted = F.when(F.col("__total") > limit, cut(F.col("weight").cast("decimal(15,12)") * scale.cast("decimal(19,18)")))
        return (
            frame.join(totals, ["account_id", group])
            .withColumn("__fitted", F.coalesce(fitted, F.col("weight")))
            .withColumn(rejected, F.col("weight") - F.col("__fitted"))
            .withColumn("weight", F.col("__fitted").cast(WEIGHT))
            .drop("__total", "__fitted")
        )

    prepared = targets.withColumns(
        {
            "issuer_group": F.coalesce(F.nullif(F.trim("issuer_group"), F.lit("")), F.col("ticker")),
            "target_weight": F.col("target_weight").cast(WEIGHT),
        }
    ).withColumn("sector", F.coalesce(F.nullif(F.trim("sector"), F.lit("")), F.col("issuer_group")))
    name_cap = _weight(rules.max_single_name_weight)
    named = prepared.withColumn("weight", F.least("target_weight", name_cap).cast(WEIGHT)).withColumn(
        "rejected_name", F.col("target_weight") - F.col("weight")
    )
    grouped = scaled(named, "issuer_group", rules.max_issuer_group_weight, "rejected_group")
    return scaled(grouped, "sector", rules.max_sector_weight, "rejected_sector").withColumnRenamed(
        "weight", "constrained_weight"
    )


def overinvested_accounts(targets: DataFrame, rules: Constraints) -> DataFrame:
    """Accounts whose raw targets exceed one minus the cash buffer."""
    limit = 1 - Decimal(rules.cash_buffer_weight)
    return (
        targets.groupBy("account_id")
        .agg(F.sum(F.col("target_weight").cast(WEIGHT)).alias("target_total"))
        .where(F.col("target_total") > F.lit(limit + Decimal("1e-12")))
    )


def planned_trades(
    targets: DataFrame,
    positions: DataFrame,
    values: DataFrame,
    snapshots: DataFrame,
    rules: Constraints,
    expected_date: object,
) -> DataFrame:
    """Per account and name: weights, desired quantity, lots, block reason and request.

    ``positions`` comes from ``ledger.share_positions``, ``values`` from
    ``ledger.portfolio_value``, ``snapshots`` holds data_date, price,
    average_daily_value, prediction_available, at_ceiling and at_floor per ticker.
    """
    none = F.lit(0).cast("bigint")
    zero = F.lit(0).cast(WEIGHT)
    capped = capped_targets(targets, rules)
    held = positions.select("account_id", "ticker", "economic_quantity", "sellable_quantity")
    value = F.col("portfolio_value")
    rows = (
        capped.join(held, ["account_id", "ticker"], "full_outer")
        .join(values.select("account_id", "portfolio_value"), "account_id")
        .join(snapshots, "ticker", "left")
        .withColumns(
            {
                "current_quantity": F.coalesce("economic_quantity", none),
                "sellable_quantity": F.coalesce("sellable_quantity", none),
                "constrained_weight": F.coalesce("constrained_weight", zero),
                **{f"rejected_{k}": F.coalesce(f"rejected_{k}", zero) for k in ("name", "group", "sector")},
                "has_price": truthy(F.col("price") > 0),
            }
        )
        .withColumn(
            "current_weight",
            F.coalesce(
                decimal_ratio(times_quantity("price", "current_quantity"), value).cast(WEIGHT), zero
            ),
        )
    )
    gap = F.col("constrained_weight") - F.col("current_weight")
    turnover = rows.groupBy("account_id").agg((F.sum(F.abs(gap)) / 2).cast(WEIGHT).alias("needed_turnover"))
    limit = _weight(rules.max_daily_turnover)
    limited = F.col("needed_turnover") > limit
    part = (limit / F.col("needed_turnover")).cast("decimal(15,12)")
    planned = F.when(
        limited, F.col("current_weight") + (part * gap.cast("decimal(15,12)")).cast(WEIGHT)
    ).otherwise(F.col("constrained_weight"))
    price = F.col("price")
    wanted_value = F.col("planned_weight").cast("decimal(15,12)") * value.cast("decimal(22,6)")
    difference = F.col("desired_quantity") - F.col("current_quantity")
    side = F.when(F.col("difference") > 0, "BUY").when(F.col("difference") < 0, "SELL").otherwise("HOLD")

    def shares(weight: Column) -> Column:
        amount = weight.cast("decimal(15,12)") * value.cast("decimal(22,6)")
        return F.when(F.col("has_price"), whole_quantity(amount, price)).otherwise(none)

    return (
        rows.join(turnover, "account_id")
        .withColumn("turnover_limited", limited)
        .withColumn("planned_weight", F.greatest(planned.cast(WEIGHT), zero))
        .withColumn(
            "desired_quantity",
            F.when(F.col("has_price"), desired_quantity(F.col("current_quantity"), wanted_value, price)),
        )
        .withColumn("difference", difference)
        .withColumn("side", side)
        .withColumn("unrounded_quantity", F.abs("difference"))
        .withColumn("lot_quantity", round_lot(F.col("unrounded_quantity"), rules))
        .withColumn("lot_value", times_quantity("price", "lot_quantity"))
        .withColumn("block_reason", block_reason(F.col("side"), expected_date, rules))
        .withColumns(
            {
                **{f"skip_{k}": shares(F.col(f"rejected_{k}")) for k in ("name", "group", "sector")},
                "skip_turnover": F.when(
                    F.col("turnover_limited"),
                    shares(F.abs(F.col("constrained_weight") - F.col("planned_weight"))),
                ).otherwise(none),
            }
        )
        .withColumn(
            "is_request",
            F.col("has_price")
            & (F.col("side") != "HOLD")
            & (F.col("lot_quantity") > 0)
            & F.col("block_reason").isNull()
            & (F.col("lot_value") >= F.lit(rules.min_trade_value).cast("decimal(20,2)")),
        )
    )


def early_rows(plan: DataFrame, rules: Constraints) -> DataFrame:
    """Hold and skip rows decided before any cash is spent, in the order they arise."""
    smallest = F.lit(rules.min_trade_value).cast("decimal(20,2)")
    side = F.col("side")
    traded = F.col("has_price") & (side != "HOLD")
    lots = traded & (F.col("lot_quantity") > 0)
    blocked = F.col("block_reason").isNotNull()
    want_more = F.when(F.col("constrained_weight") > F.col("current_weight"), "BUY").otherwise("SELL")

    def entry(step: int, test: Column, action: Column, quantity: Column, reason: Column) -> Column:
        return F.when(
            test,
            F.struct(
                F.lit(step).alias("step"),
                action.alias("requested_side"),
                quantity.cast("bigint").alias("quantity"),
                reason.alias("reason_code"),
            ),
        )

    none = F.lit(0).cast("bigint")
    buy = F.lit("BUY")
    entries = F.array(
        entry(1, ~F.col("has_price"), F.lit("SKIP"), none, F.lit("MISSING_PRICE")),
        entry(2, F.col("skip_name") > 0, buy, F.col("skip_name"), F.lit("MAX_SINGLE_NAME_WEIGHT_REACHED")),
        entry(3, F.col("skip_group") > 0, buy, F.col("skip_group"), F.lit("MAX_ISSUER_GROUP_WEIGHT_REACHED")),
        entry(4, F.col("skip_sector") > 0, buy, F.col("skip_sector"), F.lit("MAX_SECTOR_WEIGHT_REACHED")),
        entry(5, F.col("skip_turnover") > 0, want_more, F.col("skip_turnover"), F.lit("MAX_TURNOVER_REACHED")),
        entry(6, F.col("has_price") & (side == "HOLD"), F.lit("HOLD"), none, F.lit("")),
        entry(
            7, traded & (F.col("lot_quantity") < F.col("unrounded_quantity")), side,
            F.col("unrounded_quantity") - F.col("lot_quantity"), F.lit("BELOW_MIN_TRADE_VALUE"),
        ),
        entry(8, lots & blocked, side, F.col("lot_quantity"), F.col("block_reason")),
        entry(
            9, lots & ~blocked & (F.col("lot_value") < smallest), side, F.col("lot_quantity"),
            F.lit("BELOW_MIN_TRADE_VALUE"),
        ),
    )
    return plan.withColumn("__entry", F.explode(F.filter(entries, lambda e: e.isNotNull()))).select(
        "account_id",
        "ticker",
        F.coalesce("price", F.lit(0)).cast("decimal(18,6)").alias("price"),
        "__entry.*",
    )


def purchase(cash: Column, allowed: Column, price: Column, rules: Constraints) -> Column:
    """What a request takes out of this cash: its affordable lots, or nothing below the smallest trade."""
    quantity = F.least(allowed, affordable_quantity(cash, price, rules))
    worth = times_quantity(price, quantity)
    smallest = F.lit(rules.min_trade_value).cast("decimal(20,2)")
    cost = money(-cash_effect(F.lit("BUY"), worth, rules))
    return F.when((quantity > 0) & (worth >= smallest), cost).otherwise(money(F.lit(0)))


def _least_purchase(price: Column, rules: Constraints) -> Column:
    """Cost of the fewest lots that make a trade, fees included; only steers the number of rounds."""
    lot = F.lit(1 if rules.allow_odd_lots else rules.round_lot_size)
    lots = F.greatest(F.ceil(F.lit(float(rules.min_trade_value)) / (price.cast("double") * lot)), F.lit(1))
    fees = 1 + float(rules.commission_rate) + float(rules.slippage_rate)
    return lots * lot * price.cast("double") * F.lit(fees)


def _with_cash(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Cash before each purchase of a stretch, as far as no purchase of it ends the stretch.

    ``states`` has, per account, block and step, the cash a stretch begins with.  A request whose least
    purchase is below the level (the power of two under that cash) is taken in full, any other not at all.
    """
    cheap = F.coalesce(F.col("least_cost") < F.col("level"), F.lit(False))
    stretch = ["account_id", "step"]
    taken = rows.join(states, ["account_id", "block"]).withColumn("cheap", cheap)
    taken = taken.where(
        (F.struct("block", "place") > F.col("after"))
        & (F.col("until").isNull() | (F.struct("block", "place") <= F.col("until")))
    ).withColumn("taken", F.when(F.col("cheap"), F.col("full_cost")).otherwise(money(F.lit(0))))
    earlier = Window.partitionBy(*stretch).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    nothing = money(F.lit(0))
    blocks = (
        taken.groupBy(*stretch, "block")
        .agg(money(F.sum("taken")).alias("block_taken"))
        .withColumn("earlier_blocks", F.coalesce(money(F.sum("block_taken").over(earlier)), nothing))
        .drop("block_taken")
    )
    inside = Window.partitionBy(*stretch, "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return taken.join(blocks, [*stretch, "block"]).withColumn(
        "cash_before",
        money(F.col("cash") - F.col("earlier_blocks") - F.coalesce(money(F.sum("taken").over(inside)), nothing)),
    )


def _cash_before_purchases(buys: DataFrame, rules: Constraints, expected_rows: int, block_rows: int) -> DataFrame:
    """Cash available to each purchase once the better-ranked ones are paid.

    The purchases of an account with few of them are walked where they lie.  Only an account with more than
    ``block_rows`` or ``WALKED`` goes by running sums, whose rounds each move its rows.
    """
    most = min(block_rows, WALKED)
    costs = buys.select(
        "account_id", "ticker", "allowed", "price", "predicted_rank", "spendable", (-F.col("lot_value")).alias("order_value")
    )
    # Where all accounts are small, which is seen at once, nothing is told apart.
    large = checkpoint(costs.groupBy("account_id").count().where(F.col("count") > most).select("account_id"))
    if large.isEmpty():
        return _walked(costs, rules)
    # At most one in ``most`` rows.
    few = costs.join(F.broadcast(large), "account_id", "left_anti")
    many = costs.join(F.broadcast(large), "account_id", "left_semi")
    return _walked(few, rules).unionByName(_cash_by_stretches(many, rules, expected_rows, block_rows))


def _walked(costs: DataFrame, rules: Constraints) -> DataFrame:
    """Cash before each purchase, one after the other, of accounts with few purchases."""
    turn = F.struct("predicted_rank", "order_value", "ticker", "allowed", "price")
    listed = costs.groupBy("account_id").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), money(F.max("spendable")).alias("cash")
    )
    none = F.expr("CAST(array() AS array<decimal(38,12)>)")

    def spent(done: Column, turn: Column) -> Column:
        cash = done["cash"]
        left = money(cash - purchase(cash, turn["allowed"], turn["price"], rules))
        return F.struct(left.alias("cash"), F.concat(done["before"], F.array(cash)).alias("before"))

    walk = F.aggregate("turns", F.struct("cash", none.alias("before")), spent, lambda done: done["before"])
    paired = F.arrays_zip(F.transform("turns", lambda turn: turn["ticker"]).alias("ticker"), walk.alias("cash_before"))
    return listed.select("account_id", F.inline(paired).alias("ticker", "cash_before"))


def _cash_by_stretches(buys: DataFrame, rules: Constraints, expected_rows: int, block_rows: int) -> DataFrame:
    """Cash before each purchase of accounts with any number of them.

    An account's purchases are not walked one by one.  Let the level be the power of two at or below the
    cash.  Requests that can do with less than the level are paid in full by a running sum; all others are
    passed over, as long as none of three things happens: a cheap request is not covered in full, the cash
    falls below the level, or a dear request can be served.  The first such request ends the stretch, is
    paid exactly, and the next stretch begins behind it.  Each of the three at least brings the cash below
    the level: a request served in part leaves less than one lot of those it paid for.  So there are about as
    many rounds as the cash has binary digits above the cheapest purchase, whatever the number of requests.

    The requests of an account lie in blocks of ``block_rows``; sums over blocks carry the cash from one to the next.
    """
    order = ["predicted_rank", "order_value", "ticker"]
    placed = in_blocks(buys, ["account_id"], order, expected_rows, block_rows)
    worth = times_quantity("price", "allowed")
    trades = (F.col("allowed") > 0) & (worth >= F.lit(rules.min_trade_value).cast("decimal(20,2)"))
    rows = stored(
        placed.withColumn("full_cost", F.when(trades, money(-cash_effect(F.lit("BUY"), worth, rules))).otherwise(money(F.lit(0))))
        .withColumn("least_cost", F.when(trades, _least_purchase(F.col("price"), rules)))
    )
    blocks = checkpoint(rows.groupBy("account_id", "block").agg(F.max("spendable").alias("spendable")))
    level = F.pow(F.lit(2.0), F.floor(F.log2(F.col("cash").cast("double"))))
    place = "struct<block:int,place:int>"
    start = F.struct(F.lit(-1).alias("block"), F.lit(0).alias("place")).cast(place)
    state = blocks.groupBy("account_id").agg(money(F.max("spendable")).alias("cash")).withColumn("after", start)
    log = []
    while True:
        state = checkpoint(state.withColumn("step", F.lit(len(log))).withColumn("level", level))
        if log and state.isEmpty():
            break
        log.append(state)
        here = blocks.select("account_id", "block").join(state, "account_id").where("block >= after.block")
        walked = _with_cash(rows, here.withColumn("until", F.lit(None).cast(place)))
        cash = F.col("cash_before")
        paid = purchase(cash, F.col("allowed"), F.col("price"), rules)
        left = cash - F.col("full_cost")
        short = (affordable_quantity(cash, F.col("price"), rules) < F.col("allowed")) | (left.cast("double") < F.col("level"))
        event = F.when(F.col("cheap"), short).otherwise(paid > 0)
        state = (
            walked.where(event)
            .groupBy("account_id")
            .agg(F.min(F.struct("block", "place", money(cash - paid).alias("cash"))).alias("first"))
            .select("account_id", "first.cash", F.struct("first.block", "first.place").cast(place).alias("after"))
        )
    stretches = log[0]
    for later in log[1:]:
        stretches = stretches.unionByName(later)
    # One row per account and round.
    following = Window.partitionBy("account_id").orderBy("step")
    stretches = stretches.withColumn("until", F.lead("after").over(following))
    spread = blocks.select("account_id", "block").join(stretches, "account_id")
    spread = spread.where("block >= after.block AND (until IS NULL OR block <= until.block)")
    return _with_cash(rows, spread).select("account_id", "ticker", "cash_before")


def funded_requests(
    plan: DataFrame, cash: DataFrame, rules: Constraints, expected_rows: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Orders and skips of the requests: volume limit, sellable shares, settled cash.

    Sales come first by value, purchases by predicted rank; every purchase reduces the
    cash left for the next one.  ``phase``, ``priority`` and ``order_value`` state that order.
    ``expected_rows`` is about the number of requests.
    """
    smallest = F.lit(rules.min_trade_value).cast("decimal(20,2)")
    none = F.lit(0).cast("bigint")
    buffer = F.col("portfolio_value").cast("decimal(26,6)") * F.lit(rules.cash_buffer_weight).cast("decimal(9,6)")
    limit = adv_quantity_limit(F.col("average_daily_value"), F.col("price"), rules)
    requests = (
        plan.where("is_request")
        .join(cash.select("account_id", "settled_cash"), "account_id")
        .withColumns(
            {
                "predicted_rank": F.coalesce("predicted_rank", F.lit(10**9)).cast("bigint"),
                "allowed": F.when(
                    F.col("average_daily_value").isNotNull(), F.least(F.col("lot_quantity"), limit)
                ),
                "spendable": F.greatest(money("settled_cash") - money(buffer), money(F.lit(0))),
            }
        )
    )
    buying = F.col("side") == "BUY"
    payable = requests.where(buying & F.col("allowed").isNotNull())
    funds = _cash_before_purchases(payable, rules, expected_rows, block_rows)
    affordable = affordable_quantity(F.col("cash_before"), F.col("price"), rules)
    sized = (
        requests.join(funds, ["account_id", "ticker"], "left")
        .withColumn("available", F.when(buying, affordable).otherwise(F.col("sellable_quantity")))
        .withColumn("short", F.greatest(F.col("allowed") - F.col("available"), none))
        .withColumn(
            "quantity",
            F.when(F.col("short") > 0, round_lot(F.col("available"), rules)).otherwise(F.col("allowed")),
        )
        .withColumn("worth", times_quantity("price", "quantity"))
    )
    known = F.col("allowed").isNotNull()
    capped = known & (F.col("allowed") < F.col("lot_quantity"))
    traded = known & (F.col("quantity") > 0)

    def entry(step: int, test: Column, quantity: Column, status: str, reason: Column) -> Column:
        return F.when(
            test,
            F.struct(
                F.lit(step).alias("step"),
                quantity.cast("bigint").alias("quantity"),
                F.lit(status).alias("status"),
                reason.alias("reason_code"),
            ),
        )

    volume = F.lit("ADV_CAPACITY_LIMIT")
    shortage = F.when(buying, "INSUFFICIENT_SETTLED_CASH").otherwise("INSUFFICIENT_SELLABLE_QUANTITY")
    entries = F.array(
        entry(1, ~known, F.col("lot_quantity"), "SKIPPED", volume),
        entry(2, capped, F.col("lot_quantity") - F.col("allowed"), "SKIPPED", volume),
        entry(3, known & (F.col("short") > 0), F.col("short"), "SKIPPED", shortage),
        entry(
            4, traded & (F.col("worth") < smallest), F.col("quantity"), "SKIPPED", F.lit("BELOW_MIN_TRADE_VALUE")
        ),
        entry(5, traded & (F.col("worth") >= smallest), F.col("quantity"), "PENDING", F.lit("")),
    )
    return (
        sized.withColumn("__entry", F.explode(F.filter(entries, lambda e: e.isNotNull())))
        .select(
            "account_id",
            F.when(buying, F.lit(2)).otherwise(F.lit(1)).alias("phase"),
            F.when(buying, F.col("predicted_rank")).otherwise(F.lit(0)).cast("bigint").alias("priority"),
            (-F.col("lot_value")).cast("decimal(38,6)").alias("order_value"),
            "ticker", "side", F.col("price").cast("decimal(18,6)").alias("price"), "__entry.*",
        )
    )


def plan_problems(positions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(account_id, ticker, problem): held names without a price, whose value no plan can state."""
    prices = snapshots.select("ticker", F.col("price").alias("__price"))
    return (
        positions.where("economic_quantity <> 0")
        .join(prices, "ticker", "left")
        .where(F.coalesce(F.col("__price"), F.lit(0)) <= 0)
        .select("account_id", "ticker", F.lit("held_without_price").alias("problem"))
    )


def order_plan(
    targets: DataFrame,
    positions: DataFrame,
    cash: DataFrame,
    values: DataFrame,
    snapshots: DataFrame,
    rules: Constraints,
    signal_date: object,
    execution_date: object,
    expected_date: object,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Orders, holds and skips of every account with sequential ids.

    Refused are an execution date that does not follow the signal date and held names without a price.
    No task holds more than about ``block_rows`` rows of an account.
    """
    if str(execution_date) <= str(signal_date):
        raise ValueError(f"Execution on {execution_date} does not follow the signal of {signal_date}")
    found = plan_problems(positions, snapshots).limit(5).collect()
    if found:
        raise ValueError(f"Held names have no price, for example {[(r['account_id'], r['ticker']) for r in found]}")
    # Read by the early rows and by the funding of requests.
    plan = stored(planned_trades(targets, positions, values, snapshots, rules, expected_date), "plan")
    early = early_rows(plan, rules).select(
        "account_id", F.lit(0).alias("phase"), F.lit(0).cast("bigint").alias("priority"),
        F.lit(0).cast("decimal(38,6)").alias("order_value"), "ticker", "step",
        F.col("requested_side").alias("requested_side"), "quantity", "price",
        F.when(F.col("requested_side") == "HOLD", "HOLD").otherwise("SKIPPED").alias("status"),
        "reason_code",
    )
    count = plan.count()
    # Numbered where they lie, unless an account has too many entries for one task.
    largest = plan.groupBy("account_id").count().agg(F.max("count")).first()[0] or 0
    late = funded_requests(plan, cash, rules, count, block_rows).select(
        "account_id", "phase", "priority", "order_value", "ticker", "step",
        F.col("side").alias("requested_side"), "quantity", "price", "status", "reason_code",
    )
    signals = targets.select(
        "account_id", "ticker", *(["signal_id"] if "signal_id" in targets.columns else [])
    )
    if "signal_id" not in signals.columns:
        signals = signals.withColumn("signal_id", F.lit(""))
    # Early rows follow the ticker order, later ones the order in which cash was spent.
    order = ["phase", "priority", "order_value", "ticker", "step"]
    day = F.lit(signal_date).cast("date")
    label = (
        F.when(F.col("status") == "SKIPPED", "skip").when(F.col("status") == "HOLD", "hold").otherwise(F.lower("requested_side"))
    )
    entries = early.unionByName(late)
    if largest * ENTRIES <= block_rows:
        sequence = entries.withColumn("sequence", F.row_number().over(Window.partitionBy("account_id").orderBy(*order)))
    else:
        sequence = numbered(entries, ["account_id"], order, "sequence", 2 * count, block_rows)
    return (
        sequence.join(signals, ["account_id", "ticker"], "left")
        .select(
            "account_id",
            F.concat_ws(
                "-", F.lit("order"), F.date_format(day, "yyyyMMdd"),
                F.when(F.col("sequence") < 1000, F.lpad(F.col("sequence").cast("string"), 3, "0"))
                .otherwise(F.col("sequence").cast("string")),
                "ticker", label,
            ).alias("order_id"),
            F.coalesce("signal_id", F.lit("")).alias("signal_id"),
            day.alias("order_date"),
            F.lit(execution_date).cast("date").alias("intended_execution_date"),
            "ticker",
            F.when(F.col("status") == "SKIPPED", "SKIP").otherwise(F.col("requested_side")).alias("side"),
            "requested_side",
            F.col("quantity").alias("requested_quantity"),
            money("price").alias("estimated_price"),
            times_quantity("price", "quantity").alias("requested_value"),
            "status",
            "reason_code",
        )
    )


def skipped_trades(plan: DataFrame) -> DataFrame:
    return plan.where("status = 'SKIPPED'").select(
        "account_id",
        F.concat(F.lit("skip-"), F.col("order_id")).alias("skip_id"),
        "order_id",
        F.col("order_date").alias("date"),
        "ticker",
        F.col("requested_side").alias("side"),
        "requested_quantity",
        "requested_value",
        "reason_code",
    )


def plan_summary(plan: DataFrame, values: DataFrame, by: Sequence[str] = ("account_id",)) -> DataFrame:
    """Executable orders, skips and estimated turnover per account."""
    pending = F.col("status") == "PENDING"
    totals = plan.groupBy(*by).agg(
        F.count_if(pending).alias("executable_order_count"),
        F.count_if(F.col("status") == "SKIPPED").alias("skipped_trade_count"),
        money(F.sum(F.when(pending, F.col("requested_value")).otherwise(F.lit(0)))).alias("executable_value"),
    )
    return totals.join(values.select(*by, "portfolio_value"), list(by)).withColumn(
        "estimated_turnover", decimal_ratio(F.col("executable_value") / 2, F.col("portfolio_value"))
    )
