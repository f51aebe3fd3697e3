"""Account ledgers: executions, settlement, balances, positions and performance.

An account, or one name inside an account, may hold most of all rows.  Running balances of
such an account are built in two levels: totals per day, summed along the calendar, give the
opening value of each day, and only its rows of one day are ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidepanel.functions.dates import with_date_index
from tidepanel.functions.rolling import so_far, timeline
from tidepanel.schemas import MONEY
from tidepanel.session import checkpoint

COMMISSION_RATE = "0.001"
SLIPPAGE_RATE = "0.001"
SELL_TAX_RATE = "0.001"
SETTLEMENT_LAG = 2
# Steps folded by one call; bounds the array of a day with very many trades.
STEPS_PER_BLOCK = 1024
# Rows of one account that are ordered together; an account with more goes day by day.
ROWS_TOGETHER = 100_000
# Rows of all its accounts that one task orders.
ROWS_PER_TASK = 500_000


def money(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast(MONEY)


def times_quantity(price: Column | str, quantity: Column | str) -> Column:
    """Exact price times whole quantity; prices carry up to six decimals."""
    price = F.col(price) if isinstance(price, str) else price
    quantity = F.col(quantity) if isinstance(quantity, str) else quantity
    return money(price.cast("decimal(20,6)") * quantity.cast("decimal(16,0)"))


def times_rate(amount: Column | str, rate: Column | str) -> Column:
    """Exact amount times rate; amounts carry up to six decimals before the rate."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    rate = F.lit(rate).cast("decimal(9,6)") if isinstance(rate, str) else rate
    return money(amount.cast("decimal(26,6)") * rate)


def decimal_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient to twelve decimals; null for a zero denominator."""
    return money(F.try_divide(numerator.cast("decimal(25,6)"), denominator.cast("decimal(20,6)")))


# --- executions ---------------------------------------------------------------------


def due_orders(orders: DataFrame, date: object) -> DataFrame:
    return orders.where(
        (F.col("status") == "PENDING") & (F.col("intended_execution_date") == F.lit(date).cast("date"))
    )


def execution_problems(orders: DataFrame, prices: DataFrame) -> DataFrame:
    """Due orders that cannot be priced: blank or repeated ids, quantity or price missing."""
    joined = orders.join(prices.select("ticker", "execution_price"), "ticker", "left")
    repeated = orders.groupBy("account_id", "order_id").count().where("count > 1").select(
        "account_id", "order_id", F.lit("duplicate_order").alias("problem")
    )
    problem = (
        F.when(F.coalesce(F.trim("order_id"), F.lit("")) == "", "blank_order_id")
        .when(F.coalesce("requested_quantity", F.lit(0)) <= 0, "non_positive_quantity")
        .when(F.coalesce(F.col("execution_price"), F.lit(0)) <= 0, "missing_price")
    )
    single = joined.withColumn("problem", problem).where("problem IS NOT NULL").select(
        "account_id", "order_id", "problem"
    )
    return single.unionByName(repeated)


def list_own_prices(
    orders: DataFrame, price: Column, on: Sequence[str], dealt_by: Sequence[str] = (), name: str = "own_prices", among: Column | None = None
) -> DataFrame:
    """Every order with ``name``, the prices of all orders of its key; none without a whole key.

    One entry per row of a join of the orders with their own prices.  ``dealt_by`` are columns that equal
    keys share; where the rows already lie by them, they are not moved.  With ``among`` only the orders for which it
    holds give their price.
    """
    same_key = Window.partitionBy(*dealt_by, *on)
    entry = F.struct(price.alias("price"))
    listed = F.collect_list(entry if among is None else F.when(among, entry)).over(same_key)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    return orders.withColumn(name, F.when(whole, listed))


def _with_own_prices(orders: DataFrame) -> DataFrame:
    return (
        orders.withColumn("__price", F.explode("own_prices"))
        .withColumn("execution_price", F.col("__price.price"))
        .drop("own_prices", "__price")
    )


def price_executions(
    orders: DataFrame,
    prices: DataFrame | Column | None,
    on: Sequence[str] = ("ticker",),
    commission: str = COMMISSION_RATE,
    slippage: str = SLIPPAGE_RATE,
    sell_tax: str = SELL_TAX_RATE,
    dealt_by: Sequence[str] = (),
) -> DataFrame:
    """Executions of orders at the given prices with costs and net cash effect.

    ``prices`` has the ``on`` columns and ``execution_price``; include the execution date
    in ``on`` to price many days at once.  Where the orders bring their prices themselves, ``prices`` is
    that column, and ``dealt_by`` may name columns that orders of equal keys share; with no ``prices`` the
    orders come from ``list_own_prices``.
    """
    is_buy = F.col("side") == "BUY"
    gross = times_quantity("execution_price", "filled_quantity")
    costs = F.col("commission") + F.col("slippage") + F.col("tax")
    if prices is None:
        priced = _with_own_prices(orders)
    elif isinstance(prices, Column):
        # Orders without a whole key have no price and are not gathered.
        priced = _with_own_prices(list_own_prices(orders.dropna(subset=list(on)), prices, on, dealt_by))
    else:
        priced = orders.join(prices, list(on))
    return (
        priced.withColumns(
            {
                "execution_date": F.col("intended_execution_date"),
                "filled_quantity": F.col("requested_quantity"),
            }
        )
        .withColumn("gross_value", gross)
        .withColumns(
            {
                "commission": times_rate("gross_value", commission),
                "slippage": times_rate("gross_value", slippage),
                "tax": F.when(is_buy, money(F.lit(0))).otherwise(times_rate("gross_value", sell_tax)),
            }
        )
        .select(
            "account_id",
            F.concat(F.lit("execution-"), F.col("order_id")).alias("execution_id"),
            "order_id",
            "execution_date",
            "ticker",
            "side",
            "filled_quantity",
            money("execution_price").alias("execution_price"),
            "gross_value",
            "commission",
            "tax",
            "slippage",
            money(
                F.when(is_buy, -(F.col("gross_value") + costs)).otherwise(F.col("gross_value") - costs)
            ).alias("net_cash_effect"),
        )
    )


def batch_status(executions: DataFrame, recorded: DataFrame, orders: DataFrame) -> DataFrame:
    """One row: what recording the batch would do, following the idempotence rules."""
    keys = ["account_id", "execution_id"]
    batch = executions.select(*keys, "order_id")
    known = recorded.select(*keys).distinct().withColumn("__known", F.lit(1))
    waiting = F.col("status") == "PENDING"
    # One row per order; a repeated order counts its executions as often.
    states = orders.groupBy("account_id", "order_id").agg(
        F.count(F.lit(1)).alias("__orders"),
        F.count_if(F.col("status").isNull()).alias("__stateless"),
        F.count_if(~waiting).alias("__closed"),
    )
    # The first row of each whole key, told while its rows lie together.
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))) == 1
    whole = F.col("account_id").isNotNull() & F.col("execution_id").isNotNull()
    marked = batch.join(known, keys, "left").withColumn("__id", (whole & first).cast("int"))
    joined = marked.select("account_id", "order_id", "__known", "__id").join(states, ["account_id", "order_id"], "left")
    times = F.coalesce("__orders", F.lit(1))
    none = F.lit(0).cast("bigint")
    decision = (
        F.when(F.col("batch_rows") == 0, "no_op")
        .when(F.col("batch_rows") != F.col("distinct_ids"), "reject_duplicates")
        .when(F.col("known_rows") == F.col("batch_rows"), "no_op")
        .when(F.col("known_rows") > 0, "reject_overlap")
        .when(F.col("missing_orders") > 0, "reject_missing_order")
        .when(F.col("not_pending") > 0, "reject_not_pending")
        .otherwise("record")
    )
    return joined.agg(
        F.coalesce(F.sum(times), none).alias("batch_rows"),
        F.coalesce(F.sum("__id"), none).alias("distinct_ids"),
        F.coalesce(F.sum(F.when(F.col("__known") == 1, times)), none).alias("known_rows"),
        F.coalesce(F.sum(F.coalesce("__stateless", F.lit(1))), none).alias("missing_orders"),
        F.coalesce(F.sum("__closed"), none).alias("not_pending"),
    ).withColumn("decision", decision)


def mark_executed(orders: DataFrame, executions: DataFrame) -> DataFrame:
    done = executions.select("account_id", "order_id").distinct().withColumn("__done", F.lit(True))
    return (
        orders.join(done, ["account_id", "order_id"], "left")
        .withColumn("status", F.when(F.col("__done"), "EXECUTED").otherwise(F.col("status")))
        .drop("__done")
        .select(*orders.columns)
    )


def settlement_steps(calendar: DataFrame, lag: int = SETTLEMENT_LAG) -> DataFrame:
    """(execution_date, settlement_date) of every calendar day; null where the calendar ends too early."""
    here = calendar.select(F.col("date").alias("execution_date"), "trading_idx")
    there = calendar.select(F.col("date").alias("settlement_date"), (F.col("trading_idx") - lag).alias("trading_idx"))
    return here.join(there, "trading_idx", "left").drop("trading_idx")


def settlement_problems(executions: DataFrame, calendar: DataFrame, lag: int = SETTLEMENT_LAG) -> DataFrame:
    """(account_id, execution_id, execution_date, problem) of executions that cannot be settled."""
    steps = settlement_steps(calendar, lag).withColumn("__open", F.lit(True))
    problem = F.when(F.col("__open").isNull(), "not_a_trading_day").when(
        F.col("settlement_date").isNull(), "calendar_ends_before_settlement"
    )
    return (
        executions.join(F.broadcast(steps), "execution_date", "left")
        .withColumn("problem", problem)
        .where("problem IS NOT NULL")
        .select("account_id", "execution_id", "execution_date", "problem")
    )


def settlements(
    executions: DataFrame, calendar: DataFrame, lag: int = SETTLEMENT_LAG, refuse: bool = True
) -> DataFrame:
    """Settlement ``lag`` trading days after each execution.

    An execution off the calendar, or too close to its end, could never settle and would leave
    the books open for ever: the job that reads it fails.  ``settlement_problems`` lists
    such rows; with ``refuse`` off they get a null date.
    """
    settles = F.col("settlement_date")
    if refuse:
        message = F.concat(
            F.lit("The calendar has no settlement for an execution on "),
            F.coalesce(F.col("execution_date").cast("string"), F.lit("a missing date")),
        )
        settles = F.when(settles.isNull(), F.raise_error(message).cast("date")).otherwise(settles)
    return executions.join(F.broadcast(settlement_steps(calendar, lag)), "execution_date", "left").select(
        "account_id",
        F.concat(F.lit("settlement-"), F.col("execution_id")).alias("settlement_id"),
        F.col("execution_date").alias("trade_date"),
        settles.alias("settlement_date"),
        "ticker",
        "side",
        F.col("filled_quantity").alias("quantity"),
        F.col("gross_value").alias("gross_amount"),
        money(F.col("commission") + F.col("tax") + F.col("slippage")).alias("fees_and_taxes"),
        "net_cash_effect",
        F.col("execution_id").alias("reference_id"),
    )


def with_settlement_status(rows: DataFrame, asof: object) -> DataFrame:
    due = F.col("settlement_date") <= F.lit(asof).cast("date")
    return rows.withColumns(
        {
            "status": F.when(due, "SETTLED").otherwise("PENDING"),
            "settled_at": F.when(due, F.col("settlement_date")),
        }
    )


# --- event log and balances -----------------------------------------------------------


def account_events(trades: DataFrame, asof: object, deposits: DataFrame | None = None) -> DataFrame:
    """Cash and share changes of every trade, settlement and deposit up to a date.

    ``trades`` comes from ``settlements`` and is read once: each row gives its trade and
    its settlement event.  Settlements of a day come before its trades.
    """
    limit = F.lit(asof).cast("date")
    zero_money, zero = money(F.lit(0)), F.lit(0).cast("bigint")
    buy = F.col("side") == "BUY"
    quantity, net = F.col("quantity"), F.col("net_cash_effect")

    def event(
        date: Column, phase: int, prefix: str, reference: str, suffix: str,
        settled: Column, unsettled: Column, shares: Column, bought: Column, sold: Column,
    ) -> Column:
        return F.struct(
            date.alias("event_date"),
            F.lit(phase).alias("phase"),
            F.concat(F.lit(prefix), F.col(reference), F.lit(suffix)).alias("entry_id"),
            F.concat(F.col("side"), F.lit(suffix.upper().replace("-", "_"))).alias("entry_type"),
            F.col(reference).alias("reference_id"),
            money(settled).alias("settled_cash_delta"),
            money(unsettled).alias("unsettled_cash_delta"),
            shares.alias("settled_shares_delta"),
            bought.alias("unsettled_buy_delta"),
            sold.alias("pending_sell_delta"),
        )

    traded = event(
        F.col("trade_date"), 2, "cash-", "reference_id", "-execution",
        F.when(buy, net).otherwise(zero_money), F.when(buy, zero_money).otherwise(net),
        zero, F.when(buy, quantity).otherwise(zero), F.when(buy, zero).otherwise(quantity),
    )
    settled = event(
        F.col("settlement_date"), 1, "cash-", "settlement_id", "-settlement",
        F.when(buy, zero_money).otherwise(net), F.when(buy, zero_money).otherwise(-net),
        F.when(buy, quantity).otherwise(-quantity),
        F.when(buy, -quantity).otherwise(zero), F.when(buy, zero).otherwise(-quantity),
    )
    columns = [
        "account_id", "ticker", "side", "settlement_date", "amount", "event_date", "phase", "entry_id", "entry_type",
        "reference_id", "settled_cash_delta", "unsettled_cash_delta", "settled_shares_delta",
        "unsettled_buy_delta", "pending_sell_delta",
    ]
    events = (
        trades.select(
            "account_id", "ticker", "side", "settlement_date", net.alias("amount"),
            F.explode(F.array(traded, settled)).alias("event"),
        )
        .select("account_id", "ticker", "side", "settlement_date", "amount", "event.*")
        .where(F.col("event_date") <= limit)
        .select(*columns)
    )
    if deposits is None:
        return events
    opening = deposits.where(F.col("event_date") <= limit).select(
        "account_id",
        F.lit(None).cast("string").alias("ticker"),
        F.lit(None).cast("string").alias("side"),
        F.col("event_date").alias("settlement_date"),
        money("amount").alias("amount"),
        "event_date",
        F.lit(0).alias("phase"),
        F.lit("cash-initial-deposit").alias("entry_id"),
        F.lit("INITIAL_DEPOSIT").alias("entry_type"),
        F.lit("initial-account-state").alias("reference_id"),
        money("amount").alias("settled_cash_delta"),
        zero_money.alias("unsettled_cash_delta"),
        zero.alias("settled_shares_delta"),
        zero.alias("unsettled_buy_delta"),
        zero.alias("pending_sell_delta"),
    )
    return opening.unionByName(events)


def account_pieces(trades: DataFrame, together: int = ROWS_TOGETHER) -> int | None:
    """Partitions by account that keep the events of these trades small; none where one account has too many.

    A trade has two events, its execution and its settlement.
    """
    counts = trades.groupBy("account_id").agg((2 * F.count(F.lit(1)) + 1).alias("__rows"))
    row = counts.agg(F.sum("__rows").alias("rows"), F.max("__rows").alias("largest")).first()
    if (row["largest"] or 0) > together:
        return None
    usual = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, (row["rows"] or 0) // ROWS_PER_TASK + 1)


def running_totals(
    rows: DataFrame,
    totals: dict[str, str],
    by: Sequence[str],
    date: str,
    order: Sequence[str],
    together: int | None = ROWS_TOGETHER,
    keep: bool = False,
) -> DataFrame:
    """Running sum of each column in (date, order) per group; rows without a whole key or date have none.

    ``totals`` maps a column to its running-sum name.  The rows of a group are moved once and ordered
    together.  Where the first ``by`` column has a value with more than ``together`` rows, the groups of
    that value are ordered day by day, each day beginning with the totals of the days before.  With no
    ``together`` nothing is counted: no value is that large.
    A day has no sum before its first known value.  Rows without a whole key or date go, unless ``keep`` is set.
    """
    by = list(by)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, date]])
    if not keep:
        rows = rows.dropna(subset=[*by, date])
    known = Window.partitionBy(*by, date).orderBy(*order)
    types = {c: rows.schema[c].dataType for c in totals}

    def summed(known: WindowSpec, along: WindowSpec, opening: dict[str, Column]) -> dict[str, Column]:
        sums = {}
        for c, name in totals.items():
            value = F.when(whole, F.col(c)) if keep else F.col(c)
            total = F.sum(value).over(so_far(along))
            if opening:
                total = F.coalesce(opening[c], F.lit(0).cast(types[c])) + total
            sums[name] = F.when(F.count(value).over(so_far(known)) > 0, total).cast(types[c])
        return sums

    large = None
    if together is not None:
        counts = rows.where(whole).groupBy(by[0]).agg(F.count(F.lit(1)).alias("__rows"))
        large = checkpoint(counts.where(F.col("__rows") > together).select(by[0]))
    if large is None or large.isEmpty():
        return rows.withColumns(summed(known, Window.partitionBy(*by).orderBy(date, *order), {}))
    # At most one in ``together`` rows: few enough to send to every task.
    large = F.broadcast(large)
    days = rows.where(whole).join(large, by[0], "left_semi").groupBy(*by, date).agg(*[F.sum(c).alias(f"__day_{c}") for c in totals])
    earlier = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    opening = days.select(
        *by, F.col(date).alias("__piece"), *[F.sum(f"__day_{c}").over(earlier).alias(f"__open_{c}") for c in totals]
    )
    pieces = rows.join(large.withColumn("__large", F.lit(True)), by[0], "left").withColumn(
        "__piece", F.when(F.col("__large"), F.col(date))
    )
    along = Window.partitionBy(*by, "__piece").orderBy(date, *order)
    known = Window.partitionBy(*by, "__piece", date).orderBy(*order)
    return (
        pieces.join(opening, [*by, "__piece"], "left")
        .withColumns(summed(known, along, {c: F.col(f"__open_{c}") for c in totals}))
        .select(*rows.columns, *totals.values())
    )


def cash_ledger(events: DataFrame, together: int | None = ROWS_TOGETHER) -> DataFrame:
    """Cash entries with running settled and unsettled balances per account."""
    rows = running_totals(
        events,
        {
            "settled_cash_delta": "settled_cash_balance",
            "unsettled_cash_delta": "unsettled_cash_balance",
        },
        ["account_id"],
        "event_date",
        ["phase", "entry_id"],
        together,
    )
    return rows.select(
        "account_id", "entry_id", "event_date", "settlement_date", "entry_type", "amount",
        "settled_cash_delta", "unsettled_cash_delta", "reference_id",
        "settled_cash_balance", "unsettled_cash_balance",
    )


def trade_violations(events: DataFrame, together: int | None = ROWS_TOGETHER) -> DataFrame:
    """(account_id, ticker, entry_id, event_date, violation) of trades the books did not cover when they came.

    ``overspent``: a purchase leaves less than no settled cash, whatever still is to come in.
    ``oversold``: a sale leaves more shares sold than had settled until then.  Both totals go along one copy of the rows.
    """
    order = ["phase", "entry_id"]
    rows = events.withColumn("__sellable_delta", F.col("settled_shares_delta") - F.col("pending_sell_delta"))
    rows = running_totals(rows, {"settled_cash_delta": "__cash"}, ["account_id"], "event_date", order, together, keep=True)
    rows = running_totals(
        rows, {"__sellable_delta": "__sellable"}, ["account_id", "ticker"], "event_date", order, together, keep=True
    )
    violation = F.when(F.expr("entry_type = 'BUY_EXECUTION' AND __cash < 0"), "overspent").when(
        F.expr("entry_type = 'SELL_EXECUTION' AND __sellable < 0"), "oversold"
    )
    return rows.select("account_id", "ticker", "entry_id", "event_date", violation.alias("violation")).where("violation IS NOT NULL")


def balance_problems(ledger: DataFrame, together: int | None = ROWS_TOGETHER) -> DataFrame:
    """(account_id, entry_id, problem): entries of a cash ledger that a replay contradicts.

    The balances of every entry are computed again from the changes before it; deposits come
    before settlements of the same day and those before trades.
    """
    return _replayed(ledger, together).where("problem IS NOT NULL").select("account_id", "entry_id", "problem")


def _replayed(ledger: DataFrame, together: int | None) -> DataFrame:
    """Every entry with its ``problem``; entries without account or date cannot be replayed and have none."""
    phase = (
        F.when(F.col("entry_type") == "INITIAL_DEPOSIT", 0)
        .when(F.col("entry_type").endswith("_SETTLEMENT"), 1)
        .otherwise(2)
    )
    sides = ("settled_cash", "unsettled_cash")
    replayed = running_totals(
        ledger.withColumn("__phase", phase),
        {f"{side}_delta": f"__{side}" for side in sides},
        ["account_id"],
        "event_date",
        ["__phase", "entry_id"],
        together,
        keep=True,
    )
    wrong = F.lit(None).cast("string")
    for side in reversed(sides):
        wrong = F.when(~F.col(f"__{side}").eqNullSafe(F.col(f"{side}_balance")), f"{side}_balance").otherwise(wrong)
    whole = F.col("account_id").isNotNull() & F.col("event_date").isNotNull()
    return replayed.withColumn("problem", F.when(whole, wrong))


def event_totals(events: DataFrame) -> DataFrame:
    """Changes summed per account and name; ``balances`` and ``share_positions`` of it are those of the events."""
    deltas = [
        "settled_cash_delta", "unsettled_cash_delta", "settled_shares_delta", "unsettled_buy_delta", "pending_sell_delta",
    ]
    return events.groupBy("account_id", "ticker").agg(*[F.sum(c).alias(c) for c in deltas])


def trade_totals(trades: DataFrame, asof: object, deposits: DataFrame | None = None) -> DataFrame:
    """``event_totals`` of the ``account_events`` of these trades, summed without a row per event.

    ``purchases`` counts the purchases up to the date and ``bought`` sums their gross amounts.
    """
    limit = F.lit(asof).cast("date")
    no_money, none = money(F.lit(0)), F.lit(0).cast("bigint")
    buy = F.col("side") == "BUY"
    quantity, net = F.col("quantity"), F.col("net_cash_effect")
    traded, settled = F.col("trade_date") <= limit, F.col("settlement_date") <= limit

    def beside_zero(value: Column, zero: Column, also: Column) -> Column:
        """A change that comes alone, or next to a change of zero."""
        return F.when(also, F.coalesce(value, zero)).otherwise(value)

    def waiting(value: Column, zero: Column) -> Column:
        """Added by the trade, taken back by its settlement."""
        return F.when(traded & settled, F.when(value.isNotNull(), zero)).when(traded, value).otherwise(-value)

    cash = F.when(buy, F.when(traded, beside_zero(net, no_money, settled)).otherwise(no_money)).otherwise(
        F.when(settled, beside_zero(net, no_money, traded)).otherwise(no_money)
    )
    shares = F.when(settled, beside_zero(F.when(buy, quantity).otherwise(-quantity), none, traded)).otherwise(none)
    bought = buy & traded
    changes = trades.where(traded | settled).select(
        "account_id",
        "ticker",
        money(cash).alias("settled_cash_delta"),
        money(F.when(buy, no_money).otherwise(waiting(net, no_money))).alias("unsettled_cash_delta"),
        shares.alias("settled_shares_delta"),
        F.when(buy, waiting(quantity, none)).otherwise(none).alias("unsettled_buy_delta"),
        F.when(buy, none).otherwise(waiting(quantity, none)).alias("pending_sell_delta"),
        F.when(bought, F.col("gross_amount")).alias("bought"),
        F.when(bought, F.lit(1)).alias("purchases"),
    )
    if deposits is not None:
        opening = deposits.where(F.col("event_date") <= limit).select(
            "account_id",
            F.lit(None).cast("string").alias("ticker"),
            money("amount").alias("settled_cash_delta"),
            no_money.alias("unsettled_cash_delta"),
            *[none.alias(c) for c in ("settled_shares_delta", "unsettled_buy_delta", "pending_sell_delta")],
        )
        changes = changes.unionByName(opening, allowMissingColumns=True)
    sums = [c for c in changes.columns if c not in ("account_id", "ticker", "purchases")]
    return changes.groupBy("account_id", "ticker").agg(
        *[F.sum(c).alias(c) for c in sums], F.count("purchases").alias("purchases")
    )


def balances(events: DataFrame) -> DataFrame:
    """Cash per account after all events."""
    return events.groupBy("account_id").agg(
        money(F.sum("settled_cash_delta")).alias("settled_cash"),
        money(F.sum("unsettled_cash_delta")).alias("unsettled_cash"),
    )


def share_positions(events: DataFrame) -> DataFrame:
    """Shares per account and name after all events."""
    deltas = ["settled_shares_delta", "unsettled_buy_delta", "pending_sell_delta"]
    sums = events.where("ticker IS NOT NULL").groupBy("account_id", "ticker").agg(*[F.sum(c).alias(c) for c in deltas])
    return summed_positions(sums)


def summed_positions(totals: DataFrame) -> DataFrame:
    """``share_positions`` of totals that hold one row per account and name: nothing is summed again."""
    return totals.where("ticker IS NOT NULL").select(
        "account_id",
        "ticker",
        F.col("settled_shares_delta").alias("settled_shares"),
        F.col("unsettled_buy_delta").alias("unsettled_buy_shares"),
        F.col("pending_sell_delta").alias("pending_sell_shares"),
    ).withColumns(
        {
            "sellable_quantity": F.col("settled_shares") - F.col("pending_sell_shares"),
            "economic_quantity": F.col("settled_shares")
            + F.col("unsettled_buy_shares")
            - F.col("pending_sell_shares"),
        }
    )


def average_costs(trades: DataFrame) -> DataFrame:
    """Moving weighted average cost per account and name after its last trade.

    A buy adds its full cost to the cost basis, a sale keeps the average and so scales the
    basis by the remaining share, an emptied position starts again at zero.  Both are
    steps ``basis -> factor * basis + added``.  Steps in a row are again such a step, so
    they are folded into one, without any division: first inside blocks of a day's steps,
    then the blocks of a day, then the days.
    """
    key = ["account_id", "ticker"]
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    cost = (F.col("gross_amount") + F.col("fees_and_taxes")).cast("double")
    rows = trades.select(
        *key,
        "trade_date",
        "reference_id",
        signed.alias("signed"),
        F.when(F.col("side") == "BUY", cost).otherwise(F.lit(0.0)).alias("added"),
    )
    held = running_totals(rows, {"signed": "held"}, key, "trade_date", ["reference_id"])
    before = F.col("held") - F.col("signed")
    factor = F.when(F.col("signed") >= 0, F.lit(1.0)).otherwise(
        F.coalesce(F.try_divide(F.col("held").cast("double"), before), F.lit(0.0))
    )
    place = F.row_number().over(Window.partitionBy(*key, "trade_date").orderBy("reference_id"))
    steps = held.select(*key, "trade_date", place.alias("place"), factor.alias("factor"), "added", "held")
    blocked = steps.withColumn("block", F.floor((F.col("place") - 1) / STEPS_PER_BLOCK))
    blocks = _folded(blocked, [*key, "trade_date", "block"], "place")
    days = _folded(blocks, [*key, "trade_date"], "block")
    last = _folded(days, key, "trade_date")
    average = F.try_divide(F.col("added"), F.col("held").cast("double"))
    return last.select(*key, F.coalesce(average, F.lit(0.0)).alias("average_cost"))


def _folded(steps: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """One step per group that does what its steps do one after another; ``held`` is the last one's."""
    listed = F.array_sort(F.collect_list(F.struct(order, "factor", "added")))
    whole = F.aggregate(
        "steps",
        F.struct(F.lit(1.0).alias("factor"), F.lit(0.0).alias("added")),
        lambda done, step: F.struct(
            (done["factor"] * step["factor"]).alias("factor"),
            (done["added"] * step["factor"] + step["added"]).alias("added"),
        ),
    )
    grouped = steps.groupBy(*by).agg(listed.alias("steps"), F.max_by("held", order).alias("held"))
    return grouped.withColumn("whole", whole).select(*by, "whole.factor", "whole.added", "held")


def position_snapshot(
    positions: DataFrame, cash: DataFrame, marks: DataFrame, asof: object
) -> DataFrame:
    """Positions with market value and weight of the account total including cash."""
    priced = positions.join(marks.select("ticker", "mark_price"), "ticker", "left").withColumn(
        "mark_price", F.coalesce(money("mark_price"), money(F.lit(0)))
    )
    valued = priced.withColumn("market_value", times_quantity("mark_price", "economic_quantity"))
    totals = (
        valued.groupBy("account_id")
        .agg(F.sum("market_value").alias("__market"))
        .join(cash, "account_id", "full_outer")
        .select(
            "account_id",
            (
                F.coalesce("__market", F.lit(0)) + F.coalesce("settled_cash", F.lit(0))
                + F.coalesce("unsettled_cash", F.lit(0))
            ).alias("__total"),
        )
    )
    weight = F.when(F.col("__total") > 0, decimal_ratio(F.col("market_value"), F.col("__total")))
    return (
        valued.join(totals, "account_id")
        .withColumns(
            {
                "asof_date": F.lit(asof).cast("date"),
                "weight": F.coalesce(weight, money(F.lit(0))),
            }
        )
        .drop("__total")
    )


def portfolio_value(positions: DataFrame, cash: DataFrame, prices: DataFrame) -> DataFrame:
    """Cash plus market value per account; a held name without price is reported."""
    held = positions.where("economic_quantity > 0").join(
        prices.select("ticker", "mark_price"), "ticker", "left"
    )
    values = held.groupBy("account_id").agg(
        money(F.sum(times_quantity("mark_price", "economic_quantity"))).alias("market_value"),
        F.count_if(F.coalesce(F.col("mark_price"), F.lit(0)) <= 0).alias("missing_prices"),
    )
    return cash.join(values, "account_id", "left").select(
        "account_id",
        money(
            F.col("settled_cash") + F.col("unsettled_cash") + F.coalesce("market_value", F.lit(0))
        ).alias("portfolio_value"),
        F.coalesce("missing_prices", F.lit(0).cast("bigint")).alias("missing_prices"),
    )


def account_values(totals: DataFrame, prices: DataFrame) -> DataFrame:
    """``balances`` and ``portfolio_value`` of totals with one row per account and name, in one sum.

    ``prices`` has one row per ticker.
    """
    shares = F.col("settled_shares_delta") + F.col("unsettled_buy_delta") - F.col("pending_sell_delta")
    # As in a join by account, positions of no account belong to none.
    held = F.col("account_id").isNotNull() & F.col("ticker").isNotNull() & (F.col("__shares") > 0)
    return (
        totals.withColumn("__shares", shares)
        .join(prices.select("ticker", "mark_price"), "ticker", "left")
        .groupBy("account_id")
        .agg(
            money(F.sum("settled_cash_delta")).alias("settled_cash"),
            money(F.sum("unsettled_cash_delta")).alias("unsettled_cash"),
            money(F.sum(F.when(held, times_quantity("mark_price", "__shares")))).alias("__market"),
            F.count_if(held & (F.coalesce(F.col("mark_price"), F.lit(0)) <= 0)).alias("missing_prices"),
        )
        .select(
            "account_id",
            "settled_cash",
            "unsettled_cash",
            money(
                F.col("settled_cash") + F.col("unsettled_cash") + F.coalesce("__market", F.lit(0))
            ).alias("portfolio_value"),
            "missing_prices",
        )
    )


def _ledger_violations(ledger: DataFrame, together: int | None) -> DataFrame:
    """Repeated entries, and accounts with a balance that is negative or contradicted, from one look at the ledger."""

    def named(name: str, key: Column) -> Column:
        return F.struct(F.lit(name).alias("violation"), key.cast("string").alias("key"))

    below = F.expr("settled_cash_balance < 0 OR unsettled_cash_balance < 0")
    marks = F.array(
        named("duplicate_entry", F.col("entry_id")),
        F.when(below, named("negative_balance", F.lit(None))),
        F.when(F.col("problem").isNotNull(), named("wrong_running_balance", F.lit(None))),
    )
    return (
        _replayed(ledger, together)
        .select("account_id", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("mark"))
        .groupBy("account_id", F.col("mark.violation").alias("violation"), F.col("mark.key").alias("key"))
        .count()
        .where("violation <> 'duplicate_entry' OR count > 1")
        .select("account_id", F.lit(None).cast("string").alias("ticker"), "violation")
    )


def reconcile(
    positions: DataFrame,
    cash: DataFrame,
    settlement_rows: DataFrame,
    ledger: DataFrame | None = None,
    together: int | None = ROWS_TOGETHER,
) -> DataFrame:
    """(account_id, ticker, violation): empty when the books agree."""
    negative_cash = cash.select(
        "account_id",
        F.lit(None).cast("string").alias("ticker"),
        F.when(F.col("settled_cash") < 0, "negative_settled_cash")
        .when(F.col("unsettled_cash") < 0, "negative_unsettled_cash")
        .alias("violation"),
    )
    quantities = ["settled_shares", "unsettled_buy_shares", "pending_sell_shares", "sellable_quantity", "economic_quantity"]
    any_negative = F.lit(False)
    for name in quantities:
        any_negative = any_negative | (F.col(name) < 0)
    negative_shares = positions.select(
        "account_id", "ticker", F.when(any_negative, "negative_quantity").alias("violation")
    )
    pending = settlement_rows.where("status = 'PENDING'")
    per_name = pending.groupBy("account_id", "ticker").agg(
        F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(0)).alias("__buys"),
        F.sum(F.when(F.col("side") == "SELL", F.col("quantity")).otherwise(0)).alias("__sells"),
    )
    none = F.lit(0).cast("bigint")
    compared = positions.join(per_name, ["account_id", "ticker"], "full_outer").select(
        "account_id",
        "ticker",
        F.when(
            F.coalesce("unsettled_buy_shares", none) != F.coalesce("__buys", none), "unsettled_buy_mismatch"
        )
        .when(F.coalesce("pending_sell_shares", none) != F.coalesce("__sells", none), "pending_sell_mismatch")
        .alias("violation"),
    )
    proceeds = pending.where("side = 'SELL'").groupBy("account_id").agg(
        F.sum("net_cash_effect").alias("__proceeds")
    )
    cash_match = cash.join(proceeds, "account_id", "full_outer").select(
        "account_id",
        F.lit(None).cast("string").alias("ticker"),
        F.when(
            F.coalesce(F.col("unsettled_cash"), F.lit(0)) != F.coalesce(F.col("__proceeds"), F.lit(0)),
            "unsettled_cash_mismatch",
        ).alias("violation"),
    )
    found = negative_cash.unionByName(negative_shares).unionByName(compared).unionByName(cash_match)
    if ledger is not None:
        found = found.unionByName(_ledger_violations(ledger, together))
    return found.where("violation IS NOT NULL")


# --- performance -----------------------------------------------------------------------


def equal_weight_benchmark(bars: DataFrame, price: str = "close") -> DataFrame:
    """Mean of current over previous close minus one, between consecutive dates.

    Only names with a positive price on both dates count; the first date has none.
    """
    series = timeline("ticker", order="date_idx")
    rows = with_date_index(bars.select("date", "ticker", F.col(price).alias("__price")))
    consecutive = F.lag("date_idx").over(series) == F.col("date_idx") - 1
    previous = F.when(consecutive, F.lag("__price").over(series))
    moved = F.when((previous > 0) & (F.col("__price") > 0), F.try_divide(F.col("__price"), previous) - 1.0)
    return (
        rows.withColumn("__move", moved)
        .groupBy("date")
        .agg(F.avg("__move").alias("benchmark_return"), F.count("__move").alias("names"))
        .where("names > 0")
    )


def execution_turnover(executions: DataFrame, reference: DataFrame) -> DataFrame:
    """Traded value per account and date over a reference value (account_id, date, reference_value)."""
    traded = executions.groupBy("account_id", F.col("execution_date").alias("date")).agg(
        money(F.sum("gross_value")).alias("traded_value")
    )
    value = F.col("reference_value")
    return reference.join(traded, ["account_id", "date"], "left").select(
        "account_id",
        "date",
        F.when(
            value > 0, decimal_ratio(F.coalesce(F.col("traded_value"), money(F.lit(0))), value)
        ).otherwise(money(F.lit(0))).alias("turnover"),
    )


def skipped_counts(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("account_id", "date").agg(F.count(F.lit(1)).alias("skipped_trade_count"))


def daily_performance(values: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Performance series per account from (account_id, date, portfolio_value, cash, ...).

    The first row of an account starts at zero return and its benchmark at its own value.
    """
    order = timeline("account_id")
    value = F.col("portfolio_value").cast("double")
    first = F.row_number().over(order) == 1
    daily = F.when(first, F.lit(0.0)).otherwise(F.try_divide(value, F.lag(value).over(order)) - 1.0)
    growth = F.product(F.lit(1.0) + F.col("daily_return")).over(so_far(order))
    bench_step = F.when(first, F.lit(0.0)).otherwise(F.coalesce("benchmark_return", F.lit(0.0)))
    bench = F.product(F.lit(1.0) + F.col("__step")).over(so_far(order))
    start = F.first(value).over(so_far(order))
    peak = F.max(value).over(so_far(order))
    return (
        values.join(F.broadcast(benchmark.select("date", "benchmark_return")), "date", "left")
        .withColumn("benchmark_return", F.coalesce("benchmark_return", F.lit(0.0)))
        .withColumns({"daily_return": daily, "__step": bench_step})
        .withColumns(
            {
                "cumulative_return": growth - 1.0,
                "cumulative_benchmark_return": bench - 1.0,
                "benchmark_value": start * bench,
                "active_return": F.col("daily_return") - F.col("benchmark_return"),
                "drawdown": F.when(peak > 0, value / peak - 1.0).otherwise(0.0),
                "cash_weight": F.when(
                    value > 0, (F.col("settled_cash") + F.col("unsettled_cash")).cast("double") / value
                ).otherwise(0.0),
            }
        )
        .drop("__step")
    )


def latest_marks(bars: DataFrame, asof: object, multiplier: float = 1.0) -> DataFrame:
    """Last close per ticker on or before a date."""
    return (
        bars.where(F.col("date") <= F.lit(asof).cast("date"))
        .groupBy("ticker")
        .agg(
            (F.max_by("close", "date") * F.lit(multiplier)).alias("mark_price"),
            F.max("date").alias("mark_date"),
        )
    )


def target_export(targets: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Targets next to current positions, missing positions as zero."""
    current = snapshot.select(
        "account_id", "ticker", "settled_shares", "unsettled_buy_shares", "pending_sell_shares",
        "sellable_quantity", "economic_quantity", "average_cost", "mark_price", "market_value",
        F.col("weight").alias("current_weight"),
    )
    joined = targets.join(current, ["account_id", "ticker"], "left")
    zeros = {
        c: F.coalesce(F.col(c), F.lit(0).cast(current.schema[c].dataType))
        for c in current.columns
        if c not in ("account_id", "ticker")
    }
    return joined.withColumns(zeros).withColumn(
        "weight_difference", F.col("target_weight") - F.col("current_weight")
    )
