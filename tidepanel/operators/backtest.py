"""Backtest of weight histories with costs, liquidity and price-limit execution."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.numeric import truthy
from tidepanel.functions.ranking import group_quantiles
from tidepanel.functions.rolling import so_far, timeline
from tidepanel.operators.metrics import with_summed_drawdown
from tidepanel.operators.portfolio import LIMIT_TOLERANCE

COMMISSION_RATE = 0.001
SLIPPAGE_RATE = 0.001
LIQUIDITY_PENALTY_RATE = 0.001
LOW_LIQUIDITY_QUANTILE = 0.20
MAX_EXECUTION_TURNOVER = 0.40
EXECUTION_BUFFER = 1e-6
MIN_EXECUTION_WEIGHT = 1e-8


def liquidity_reference(panel: DataFrame, quantile: float = LOW_LIQUIDITY_QUANTILE) -> DataFrame:
    """Average value, closing limit flags and the low-liquidity flag of each row."""
    value = "average_daily_value_20d"
    cut = group_quantiles(panel, ["date"], value, {"low_liquidity_cutoff": quantile})
    return (
        panel.select("date", "ticker", value, "close_at_ceiling_today", "close_at_floor_today")
        .join(F.broadcast(cut), "date", "left")
        .withColumn("is_low_liquidity", truthy(F.col(value) <= F.col("low_liquidity_cutoff")))
    )


def attach_liquidity(weights: DataFrame, liquidity: DataFrame) -> DataFrame:
    return weights.join(liquidity, ["date", "ticker"], "left")


def execution_reference(predictions: DataFrame, liquidity: DataFrame) -> DataFrame:
    """Outcome and execution flags of every predicted row of one model."""
    rows = predictions.select("date", "ticker", "predicted_return", "actual_return")
    return rows.join(liquidity, ["date", "ticker"], "left")


def _execute(
    held: dict[str, float], wanted: dict[str, float], ceiling: set[str], floor: set[str]
) -> tuple[dict[str, float], float]:
    """One date: block trades at limits, fit purchases into the budget, limit turnover."""
    names = sorted(held.keys() | wanted.keys())
    before = {t: held.get(t, 0.0) for t in names}
    after = {t: wanted.get(t, 0.0) for t in names}
    for t in names:
        blocked_buy = after[t] > before[t] and t in ceiling
        blocked_sale = after[t] < before[t] and t in floor
        if blocked_buy or blocked_sale:
            after[t] = before[t]
    total = sum(after.values())
    bought = sum(max(after[t] - before[t], 0.0) for t in names)
    if total > 1.0 and bought > 0:
        kept = max(1.0 - (total - 1.0) / bought, 0.0)
        after = {
            t: before[t] + max(after[t] - before[t], 0.0) * kept + min(after[t] - before[t], 0.0)
            for t in names
        }
    moved = 0.5 * sum(abs(after[t] - before[t]) for t in names)
    if moved > MAX_EXECUTION_TURNOVER + LIMIT_TOLERANCE:
        part = max((MAX_EXECUTION_TURNOVER - EXECUTION_BUFFER) / moved, 0.0)
        after = {t: before[t] + part * (after[t] - before[t]) for t in names}
        moved = 0.5 * sum(abs(after[t] - before[t]) for t in names)
    return {t: w for t, w in after.items() if w > MIN_EXECUTION_WEIGHT}, moved


def price_limit_execution(
    weights: DataFrame, reference: DataFrame, scenario: str = "optimization_mode"
) -> DataFrame:
    """Weights actually reached when buys stop at the ceiling and sales at the floor.

    Only rows at a limit, and only of names the scenario ever wants, travel to the path
    function; outcomes and liquidity are joined to its result.
    """
    wanted = weights.select(scenario, "date", "ticker", "weight")
    names = wanted.select(scenario, "ticker").distinct()
    limits = (
        reference.where(truthy(F.col("close_at_ceiling_today")) | truthy(F.col("close_at_floor_today")))
        .select(
            "date",
            "ticker",
            truthy(F.col("close_at_ceiling_today")).alias("at_ceiling"),
            truthy(F.col("close_at_floor_today")).alias("at_floor"),
        )
        .join(names.withColumnRenamed(scenario, "__scenario"), "ticker")
    )

    def walk(plan: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        columns = [scenario, "date", "ticker", "weight", "portfolio_turnover"]
        if plan.empty:
            return pd.DataFrame(columns=columns)
        name = plan[scenario].iloc[0]
        ceilings = flags[flags["at_ceiling"]].groupby("date")["ticker"].agg(set).to_dict()
        floors = flags[flags["at_floor"]].groupby("date")["ticker"].agg(set).to_dict()
        held: dict[str, float] = {}
        rows = []
        for date, day in plan.sort_values(["date", "ticker"]).groupby("date", sort=True):
            target = dict(zip(day["ticker"], day["weight"]))
            held, moved = _execute(held, target, ceilings.get(date, set()), floors.get(date, set()))
            rows += [(name, date, t, w, moved) for t, w in sorted(held.items())]
        return pd.DataFrame(rows, columns=columns)

    schema = f"{scenario} string, date date, ticker string, weight double, portfolio_turnover double"
    path = wanted.groupBy(scenario).cogroup(limits.groupBy("__scenario")).applyInPandas(walk, schema)
    return path.join(reference, ["date", "ticker"], "left")


def backtest_returns(weights: DataFrame, by: Sequence[str] = ("optimization_mode",)) -> DataFrame:
    """Return, turnover, costs and running sums per date and scenario."""
    by = list(by)
    weight = F.col("weight")
    daily = weights.groupBy(*by, "date").agg(
        F.coalesce(F.sum(weight * F.col("actual_return")), F.lit(0.0)).alias("before_cost_return"),
        F.max("portfolio_turnover").alias("portfolio_turnover"),
        F.count("ticker").alias("selected_count"),
        F.sum(weight).alias("total_weight"),
        F.sum(F.when(truthy(F.col("is_low_liquidity")), weight).otherwise(0.0)).alias("low_liquidity_weight"),
    )
    moved = F.col("portfolio_turnover")
    running = so_far(timeline(*by))
    return (
        daily.withColumns(
            {
                "commission_cost": moved * COMMISSION_RATE,
                "slippage_cost": moved * SLIPPAGE_RATE,
                "liquidity_penalty": moved * F.col("low_liquidity_weight") * LIQUIDITY_PENALTY_RATE,
            }
        )
        .withColumn(
            "total_cost", F.col("commission_cost") + F.col("slippage_cost") + F.col("liquidity_penalty")
        )
        .withColumn("after_cost_return", F.col("before_cost_return") - F.col("total_cost"))
        .withColumns(
            {
                "cumulative_before_cost_active_return": F.sum("before_cost_return").over(running),
                "cumulative_after_cost_active_return": F.sum("after_cost_return").over(running),
            }
        )
    )


def both_execution_modes(weights: DataFrame, reference: DataFrame, liquidity: DataFrame) -> DataFrame:
    """Backtest without and with price-limit execution."""
    normal = backtest_returns(attach_liquidity(weights, liquidity))
    limited = backtest_returns(price_limit_execution(weights, reference))
    return normal.withColumn("execution_mode", F.lit("normal")).unionByName(
        limited.withColumn("execution_mode", F.lit("price_limit_aware"))
    )


def performance_summary(
    returns: DataFrame, by: Sequence[str] = ("optimization_mode", "execution_mode")
) -> DataFrame:
    """Mean, deviation, drawdown of the running sum and turnover per scenario."""
    by = list(by)
    return (
        with_summed_drawdown(returns, "after_cost_return", by)
        .groupBy(*by)
        .agg(
            F.avg("after_cost_return").alias("average_after_cost_return"),
            F.stddev_samp("after_cost_return").alias("return_volatility"),
            F.try_divide(F.avg("after_cost_return"), F.stddev_samp("after_cost_return")).alias(
                "diagnostic_sharpe"
            ),
            F.min("sum_drawdown").alias("max_active_drawdown"),
            F.avg("portfolio_turnover").alias("average_turnover"),
            F.max("portfolio_turnover").alias("maximum_turnover"),
            F.max_by("cumulative_sum", "date").alias("final_cumulative_after_cost_active_return"),
        )
    )


def comparison_summary(
    returns: DataFrame, by: Sequence[str] = ("optimization_mode", "execution_mode")
) -> DataFrame:
    return returns.groupBy(*by).agg(
        F.countDistinct("date").alias("date_count"),
        F.avg("before_cost_return").alias("average_before_cost_return"),
        F.avg("after_cost_return").alias("average_after_cost_return"),
        F.avg("total_cost").alias("average_total_cost"),
        F.max("portfolio_turnover").alias("maximum_turnover"),
        F.max("total_weight").alias("maximum_total_weight"),
        F.max_by("cumulative_after_cost_active_return", "date").alias(
            "final_cumulative_after_cost_active_return"
        ),
    )


