"""Market regimes, drawdown overlay and regime-driven model choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.numeric import change
from tidepanel.functions.rolling import compounded, fill_forward, rolling, so_far, timeline

REGIMES = ("trend_up", "trend_down", "high_volatility")
CASH = "cash"
# The default model per regime.
DEFAULT_POLICY = {
    "trend_up": "random_forest",
    "high_volatility": "random_forest",
    "trend_down": CASH,
}


def equal_weight_market(bars: DataFrame) -> DataFrame:
    """Mean return per date over forward-filled prices."""
    series = timeline("ticker")
    returns = (
        bars.select("date", "ticker", "adjusted_close")
        .withColumn("__price", fill_forward("adjusted_close", series))
        .withColumn("stock_return", change("__price", F.lag("__price", 1).over(series)))
    )
    return returns.groupBy("date").agg(F.avg("stock_return").alias("market_return"))


def drawdown_overlay(
    bars: DataFrame,
    trigger: float = -0.10,
    reduced: float = 0.50,
    normal: float = 0.97,
) -> DataFrame:
    """Exposure per date, reduced while the equal-weight market is in a deep drawdown."""
    if not -1.0 < trigger < 0.0 or not 0.0 <= reduced <= normal <= 1.0:
        raise ValueError("Need -1 < trigger < 0 and 0 <= reduced <= normal <= 1")
    order = timeline()
    return (
        equal_weight_market(bars)
        .withColumn("__nav", compounded("market_return", order))
        .withColumn("market_drawdown", change("__nav", F.max("__nav").over(so_far(order))))
        .withColumn("risk_off", F.col("market_drawdown") <= trigger)
        .withColumn("target_exposure", F.when(F.col("risk_off"), reduced).otherwise(normal))
        .select("date", "market_drawdown", "risk_off", "target_exposure")
    )


def market_regimes(bars: DataFrame, return_window: int = 20, baseline_window: int = 126) -> DataFrame:
    """Regime per date from market history only; dates without full windows drop out."""
    if return_window <= 1 or baseline_window <= 1:
        raise ValueError("A regime needs windows of two rows or more")
    order = timeline()

    def growth(value: Column) -> Column:
        return F.product(F.lit(1.0) + value)

    def median(value: Column) -> Column:
        return F.percentile(value, F.lit(0.5))

    volatility, baseline = F.col("trailing_volatility"), F.col("volatility_baseline")
    return (
        equal_weight_market(bars)
        .withColumns(
            {
                "trailing_return": rolling(growth, "market_return", order, return_window) - 1.0,
                "trailing_volatility": rolling(F.stddev_samp, "market_return", order, return_window),
            }
        )
        .withColumn(
            "volatility_baseline", rolling(median, "trailing_volatility", order, baseline_window)
        )
        .dropna(subset=["trailing_return", "trailing_volatility", "volatility_baseline"])
        .withColumn(
            "market_regime",
            F.when(volatility > baseline, "high_volatility")
            .when(F.col("trailing_return") >= 0, "trend_up")
            .otherwise("trend_down"),
        )
        .select("date", "market_regime", "trailing_return", "trailing_volatility", "volatility_baseline")
    )


def candidates_by_regime(daily: DataFrame, regimes: DataFrame) -> DataFrame:
    return (
        daily.join(F.broadcast(regimes.select("date", "market_regime")), "date")
        .groupBy("market_regime", "model_name")
        .agg(
            F.countDistinct("date").alias("evaluated_dates"),
            F.avg("rank_ic").alias("average_rank_ic"),
            F.avg("top_n_actual_return").alias("average_top_n_actual_return"),
        )
    )


def check_policy(policy: Mapping[str, str]) -> dict[str, str]:
    missing = sorted(set(REGIMES) - set(policy))
    if missing:
        raise ValueError(f"Policy lacks regimes: {missing}")
    return dict(policy)


def chosen_model(policy: Mapping[str, str], regime: str = "market_regime") -> Column:
    """Model selected for the regime of the row."""
    chosen = F.lit(None).cast("string")
    for name, model in check_policy(policy).items():
        chosen = F.when(F.col(regime) == name, model).otherwise(chosen)
    return chosen


def fixed_policies(models: Sequence[str]) -> dict[str, dict[str, str]]:
    """One policy per model that uses it in every regime."""
    return {model: {regime: model for regime in REGIMES} for model in models}


def regime_policy_history(
    daily: DataFrame, regimes: DataFrame, policy: Mapping[str, str] | None = None
) -> DataFrame:
    """Daily metrics of the model the regime selects; cash earns zero and has no IC."""
    rules = DEFAULT_POLICY if policy is None else policy
    dates = daily.select("date").distinct()
    selected = (
        regimes.select("date", "market_regime")
        .join(F.broadcast(dates), "date", "left_semi")
        .withColumn("selected_model", chosen_model(rules))
    )
    metrics = daily.withColumnRenamed("model_name", "selected_model")
    joined = selected.join(metrics, ["date", "selected_model"], "left")
    cash = F.col("selected_model") == CASH
    return joined.withColumn(
        "top_n_actual_return", F.when(cash, F.lit(0.0)).otherwise(F.col("top_n_actual_return"))
    )


def regime_policy_summary(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    cash = F.col("selected_model") == CASH
    value = F.col("top_n_actual_return")
    return history.groupBy(*by).agg(
        F.countDistinct("date").alias("evaluated_dates"),
        F.count_if(~cash).alias("invested_dates"),
        F.count_if(cash).alias("cash_dates"),
        F.avg(value).alias("average_top_n_actual_return"),
        F.stddev_samp(value).alias("top_n_return_volatility"),
        (F.product(F.lit(1.0) + value) - 1.0).alias("cumulative_top_n_actual_return"),
    )
