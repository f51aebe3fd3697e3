"""Report tables composed from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.backtest import backtest_returns, performance_summary, price_limit_execution
from tidepanel.operators.ensemble import with_ensembles
from tidepanel.operators.labels import forward_labels, forward_return
from tidepanel.operators.metrics import (
    baseline_summary,
    best_model,
    best_training_candidate,
    classification_summary,
    diagnostic_sharpe,
    feature_importance_summary,
    model_comparison,
    model_summary,
    scenario_summary,
    with_summed_drawdown,
)
from tidepanel.operators.policy import (
    complete_dates,
    overlay_stability,
    paired_difference,
    policy_history,
    policy_summary,
    rebalance_schedule,
)
from tidepanel.operators.portfolio import (
    CAP_TOLERANCE,
    MAX_ISSUER_GROUP_WEIGHT,
    concentration_flag,
    daily_concentration,
    mode_parameters,
    target_weights,
    turnover_limited_path,
)
from tidepanel.operators.regime import market_regimes
from tidepanel.operators.splits import with_period
from tidepanel.session import checkpoint
from tidepanel.sources.tables import harmonise_predictions

WEIGHT_DIGITS = 9


def on_common_dates(rows: DataFrame, dates: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(dates.select("date").distinct()), "date", "left_semi")


def benchmark_table(backtest: DataFrame, baseline: DataFrame) -> DataFrame:
    """Strategies after cost next to naive baselines on the same dates."""
    strategies = backtest.select(
        F.lit("ml_strategy").alias("comparison_type"),
        F.concat(F.lit("ml_"), F.col("optimization_mode"), F.lit("_"), F.col("execution_mode")).alias("strategy"),
        "date",
        F.col("after_cost_return").alias("__value"),
        "selected_count",
    )
    naive = on_common_dates(baseline, backtest).select(
        F.lit("naive_baseline").alias("comparison_type"),
        "strategy",
        "date",
        F.col("active_return").alias("__value"),
        "selected_count",
    )
    by = ["comparison_type", "strategy"]
    return (
        with_summed_drawdown(strategies.unionByName(naive), "__value", by)
        .groupBy(*by)
        .agg(
            F.countDistinct("date").alias("evaluated_dates"),
            F.avg("__value").alias("average_period_active_return"),
            F.stddev_samp("__value").alias("return_volatility"),
            diagnostic_sharpe("__value").alias("diagnostic_sharpe"),
            F.min("sum_drawdown").alias("max_active_drawdown"),
            F.max_by("cumulative_sum", "date").alias("final_cumulative_active_return_sum"),
            F.avg("selected_count").alias("average_selected_count"),
        )
        .withColumn(
            "cost_note",
            F.when(F.col("comparison_type") == "ml_strategy", "commission, slippage and liquidity penalty included")
            .otherwise("no transaction cost applied"),
        )
        .orderBy("comparison_type", F.col("diagnostic_sharpe").desc_nulls_last())
    )


def _on_latest_date(rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(rows.agg(F.max("date").alias("date"))), "date", "left_semi")


def concentration_summary(weights: DataFrame) -> DataFrame:
    """Concentration of the latest date with the names of the largest issuer group."""
    latest = _on_latest_date(weights)
    daily = daily_concentration(latest).withColumn("concentration_flag", concentration_flag())
    names = latest.groupBy("optimization_mode", F.col("issuer_group").alias("top_issuer_group")).agg(
        F.concat_ws(", ", F.sort_array(F.collect_list("ticker"))).alias("top_issuer_group_tickers")
    )
    return daily.join(names, ["optimization_mode", "top_issuer_group"], "left").withColumnRenamed(
        "date", "signal_date"
    )


def bound_diagnostic(weights: DataFrame) -> DataFrame:
    """How often each mode sits at the single-name cap."""
    latest = {
        "latest_holding_count": "holding_count",
        "latest_positions_at_cap": "positions_at_cap",
        "latest_single_name_cap_hit_share": "single_name_cap_hit_share",
        "latest_all_positions_at_cap": "all_positions_at_cap",
        "latest_hhi": "hhi",
        "latest_effective_position_count": "effective_position_count",
    }
    return daily_concentration(weights).groupBy("optimization_mode").agg(
        F.max("date").alias("signal_date"),
        *[F.max_by(column, "date").alias(name) for name, column in latest.items()],
        F.avg("single_name_cap_hit_share").alias("mean_single_name_cap_hit_share"),
        F.avg(F.col("all_positions_at_cap").cast("double")).alias("share_of_dates_all_positions_at_cap"),
        F.max("single_name_cap_hit_share").alias("max_single_name_cap_hit_share"),
        F.avg("hhi").alias("mean_hhi"),
        F.avg("effective_position_count").alias("mean_effective_position_count"),
    )


def issuer_exposure(weights: DataFrame) -> DataFrame:
    """Exposure per issuer group on the latest date, names by weight."""
    exposure = F.sum("weight")
    # Weights equal up to rounding noise are listed by ticker.
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.round("weight", WEIGHT_DIGITS)).alias("w"), "ticker"))
    )
    return (
        _on_latest_date(weights)
        .groupBy(F.col("date").alias("signal_date"), "optimization_mode", "issuer_group")
        .agg(
            exposure.alias("issuer_group_weight"),
            F.count(F.lit(1)).alias("position_count"),
            F.concat_ws(", ", F.transform(ordered, lambda x: x["ticker"])).alias("tickers"),
            F.max("weight").alias("max_single_name_weight_in_group"),
            F.try_divide(F.sum(F.col("weight") * F.col("actual_return")), exposure).alias(
                "weighted_realized_forward_return"
            ),
            F.when(exposure >= MAX_ISSUER_GROUP_WEIGHT - CAP_TOLERANCE, "issuer_group_at_40pct_cap")
            .otherwise("normal")
            .alias("exposure_flag"),
        )
    )


def comparison_report(families: Mapping[str, DataFrame]) -> DataFrame:
    """Model comparison over prediction tables of several families."""
    frames = [harmonise_predictions(frame, family) for family, frame in families.items()]
    return model_comparison(reduce(DataFrame.unionByName, frames)).orderBy(
        F.col("diagnostic_sharpe").desc_nulls_last(), F.col("average_rank_ic").desc_nulls_last()
    )


def model_report(
    regression: DataFrame,
    classification: DataFrame | None = None,
    baselines: DataFrame | None = None,
    importance: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Tables over whichever inputs exist."""
    summary = model_summary(regression)
    tables = {"regression": summary, "best_regression": best_model(summary)}
    if classification is not None:
        tables["classification"] = classification_summary(classification)
    if baselines is not None:
        tables["baselines"] = baseline_summary(baselines)
    if importance is not None:
        tables["importance"] = feature_importance_summary(importance)
    return tables


def scenario_report(
    predictions: DataFrame, scenario: str, context: DataFrame, reference: DataFrame
) -> DataFrame:
    """Signal and price-limit backtest summaries per scenario, all scenarios in one plan.

    ``predictions`` carry the scenario column, ``context`` adds issuer group and sector by
    ticker, ``reference`` comes from ``backtest.execution_reference``.
    """
    signal = scenario_summary(predictions, scenario)
    rows = mode_parameters(
        predictions.select(
            F.col(scenario).cast("string").alias("optimization_mode"), "date", "ticker", "predicted_return"
        ).join(context.select("ticker", "issuer_group", "sector"), "ticker")
    )
    weights = checkpoint(
        turnover_limited_path(target_weights(rows), rows.select("optimization_mode", "date"))
    )
    limited = backtest_returns(price_limit_execution(weights, reference))
    result = performance_summary(limited, ["optimization_mode"]).withColumnRenamed("optimization_mode", scenario)
    return signal.withColumn(scenario, F.col(scenario).cast("string")).join(result, scenario)


def paper_inputs(predictions: DataFrame, bars: DataFrame, horizon: int = 10) -> tuple[DataFrame, DataFrame]:
    """Predictions with the absolute forward return of their horizon, and its mean per date."""
    name = forward_return(horizon)
    absolute = forward_labels(bars, [horizon]).select("date", "ticker", F.col(name).alias("portfolio_return"))
    benchmark = absolute.groupBy("date").agg(F.avg("portfolio_return").alias("benchmark_return"))
    return predictions.join(absolute, ["date", "ticker"], "left"), benchmark


def paper_histories(
    prepared: DataFrame,
    benchmark: DataFrame,
    bars: DataFrame,
    policies: Mapping[str, Mapping[str, str]],
    members: Sequence[str],
    n: int = 8,
    horizon: int = 10,
) -> DataFrame:
    """Histories of signals already ``horizon`` dates apart, next to the benchmark.

    Absolute returns are earned, relative returns only rank the members; the ensemble looks
    back over 13 signals, whose labels are known by the next one.
    """
    combined = checkpoint(with_ensembles(prepared, members, window=13, lag=0))
    regimes = checkpoint(market_regimes(bars))
    dates = complete_dates(prepared, "portfolio_return", at_least=n)
    schedule = rebalance_schedule(regimes, dates, horizon, pre_spaced=True)
    realised = prepared.groupBy("date", "ticker").agg(F.max("portfolio_return").alias("realised"))
    history = policy_history(combined, schedule, policies, realised, n=n, holding=horizon)
    return history.join(F.broadcast(benchmark), "date", "left")


def paper_periods(histories: DataFrame, holdout_start: str) -> DataFrame:
    return policy_summary(with_period(histories, holdout_start), ["policy_name", "period"])


def walk_forward_choice(histories: DataFrame, holdout_start: str) -> dict[str, DataFrame]:
    """Candidates by period, the one chosen on training dates and its holdout result."""
    marked = with_period(histories, holdout_start)
    enough = marked.groupBy("policy_name", "period").count().where("count >= 2").select("policy_name", "period")
    periods = policy_summary(marked.join(enough, ["policy_name", "period"], "left_semi"), ["policy_name", "period"])
    chosen = best_training_candidate(periods)
    holdout = periods.where("period = 'holdout'").join(chosen.select("policy_name"), "policy_name", "left_semi")
    return {"periods": periods, "chosen": chosen, "holdout": holdout}


def overlay_comparison(histories: DataFrame, baseline: str, overlay: str) -> DataFrame:
    """Paired stability of an overlay against the baseline policy."""
    paired = paired_difference(
        histories.where(F.col("policy_name") == baseline), histories.where(F.col("policy_name") == overlay)
    )
    return overlay_stability(paired)
