"""Non-overlapping policy backtests, their summaries and paired comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.ranking import top_n
from tidepanel.functions.rolling import rolling, so_far, timeline
from tidepanel.operators.metrics import with_compounded_drawdown
from tidepanel.operators.portfolio import capped_step, turnover
from tidepanel.operators.regime import CASH, chosen_model
from tidepanel.operators.selection import best_first

SMALLEST_WEIGHT = 1e-12
HISTORY_SCHEMA = (
    "policy_name string, date date, market_regime string, selected_model string, "
    "before_cost_return double, total_cost double, after_cost_return double, "
    "portfolio_turnover double, total_weight double, selected_count bigint, "
    "target_exposure double, forced_exit_weight double, "
    "turnover_cap_breached_by_forced_exit boolean, settlement_compatible boolean"
)


def complete_dates(
    predictions: DataFrame, realised: str = "actual_return", at_least: int = 1
) -> DataFrame:
    """Dates with enough predictions on which every predicted name has a realised return."""
    return (
        predictions.groupBy("date")
        .agg(F.bool_and(F.col(realised).isNotNull()).alias("complete"), F.count(F.lit(1)).alias("names"))
        .where(F.col("complete") & (F.col("names") >= at_least))
        .select("date")
    )


def spacing_problems(dates: DataFrame, calendar: DataFrame, holding: int) -> DataFrame:
    """Scheduled dates closer than ``holding`` market dates to the one before."""
    positions = calendar.select("date").distinct().withColumn(
        "position", F.row_number().over(Window.orderBy("date")) - 1
    )
    gap = F.col("position") - F.lag("position").over(Window.orderBy("position"))
    return (
        dates.select("date").distinct().join(F.broadcast(positions), "date")
        .withColumn("gap", gap)
        .where(F.col("gap") < holding)
    )


def rebalance_schedule(
    regimes: DataFrame, dates: DataFrame, holding: int = 5, pre_spaced: bool = False
) -> DataFrame:
    """Regime dates with complete outcomes, every ``holding``-th unless already spaced."""
    joined = regimes.select("date", "market_regime").join(F.broadcast(dates), "date")
    if pre_spaced:
        clash = spacing_problems(joined, regimes, holding).limit(1).collect()
        if clash:
            raise ValueError(f"Scheduled dates overlap the holding period: {clash}")
        return joined
    position = F.row_number().over(Window.orderBy("date")) - 1
    return joined.withColumn("__position", position).where(F.col("__position") % holding == 0).drop("__position")


def policy_history(
    combined: DataFrame,
    schedule: DataFrame,
    policies: Mapping[str, Mapping[str, str]],
    realised: DataFrame | None = None,
    exposure_by_date: Mapping[str, DataFrame] | None = None,
    n: int = 8,
    holding: int = 5,
    settlement_lag: int = 2,
    exposure: float = 0.97,
    max_turnover: float = 0.25,
    commission: float = 0.001,
    slippage: float = 0.001,
    sell_tax: float = 0.001,
    legacy_sells: bool = False,
) -> DataFrame:
    """Backtest of every policy on the schedule, all policies in one plan.

    ``combined`` holds the predictions of all selectable models, ``realised`` the return
    of each (date, ticker) held to the next rebalance (default: the predictions' own
    outcome).  Targets and the returns of names a policy ever selects are relational; the
    grouped function only carries weights from one rebalance to the next.
    ``legacy_sells`` counts the bought weight as sold weight too when charging costs.
    """
    if realised is None:
        realised = combined.groupBy("date", "ticker").agg(F.max("actual_return").alias("realised"))
    plans = []
    for name, policy in policies.items():
        exposures = (exposure_by_date or {}).get(name)
        plan = schedule.select(
            F.lit(name).alias("policy_name"), "date", "market_regime", chosen_model(policy).alias("selected_model")
        )
        if exposures is None:
            plan = plan.withColumn("target_exposure", F.lit(float(exposure)))
        else:
            plan = plan.join(F.broadcast(exposures.select("date", "target_exposure")), "date", "left")
        plans.append(plan.select("policy_name", "date", "market_regime", "selected_model", "target_exposure"))
    steps = plans[0]
    for plan in plans[1:]:
        steps = steps.unionByName(plan)
    keys = ["policy_name", "date"]
    scored = combined.select("date", "ticker", F.col("model_name").alias("selected_model"), "predicted_return")
    candidates = scored.join(
        steps.where(F.col("selected_model") != CASH).select(*keys, "selected_model"),
        ["date", "selected_model"],
    ).where(F.col("predicted_return").isNotNull())
    targets = top_n(candidates, keys, best_first("predicted_return"), n).select(*keys, "ticker")
    first_use = targets.groupBy("policy_name", "ticker").agg(F.min("date").alias("__from"))
    scheduled = steps.select("date").distinct()
    outcomes = (
        realised.select("date", "ticker", "realised")
        .where(F.col("realised").isNotNull())
        .join(F.broadcast(scheduled), "date", "left_semi")
        .join(first_use, "ticker")
        .where(F.col("date") >= F.col("__from"))
        .select("policy_name", "date", "ticker", "realised")
    )
    marked = targets.withColumn("wanted", F.lit(True))
    names = outcomes.join(marked, [*keys, "ticker"], "full_outer").withColumn(
        "wanted", F.coalesce("wanted", F.lit(False))
    )
    path_input = steps.join(names, keys, "left")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, float] = {}
        rows = []
        for date, day in group.sort_values(["date", "ticker"]).groupby("date", sort=True):
            head = day.iloc[0]
            if pd.isna(head["target_exposure"]):
                raise ValueError(f"No exposure for {date}")
            day = day[day["ticker"].notna()]
            known = day[day["realised"].notna()]
            outcome = dict(zip(known["ticker"], known["realised"]))
            wanted_names = list(day.loc[day["wanted"].astype(bool), "ticker"])
            if head["selected_model"] != CASH:
                if len(wanted_names) < n:
                    raise ValueError(f"Only {len(wanted_names)} predictions of {head['selected_model']} on {date}")
                if not set(wanted_names) <= outcome.keys():
                    raise ValueError(f"Selected names lack outcomes on {date}")
            wanted = {t: head["target_exposure"] / n for t in wanted_names}
            forced = sum(w for t, w in held.items() if t not in outcome)
            carried = {t: w for t, w in held.items() if t in outcome}
            room = max(max_turnover - 0.5 * forced, 0.0)
            weights = (
                capped_step(carried, wanted, room, buffer=0.0, smallest=SMALLEST_WEIGHT)
                if room > 0
                else carried
            )
            moved = turnover(held, weights)
            all_names = sorted(held.keys() | weights.keys())
            buys = sum(max(weights.get(t, 0.0) - held.get(t, 0.0), 0.0) for t in all_names)
            sells = sum(max(held.get(t, 0.0) - weights.get(t, 0.0), 0.0) for t in all_names)
            if legacy_sells:
                sells = buys
            gross = sum(w * outcome[t] for t, w in sorted(weights.items()))
            cost = (buys + sells) * (commission + slippage) + sells * sell_tax
            rows.append(
                (
                    head["policy_name"], date, head["market_regime"], head["selected_model"],
                    gross, cost, gross - cost, moved, sum(weights.values()), len(weights),
                    head["target_exposure"], forced, moved > max_turnover + 1e-12,
                    holding >= settlement_lag,
                )
            )
            held = weights
        columns = [part.split()[0] for part in HISTORY_SCHEMA.split(", ")]
        return pd.DataFrame(rows, columns=columns)

    history = path_input.groupBy("policy_name").applyInPandas(walk, HISTORY_SCHEMA)
    order = so_far(timeline("policy_name"))
    return history.withColumn(
        "cumulative_after_cost_return", F.product(F.lit(1.0) + F.col("after_cost_return")).over(order) - 1.0
    )


def policy_summary(history: DataFrame, by: Sequence[str] = ("policy_name",)) -> DataFrame:
    """Compounded result, drawdown from at least the initial capital, turnover and exits."""
    by = list(by)
    tracked = with_compounded_drawdown(history, "after_cost_return", by, floor_peak=1.0)
    value = F.col("after_cost_return")
    measures = [
        F.countDistinct("date").alias("rebalance_dates"),
        F.avg(value).alias("average_after_cost_return"),
        F.stddev_samp(value).alias("return_volatility"),
        F.try_divide(F.avg(value), F.stddev_samp(value)).alias("diagnostic_sharpe"),
        F.avg("portfolio_turnover").alias("average_turnover"),
        F.max("portfolio_turnover").alias("maximum_turnover"),
        F.avg("target_exposure").alias("average_target_exposure"),
        F.min("target_exposure").alias("minimum_target_exposure"),
        F.count_if(F.col("forced_exit_weight") > 0).alias("forced_exit_dates"),
        F.max("forced_exit_weight").alias("maximum_forced_exit_weight"),
        (F.max_by("nav", "date") - 1.0).alias("final_cumulative_after_cost_return"),
        F.min("drawdown").alias("max_after_cost_drawdown"),
        F.bool_and("settlement_compatible").alias("settlement_compatible"),
    ]
    if "benchmark_return" in history.columns:
        order = so_far(timeline(*by))
        benchmark = F.product(F.lit(1.0) + F.col("benchmark_return")).over(order)
        tracked = (
            tracked.withColumn("__benchmark", benchmark)
            .withColumn("__active", F.col("nav") / F.col("__benchmark"))
            .withColumn(
                "__active_drawdown",
                F.col("__active") / F.greatest(F.max("__active").over(order), F.lit(1.0)) - 1.0,
            )
        )
        measures += [
            (F.max_by("__benchmark", "date") - 1.0).alias("final_cumulative_benchmark_return"),
            (F.max_by("__active", "date") - 1.0).alias("final_cumulative_active_return"),
            F.min("__active_drawdown").alias("max_active_drawdown"),
        ]
    return tracked.groupBy(*by).agg(*measures)


def paired_difference(
    baseline: DataFrame, challenger: DataFrame, value: str = "after_cost_return"
) -> DataFrame:
    """Difference of two series on their common dates."""
    left = baseline.select("date", F.col(value).alias(f"baseline_{value}"))
    right = challenger.select("date", F.col(value).alias(f"overlay_{value}"))
    return left.join(right, "date").withColumn(
        f"{value}_difference", F.col(f"overlay_{value}") - F.col(f"baseline_{value}")
    )


def _mixed(value):
    """Integer mixing in 32 bits, the same in any engine with 64-bit integers."""
    mask = F.lit(4294967295).cast("bigint")
    for _ in range(2):
        value = (value.bitwiseXOR(F.shiftright(value, 16)) * F.lit(73244475)).bitwiseAND(mask)
    return value.bitwiseXOR(F.shiftright(value, 16))


def block_bootstrap(
    values: DataFrame,
    value: str,
    by: Sequence[str] = (),
    block: int = 10,
    samples: int = 2000,
    seed: int = 42,
) -> DataFrame:
    """Mean and 95% interval of the mean from resampled contiguous blocks.

    ``values`` has one row per date and series.  Block starts come from an integer hash of
    (seed, sample, block), so the result does not depend on partitioning.  All series and
    samples are resampled in one join on the position inside the series.
    """
    by = list(by)
    known = values.where(F.col(value).isNotNull()).select(*by, "date", F.col(value).alias("__value"))
    if not by:
        known, by_inner = known.withColumn("__series", F.lit(1)), ["__series"]
    else:
        by_inner = by
    placed = known.withColumn(
        "__position", F.row_number().over(Window.partitionBy(*by_inner).orderBy("date")) - 1
    ).select(*by_inner, "__position", "__value")
    sizes = placed.groupBy(*by_inner).agg(
        F.count(F.lit(1)).alias("__n"), F.avg("__value").alias("mean_value")
    )
    width = F.least(F.lit(block).cast("bigint"), F.col("__n"))
    slots = (
        sizes.withColumn("__width", width)
        .withColumn("__sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        # One row per series becomes thousands of samples: spread them before each gets its slots.
        .repartition(*by_inner, "__sample")
        .withColumn("__slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
        .withColumn("__block", F.floor(F.col("__slot") / F.col("__width")).cast("bigint"))
    )
    key = F.lit(seed).cast("bigint") * 1000003 + F.col("__sample") * 10007 + F.col("__block")
    start = F.pmod(_mixed(key), F.col("__n") - F.col("__width") + 1)
    drawn = slots.withColumn("__position", start + F.col("__slot") % F.col("__width")).join(
        placed, [*by_inner, "__position"]
    )
    means = drawn.groupBy(*by_inner, "__sample").agg(F.avg("__value").alias("__mean"))
    interval = means.groupBy(*by_inner).agg(F.percentile("__mean", F.array(F.lit(0.025), F.lit(0.975))).alias("__ends"))
    return sizes.join(interval, by_inner).select(
        *by,
        F.col("__n").alias("sample_size"),
        "mean_value",
        F.col("__ends")[0].alias("bootstrap_95pct_lower"),
        F.col("__ends")[1].alias("bootstrap_95pct_upper"),
    )


def overlay_stability(
    paired: DataFrame, block: int = 5, samples: int = 2000, comparison: str = "overlay"
) -> DataFrame:
    """Bootstrap interval of a paired difference with positive dates and years."""
    value = "after_cost_return_difference"
    named = paired.withColumn("comparison", F.lit(comparison))
    yearly = named.groupBy("comparison", F.year("date").alias("year")).agg(
        F.avg(value).alias("mean"), F.count_if(F.col(value) > 0).alias("positive")
    )
    years = yearly.groupBy("comparison").agg(
        F.sum("positive").alias("positive_rebalance_dates"),
        F.count_if(F.col("mean") > 0).alias("positive_years"),
        F.count(F.lit(1)).alias("available_years"),
    )
    return (
        block_bootstrap(named, value, ["comparison"], block, samples)
        .join(years, "comparison")
        .withColumnsRenamed(
            {"sample_size": "paired_rebalance_dates", "mean_value": "mean_after_cost_return_difference"}
        )
    )


def candidate_stability(
    daily: DataFrame,
    challenger: str = "rank_ensemble",
    window: int = 126,
    block: int = 10,
    samples: int = 2000,
) -> DataFrame:
    """Challenger's rank IC against every other model on common dates."""
    best = daily.where(F.col("model_name") == challenger).select(
        "date", F.col("rank_ic").alias("challenger_ic")
    )
    paired = (
        daily.where(F.col("model_name") != challenger)
        .join(F.broadcast(best), "date")
        .select(
            F.col("model_name").alias("baseline_model"),
            "date",
            (F.col("challenger_ic") - F.col("rank_ic")).alias("difference"),
        )
    )
    mean = rolling(F.avg, "difference", timeline("baseline_model"), window)
    windows = (
        paired.withColumn("rolling_mean", mean)
        .groupBy("baseline_model")
        .agg(
            F.count(F.lit(1)).alias("paired_dates"),
            F.count_if(F.col("rolling_mean") > 0).alias("positive_rolling_windows"),
            F.count("rolling_mean").alias("available_rolling_windows"),
        )
    )
    interval = block_bootstrap(paired, "difference", ["baseline_model"], block, samples)
    return interval.join(windows, "baseline_model").select(
        F.lit(challenger).alias("challenger_model"),
        "baseline_model",
        "paired_dates",
        F.col("mean_value").alias("mean_rank_ic_difference"),
        "bootstrap_95pct_lower",
        "bootstrap_95pct_upper",
        F.lit(window).alias("rolling_window"),
        "positive_rolling_windows",
        "available_rolling_windows",
    )


def holdout_stability(
    histories: DataFrame, holdout_start: str, block: int = 3, samples: int = 2000
) -> DataFrame:
    """Bootstrap interval of the active return after the split date, per policy."""
    active = histories.where(F.col("date") >= F.lit(holdout_start).cast("date")).withColumn(
        "active_return", F.col("after_cost_return") - F.col("benchmark_return")
    )
    positive = active.groupBy("policy_name").agg(
        F.count_if(F.col("active_return") > 0).alias("positive_active_dates")
    )
    interval = block_bootstrap(active, "active_return", ["policy_name"], block, samples)
    return interval.join(positive, "policy_name").withColumnsRenamed(
        {"sample_size": "holdout_dates", "mean_value": "mean_active_return"}
    )


def yearly_summary(histories: DataFrame) -> DataFrame:
    """Compounded portfolio, benchmark and active return per policy and year."""
    by_year = histories.withColumn("year", F.year("date"))
    return policy_summary(by_year, ["policy_name", "year"]).select(
        "policy_name",
        "year",
        "rebalance_dates",
        F.col("final_cumulative_after_cost_return").alias("cumulative_portfolio_return"),
        F.col("final_cumulative_benchmark_return").alias("cumulative_benchmark_return"),
        F.col("final_cumulative_active_return").alias("cumulative_active_return"),
        F.col("max_after_cost_drawdown").alias("max_portfolio_drawdown"),
    )
