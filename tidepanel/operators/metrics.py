"""Evaluation metrics by date, by model and by return series.

Every function takes any number of models, strategies or scenarios at once: ``by`` names
the columns that separate them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.dates import week_ending_friday
from tidepanel.functions.numeric import pearson, sharpe, truthy
from tidepanel.functions.ranking import top_n, with_ranks
from tidepanel.functions.rolling import rolling, so_far, timeline
from tidepanel.operators.selection import best_first, selection_turnover, top_n_flags
from tidepanel.session import checkpoint

PERIODS_PER_YEAR = 252
FLAT_DEVIATION = 1e-12


# --- rank information coefficient -------------------------------------------------


def rank_ic_by_date(
    predictions: DataFrame,
    score: str = "predicted_return",
    actual: str = "actual_return",
    by: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """Spearman correlation of score and outcome per date.

    Lenient: every date stays, with null where undefined.  Strict: dates with fewer than
    two rows or a constant side are dropped.
    """
    keys = [*by, "date"]
    paired = predictions.where(F.col(score).isNotNull() & F.col(actual).isNotNull()).select(
        *keys, "ticker", F.col(score).alias("__score"), F.col(actual).alias("__actual")
    )
    ranked = with_ranks(paired, keys, "__score", average="__score_rank")
    ranked = with_ranks(ranked, keys, "__actual", average="__actual_rank", counted=paired)
    daily = ranked.groupBy(*keys).agg(
        pearson("__score_rank", "__actual_rank").alias("rank_ic"),
        F.count(F.lit(1)).alias("stock_count"),
    )
    if strict:
        return daily.where((F.col("stock_count") >= 2) & F.col("rank_ic").isNotNull())
    dates = predictions.select(*keys).distinct()
    return dates.join(daily, keys, "left").withColumn(
        "stock_count", F.coalesce("stock_count", F.lit(0).cast("bigint"))
    )


def rank_ic_summary(
    predictions: DataFrame, scores: Sequence[str], actual: str = "actual_return"
) -> DataFrame:
    """Evaluated dates and mean rank IC per score column."""
    long = predictions.unpivot(["date", "ticker", actual], list(scores), "score", "__value")
    daily = rank_ic_by_date(long, "__value", actual, by=["score"], strict=True)
    return daily.groupBy("score").agg(
        F.count(F.lit(1)).alias("evaluated_dates"), F.avg("rank_ic").alias("average_rank_ic")
    )


# --- top-N outcomes ---------------------------------------------------------------


def _paired(predictions: DataFrame, score: str, actual: str) -> DataFrame:
    return predictions.where(F.col(score).isNotNull() & F.col(actual).isNotNull())


def top_n_outcome(
    predictions: DataFrame,
    score: str = "predicted_return",
    actual: str = "actual_return",
    n: int = 5,
    by: Sequence[str] = (),
) -> DataFrame:
    """Per date: number selected, share with a positive outcome and their mean outcome."""
    keys = [*by, "date"]
    chosen = top_n(_paired(predictions, score, actual), keys, best_first(score), n)
    daily = chosen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("selected_count"),
        F.avg((F.col(actual) > 0).cast("double")).alias("hit_rate"),
        F.avg(actual).alias("average_selected_return"),
    )
    dates = predictions.select(*keys).distinct()
    return dates.join(daily, keys, "left").withColumn(
        "selected_count", F.coalesce("selected_count", F.lit(0).cast("bigint"))
    )


def top_bottom_spread(
    predictions: DataFrame,
    score: str = "predicted_return",
    actual: str = "actual_return",
    n: int = 5,
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean outcome of the n best minus that of the n worst scores per date."""
    keys = [*by, "date"]
    paired = _paired(predictions, score, actual)
    best = top_n(paired, keys, best_first(score), n).groupBy(*keys).agg(F.avg(actual).alias("top_return"))
    worst = (
        top_n(paired, keys, [F.col(score).asc(), F.col("ticker").asc()], n)
        .groupBy(*keys)
        .agg(F.avg(actual).alias("bottom_return"))
    )
    dates = predictions.select(*keys).distinct()
    return (
        dates.join(best, keys, "left")
        .join(worst, keys, "left")
        .withColumn("top_minus_bottom_spread", F.col("top_return") - F.col("bottom_return"))
    )


def top_n_portfolio(
    predictions: DataFrame,
    score: str = "predicted_return",
    actual: str = "actual_return",
    n: int = 5,
    cost_rate: float = 0.001,
    by: Sequence[str] = (),
) -> DataFrame:
    """Equal-weight top-N return per date, after a cost on the names exchanged."""
    keys = [*by, "date"]
    flags = top_n_flags(predictions, score, n, keys)
    gross = flags.where("selected").groupBy(*keys).agg(
        F.avg(actual).alias("gross_top_n_return"), F.count("ticker").alias("selected_count")
    )
    turnover = selection_turnover(flags, by).select(*keys, "turnover")
    cost = F.coalesce("turnover", F.lit(0.0)) * F.lit(cost_rate)
    return (
        gross.join(turnover, keys, "left")
        .withColumn("transaction_cost", cost)
        .withColumn("after_cost_return", F.col("gross_top_n_return") - F.col("transaction_cost"))
    )


def hit_rate_by_overlap(
    predictions: DataFrame,
    score: str = "model_score",
    actual: str = "realized_forward_return",
    n: int = 5,
    by: Sequence[str] = ("model_family", "model_name"),
) -> DataFrame:
    """Per date with at least n rows: share of the predicted top n inside the realised top n."""
    keys = [*by, "date"]
    sizes = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    realised = top_n(predictions, keys, best_first(actual), n).select(*keys, "ticker", F.lit(1.0).alias("__hit"))
    predicted = top_n(predictions, keys, best_first(score), n)
    return (
        predicted.join(realised, [*keys, "ticker"], "left")
        .groupBy(*keys)
        .agg(
            F.avg(F.coalesce("__hit", F.lit(0.0))).alias("top5_hit_rate"),
            F.avg(actual).alias("top5_return"),
            F.count(F.lit(1)).alias("selected_count"),
        )
        .join(sizes.where(F.col("__rows") >= n).drop("__rows"), keys, "left_semi")
    )


# --- return series ----------------------------------------------------------------


def with_compounded_drawdown(
    series: DataFrame, value: str, by: Sequence[str] = (), floor_peak: float | None = None
) -> DataFrame:
    """Add ``nav`` and ``drawdown`` of compounded returns; missing returns are zero.

    The peak starts at the first value unless ``floor_peak`` sets a lower bound for it.
    """
    order = timeline(*by)
    growth = F.product(F.lit(1.0) + F.coalesce(F.col(value), F.lit(0.0))).over(so_far(order))
    peak = F.max("nav").over(so_far(order))
    if floor_peak is not None:
        peak = F.greatest(peak, F.lit(floor_peak))
    return series.withColumn("nav", growth).withColumn(
        "drawdown", F.try_divide(F.col("nav"), peak) - F.lit(1.0)
    )


def with_summed_drawdown(series: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``cumulative_sum`` and its distance from the running peak."""
    order = so_far(timeline(*by))
    return series.withColumn("cumulative_sum", F.sum(value).over(order)).withColumn(
        "sum_drawdown", F.col("cumulative_sum") - F.max("cumulative_sum").over(order)
    )


def sharpe_of(value: str, periods: int = PERIODS_PER_YEAR) -> Column:
    return sharpe(F.avg(value), F.stddev_samp(value), periods)


def diagnostic_sharpe(value: str) -> Column:
    """Unscaled mean over deviation; null for a practically constant series."""
    deviation = F.stddev_samp(value)
    return F.when(deviation > FLAT_DEVIATION, F.avg(value) / deviation)


def series_statistics(
    series: DataFrame, value: str, by: Sequence[str], periods: int = PERIODS_PER_YEAR
) -> DataFrame:
    """Mean, annualised Sharpe ratio and compounded drawdown per series."""
    return (
        with_compounded_drawdown(series, value, by)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("evaluated_dates"),
            F.avg(value).alias("average_return"),
            sharpe_of(value, periods).alias("sharpe_ratio"),
            F.min("drawdown").alias("max_drawdown"),
        )
    )


def portfolio_summary(returns: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """Summary of ``top_n_portfolio`` per series."""
    costs = returns.groupBy(*by).agg(
        F.avg("turnover").alias("average_turnover"),
        F.avg("transaction_cost").alias("average_transaction_cost"),
    )
    return series_statistics(returns, "after_cost_return", by).join(costs, list(by))


def rolling_sharpe(
    series: DataFrame, value: str, by: Sequence[str] = (), window: int = 60, periods: int = PERIODS_PER_YEAR
) -> DataFrame:
    """Rolling annualised Sharpe ratio with its one-standard-error band."""
    order = timeline(*by)
    ratio = F.try_divide(
        rolling(F.avg, value, order, window), rolling(F.stddev_samp, value, order, window)
    )
    scale = F.sqrt(F.lit(float(periods)))
    error = F.sqrt((F.lit(1.0) + F.lit(0.5) * F.col("__ratio") * F.col("__ratio")) / F.lit(float(window)))
    return (
        series.withColumn("__ratio", ratio)
        .withColumns({"rolling_sharpe": F.col("__ratio") * scale, "band": error * scale})
        .withColumns(
            {
                "band_lower": F.col("rolling_sharpe") - F.col("band"),
                "band_upper": F.col("rolling_sharpe") + F.col("band"),
            }
        )
        .drop("__ratio")
    )


# --- model and strategy tables ------------------------------------------------------


def model_summary(
    predictions: DataFrame,
    n: int = 5,
    cost_rate: float = 0.001,
    score: str = "predicted_return",
    actual: str = "actual_return",
) -> DataFrame:
    """Rank IC, hit rate, spread and portfolio statistics per model."""
    by = ["model_name"]
    daily = (
        rank_ic_by_date(predictions, score, actual, by)
        .join(top_n_outcome(predictions, score, actual, n, by).drop("selected_count"), ["model_name", "date"])
        .join(top_bottom_spread(predictions, score, actual, n, by), ["model_name", "date"])
    )
    signal = daily.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("evaluated_dates"),
        F.avg("rank_ic").alias("average_rank_ic"),
        F.avg("hit_rate").alias("average_hit_rate"),
        F.avg("top_minus_bottom_spread").alias("average_top_minus_bottom_spread"),
    )
    # One row per model and date, read by three aggregates: ranked and paired once.
    returns = checkpoint(top_n_portfolio(predictions, score, actual, n, cost_rate, by))
    gross = returns.groupBy("model_name").agg(F.avg("gross_top_n_return").alias("average_gross_top_n_return"))
    summary = portfolio_summary(returns).drop("evaluated_dates").withColumnRenamed(
        "average_return", "average_after_cost_return"
    )
    return signal.join(gross, "model_name").join(summary, "model_name")


def performance_summary(predictions: DataFrame, n: int = 5) -> DataFrame:
    """Strict rank IC and mean top-N outcome per model, kept when only one side exists."""
    ic = rank_ic_by_date(predictions, by=["model_name"], strict=True).groupBy("model_name").agg(
        F.count("date").alias("evaluated_dates"), F.avg("rank_ic").alias("average_rank_ic")
    )
    tops = (
        top_n_outcome(predictions, n=n, by=["model_name"])
        .where("selected_count > 0")
        .groupBy("model_name")
        .agg(
            F.avg("average_selected_return").alias("average_top_n_actual_return"),
            F.avg("selected_count").alias("average_selected_count"),
        )
    )
    return ic.join(tops, "model_name", "full_outer")


def scenario_summary(predictions: DataFrame, scenario: str, n: int = 5) -> DataFrame:
    """Per scenario, over dates with more than one distinct outcome: IC, hit rate, top-N return."""
    keys = [scenario, "date"]
    varied = (
        _paired(predictions, "predicted_return", "actual_return")
        .groupBy(*keys)
        .agg(F.min("actual_return").alias("lo"), F.max("actual_return").alias("hi"))
        .where("hi > lo")
        .select(*keys)
    )
    ic = rank_ic_by_date(predictions, by=[scenario]).select(*keys, "rank_ic")
    tops = top_n_outcome(predictions, n=n, by=[scenario])
    return (
        varied.join(ic, keys)
        .join(tops, keys)
        .groupBy(scenario)
        .agg(
            F.count(F.lit(1)).alias("evaluated_dates"),
            F.avg("rank_ic").alias("average_rank_ic"),
            F.avg("hit_rate").alias("average_hit_rate"),
            F.avg("average_selected_return").alias("average_top_n_return"),
        )
    )


def classification_by_date(
    predictions: DataFrame,
    selected: str = "selected_top_5",
    label: str = "actual_label",
    actual: str = "actual_return",
    by: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall and mean return of the selected names per date."""
    chosen = truthy(F.col(selected))
    hits = F.coalesce(F.sum(F.when(chosen, F.col(label))), F.lit(0))
    positives = F.coalesce(F.sum(label), F.lit(0))
    picked = F.count_if(chosen)
    return predictions.groupBy(*by, "date").agg(
        F.try_divide(hits, picked).alias("precision"),
        F.try_divide(hits, positives).alias("recall"),
        picked.alias("selected_count"),
        F.avg(F.when(chosen, F.col(actual))).alias("average_selected_return"),
    )


def classification_summary(predictions: DataFrame, model: str = "logistic_regression") -> DataFrame:
    daily = classification_by_date(predictions).withColumn("model_name", F.lit(model))
    stats = series_statistics(daily, "average_selected_return", ["model_name"]).withColumnRenamed(
        "average_return", "average_selected_return"
    )
    rates = daily.groupBy("model_name").agg(
        F.avg("precision").alias("average_precision"), F.avg("recall").alias("average_recall")
    )
    return stats.join(rates, "model_name")


def baseline_summary(
    returns: DataFrame, value: str = "portfolio_return", active: str = "active_return"
) -> DataFrame:
    extra = returns.groupBy("strategy").agg(
        F.avg(active).alias("average_active_return"),
        F.avg("selected_count").alias("average_selected_count"),
    )
    stats = series_statistics(returns, value, ["strategy"]).withColumnRenamed(
        "average_return", "average_portfolio_return"
    )
    return stats.join(extra, "strategy")


def model_comparison(predictions: DataFrame) -> DataFrame:
    """One row per family and model from harmonised predictions."""
    by = ["model_family", "model_name"]
    keys = [*by, "date"]
    score, actual = "model_score", "realized_forward_return"
    daily = hit_rate_by_overlap(predictions).join(
        rank_ic_by_date(predictions, score, actual, by).select(*keys, "rank_ic"), keys
    )
    return (
        with_summed_drawdown(daily, "top5_return", by)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("evaluated_dates"),
            F.avg("rank_ic").alias("average_rank_ic"),
            F.avg("top5_hit_rate").alias("average_top5_hit_rate"),
            F.avg("top5_return").alias("average_top5_return"),
            F.stddev_samp("top5_return").alias("return_volatility"),
            diagnostic_sharpe("top5_return").alias("diagnostic_sharpe"),
            F.min("sum_drawdown").alias("max_drawdown_of_sum"),
            F.sum("top5_return").alias("final_cumulative_sum"),
            F.avg("selected_count").alias("average_selected_count"),
        )
    )


def best_by(table: DataFrame, order: Sequence[Column]) -> DataFrame:
    return table.orderBy(*order).limit(1)


def best_model(summary: DataFrame) -> DataFrame:
    return best_by(
        summary,
        [
            F.col("average_rank_ic").desc_nulls_last(),
            F.col("average_after_cost_return").desc_nulls_last(),
            F.col("average_top_minus_bottom_spread").desc_nulls_last(),
            F.col("model_name").asc(),
        ],
    )


def best_training_candidate(
    periods: DataFrame, metric: str = "diagnostic_sharpe", name: str = "policy_name"
) -> DataFrame:
    """Best candidate by training rows only, so the holdout never picks."""
    training = periods.where((F.col("period") == "training") & F.col(metric).isNotNull())
    return best_by(training, [F.col(metric).desc(), F.col(name).asc()])


def feature_importance_summary(importance: DataFrame, n: int = 20) -> DataFrame:
    """Mean importance and window count per model and feature, best n per model."""
    means = importance.groupBy("model_name", "feature").agg(
        F.avg("importance").alias("average_importance"), F.count(F.lit(1)).alias("window_count")
    )
    return top_n(
        means, ["model_name"], [F.col("average_importance").desc(), F.col("feature").asc()], n
    )


def compare_summaries(*summaries: DataFrame) -> DataFrame:
    """Union of model summaries, best rank IC first."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), summaries).orderBy(
        F.col("average_rank_ic").desc_nulls_last(), "model_name"
    )


def rank_diagnostic(
    predictions: DataFrame, weights: DataFrame, modes: Sequence[str], model: str = "gradient_boosting"
) -> DataFrame:
    """Predicted against realised rank on the latest date, with portfolio membership.

    Falls back to all models when the requested one has no rows on that date.
    """
    latest = predictions.agg(F.max("date").alias("date"))
    rows = predictions.join(F.broadcast(latest), "date", "left_semi")
    wanted = F.max(F.col("model_name") == model)
    present = rows.groupBy("date").agg(wanted.alias("__present"))
    rows = rows.join(F.broadcast(present), "date").where(
        ~F.col("__present") | (F.col("model_name") == model)
    ).drop("__present")
    ranked = with_ranks(rows, ["date"], "predicted_return", ascending=False, ordinal="predicted_rank")
    ranked = with_ranks(
        ranked, ["date"], "actual_return", ascending=False, ordinal="realized_rank", counted=rows
    )
    gap = F.col("realized_rank") - F.col("predicted_rank")
    top = F.col("predicted_rank") <= 5
    flag = (
        F.when(top & (F.col("actual_return") < 0), "top_ranked_negative_return")
        .when(top & (F.col("realized_rank") <= 5), "top_ranked_hit")
        .when(top & (F.col("realized_rank") > 15), "top_ranked_miss")
        .otherwise("normal")
    )
    last_weights = weights.join(
        F.broadcast(weights.agg(F.max("date").alias("date"))), "date", "left_semi"
    )
    held = last_weights.groupBy("ticker").agg(
        *[F.max(F.col("optimization_mode") == m).alias(f"in_{m}_portfolio") for m in modes]
    )
    joined = ranked.join(held, "ticker", "left").withColumns(
        {
            "rank_gap": gap,
            "absolute_rank_gap": F.abs(gap),
            "diagnostic_flag": flag,
            **{f"in_{m}_portfolio": truthy(F.col(f"in_{m}_portfolio")) for m in modes},
        }
    )
    return joined.select(
        F.col("date").alias("signal_date"),
        "ticker",
        "model_name",
        "predicted_rank",
        "realized_rank",
        "rank_gap",
        "absolute_rank_gap",
        F.col("predicted_return").alias("model_score"),
        F.col("actual_return").alias("realized_forward_return"),
        "diagnostic_flag",
        *[f"in_{m}_portfolio" for m in modes],
    )


def horizon_disclosure(horizons: DataFrame) -> DataFrame:
    """Overlap of forecast periods from (forecast_horizon_days, evaluated_dates)."""
    days, dates = F.col("forecast_horizon_days"), F.col("evaluated_dates")
    whole = F.floor(dates / days).cast("bigint")
    return horizons.select(
        "forecast_horizon_days",
        F.concat(days.cast("string"), F.lit("d forecast period")).alias("period_label"),
        "evaluated_dates",
        whole.alias("approx_non_overlapping_periods"),
        (F.lit(1.0) - F.try_divide(whole, dates)).alias("overlap_share_estimate"),
        F.concat(
            F.format_number(dates, 0), F.lit(" evaluated dates (~"), F.format_number(whole, 0),
            F.lit(" non-overlapping "), days.cast("string"), F.lit("-day periods)."),
        ).alias("overlap_disclosure"),
    )


def weekly_extremes(series: DataFrame, drawdown: str, turnover: str, by: Sequence[str] = ()) -> DataFrame:
    """Worst drawdown and mean turnover per week ending Friday."""
    return series.groupBy(*by, week_ending_friday("date").alias("week_end")).agg(
        F.min(drawdown).alias("worst_drawdown"), F.avg(turnover).alias("mean_turnover")
    )


def mean_importance(importance: DataFrame, model: str, n: int = 20) -> DataFrame:
    return (
        importance.where(F.col("model_name") == model)
        .groupBy("feature")
        .agg(F.avg("importance").alias("average_importance"))
        .orderBy(F.col("average_importance").desc(), "feature")
        .limit(n)
    )
