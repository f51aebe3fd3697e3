"""Rank ensembles of several models and daily candidate metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.dates import date_index
from tidepanel.functions.ranking import top_n, with_ranks
from tidepanel.functions.rolling import rolling, timeline
from tidepanel.operators.metrics import rank_ic_by_date
from tidepanel.operators.selection import best_first

MEMBERS = ("gradient_boosting", "random_forest")
STATIC = "rank_ensemble"
ROLLING = "rolling_rank_ensemble"
PREDICTION_COLUMNS = ["date", "ticker", "model_name", "predicted_return", "actual_return"]


def _members(predictions: DataFrame, members: Sequence[str]) -> DataFrame:
    return predictions.where(F.col("model_name").isin(list(members))).select(*PREDICTION_COLUMNS)


def ensemble_problems(predictions: DataFrame, members: Sequence[str] = MEMBERS) -> DataFrame:
    """Keys that lack a member or whose members disagree on the outcome."""
    low, high = F.col("low"), F.col("high")
    return (
        _members(predictions, members)
        .groupBy("date", "ticker")
        .agg(
            F.countDistinct("model_name").alias("models"),
            F.min("actual_return").alias("low"),
            F.max("actual_return").alias("high"),
        )
        .withColumn(
            "problem",
            F.when(F.col("models") != len(members), "missing_member").when(
                F.abs(high - low) > 1e-12 + 1e-10 * F.abs(high), "outcome_mismatch"
            ),
        )
        .where("problem IS NOT NULL")
        .select("date", "ticker", "problem")
    )


def _member_rank_scores(predictions: DataFrame, members: Sequence[str]) -> DataFrame:
    """Per member row: ordinal rank, names per date and 1 - rank / (names + 1)."""
    keys = ["model_name", "date"]
    ranked = with_ranks(
        _members(predictions, members), keys, "predicted_return", ascending=False, ordinal="member_rank"
    )
    counts = ranked.groupBy(*keys).agg(F.count("member_rank").alias("names"))
    return ranked.join(counts, keys).withColumn(
        "rank_score", F.lit(1.0) - F.col("member_rank") / (F.col("names") + 1)
    )


def rank_ensemble(predictions: DataFrame, members: Sequence[str] = MEMBERS) -> DataFrame:
    """One minus the mean member rank over names plus one."""
    ranked = _member_rank_scores(predictions, members)
    combined = ranked.groupBy("date", "ticker").agg(
        F.avg("member_rank").alias("mean_rank"),
        F.max("names").alias("names"),
        F.min_by("actual_return", "model_name").alias("actual_return"),
    )
    return combined.select(
        "date",
        "ticker",
        F.lit(STATIC).alias("model_name"),
        (F.lit(1.0) - F.col("mean_rank") / (F.col("names") + 1)).alias("predicted_return"),
        "actual_return",
    )


def rolling_member_weights(
    predictions: DataFrame,
    members: Sequence[str] = MEMBERS,
    window: int = 126,
    lag: int = 10,
) -> DataFrame:
    """(date, model_name, weight) from rank ICs known ``lag`` dates earlier.

    A member's weight follows its mean IC over the window, cut at zero; without any
    positive mean all members weigh the same.
    """
    rows = _members(predictions, members)
    ic = rank_ic_by_date(rows, by=["model_name"]).select("model_name", "date", "rank_ic")
    models = F.explode(F.array(*[F.lit(m) for m in members])).alias("model_name")
    grid = date_index(rows).select("date", "date_idx", models)
    known = Window.partitionBy("model_name").orderBy("date_idx").rowsBetween(-(lag + window), -(lag + 1))
    skill = (
        grid.join(ic, ["model_name", "date"], "left")
        .withColumn("skill", F.greatest(F.coalesce(F.avg("rank_ic").over(known), F.lit(0.0)), F.lit(0.0)))
    )
    total = F.sum("skill").over(Window.partitionBy("date"))
    weight = F.when(total > 0, F.col("skill") / total).otherwise(F.lit(1.0 / len(members)))
    return skill.select("date", "model_name", weight.alias("weight"))


def rolling_rank_ensemble(
    predictions: DataFrame,
    members: Sequence[str] = MEMBERS,
    window: int = 126,
    lag: int = 10,
) -> DataFrame:
    """Member rank scores blended with past-skill weights, which are kept as columns."""
    weights = rolling_member_weights(predictions, members, window, lag)
    scored = _member_rank_scores(predictions, members).join(weights, ["date", "model_name"])
    kept = [
        F.max(F.when(F.col("model_name") == m, F.col("weight"))).alias(f"weight_{m}") for m in members
    ]
    blended = scored.groupBy("date", "ticker").agg(
        F.sum(F.col("rank_score") * F.col("weight")).alias("predicted_return"),
        F.min_by("actual_return", "model_name").alias("actual_return"),
        *kept,
    )
    return blended.withColumn("model_name", F.lit(ROLLING))


def with_ensembles(
    predictions: DataFrame,
    members: Sequence[str] = MEMBERS,
    window: int = 126,
    lag: int = 10,
) -> DataFrame:
    """Member predictions together with both ensembles."""
    frames = [
        predictions.select(*PREDICTION_COLUMNS),
        rank_ensemble(predictions, members).select(*PREDICTION_COLUMNS),
        rolling_rank_ensemble(predictions, members, window, lag).select(*PREDICTION_COLUMNS),
    ]
    return reduce(DataFrame.unionByName, frames)


def daily_candidate_metrics(combined: DataFrame, n: int = 8) -> DataFrame:
    """Rank IC and mean top-n outcome per model and date with at least two outcomes."""
    keys = ["model_name", "date"]
    varied = (
        combined.groupBy(*keys)
        .agg(F.min("actual_return").alias("lo"), F.max("actual_return").alias("hi"))
        .where("hi > lo")
        .select(*keys)
    )
    ic = rank_ic_by_date(combined, by=["model_name"]).select(*keys, "rank_ic")
    tops = (
        top_n(combined.where(F.col("predicted_return").isNotNull()), keys, best_first("predicted_return"), n)
        .groupBy(*keys)
        .agg(F.avg("actual_return").alias("top_n_actual_return"))
    )
    return varied.join(ic, keys).join(tops, keys, "left")


def candidate_summary(daily: DataFrame) -> DataFrame:
    return daily.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("evaluated_dates"),
        F.avg("rank_ic").alias("average_rank_ic"),
        F.avg("top_n_actual_return").alias("average_top_n_actual_return"),
    )


def health_history(daily: DataFrame, window: int = 126) -> DataFrame:
    """Rolling mean IC, mean top-n outcome and IC deviation per model."""
    series = timeline("model_name")

    def over(aggregate, column: str) -> Column:
        return rolling(aggregate, column, series, window)

    return daily.withColumns(
        {
            "rolling_rank_ic": over(F.avg, "rank_ic"),
            "rolling_top_n_actual_return": over(F.avg, "top_n_actual_return"),
            "rolling_rank_ic_volatility": over(F.stddev_samp, "rank_ic"),
        }
    )


def latest_health(history: DataFrame, minimum_rank_ic: float = 0.005) -> DataFrame:
    """Health status per model from its latest row with a full window."""
    known = F.when(F.col("rolling_rank_ic").isNotNull(), F.col("date"))
    columns = ["rolling_rank_ic", "rolling_top_n_actual_return", "rolling_rank_ic_volatility"]
    latest = history.groupBy("model_name").agg(
        F.max(known).alias("latest_health_date"),
        *[F.max_by(c, known).alias(f"latest_{c}") for c in columns],
    )
    ic = F.col("latest_rolling_rank_ic")
    status = (
        F.when(F.col("latest_health_date").isNull(), "insufficient_history")
        .when(ic <= 0, "degraded")
        .when(ic < minimum_rank_ic, "weak")
        .otherwise("positive")
    )
    return latest.withColumn("health_status", status)
