"""Scores, top-N selections and naive baseline portfolios."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.ranking import top_n, with_ranks

# Baseline strategies, their score and number of names.
BASELINES = {
    "top5_momentum": ("momentum_score", 5),
    "top5_reversal": ("reversal_score", 5),
    "low_volatility_top10": ("low_volatility_score", 10),
}


def _optional(frame: DataFrame, name: str, sign: int = 1) -> Column:
    if name not in frame.columns:
        return F.lit(None).cast("double")
    return F.col(name) if sign > 0 else -F.col(name)


def add_portfolio_scores(panel: DataFrame) -> DataFrame:
    """Momentum, reversal, low-volatility and equal scores; a missing source gives null."""
    return panel.withColumns(
        {
            "momentum_score": _optional(panel, "return_10d"),
            "reversal_score": _optional(panel, "distance_from_20d_high", -1),
            "low_volatility_score": _optional(panel, "rolling_vol_20d", -1),
            "equal_score": F.lit(0.0),
        }
    )


def best_first(score: str) -> list[Column]:
    return [F.col(score).desc(), F.col("ticker").asc()]


def select_top_n(
    panel: DataFrame, score: str, n: int, strategy: str, target: str, by: Sequence[str] = ("date",)
) -> DataFrame:
    """Equal-weight positions in the n best names with a known score and target."""
    known = panel.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    chosen = top_n(known, by, best_first(score), n, rank="position")
    # At most n rows per group are left here.
    count = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return chosen.withColumns({"strategy": F.lit(strategy), "weight": F.lit(1.0) / count}).drop("position")


def select_all(panel: DataFrame, target: str, strategy: str = "equal_weight_all") -> DataFrame:
    """Every name with a known target, equally weighted per date."""
    known = panel.where(F.col(target).isNotNull())
    counts = known.groupBy("date").agg(F.count(F.lit(1)).alias("__count"))
    return (
        known.join(F.broadcast(counts), "date")
        .withColumns({"strategy": F.lit(strategy), "weight": F.lit(1.0) / F.col("__count")})
        .drop("__count")
    )


def baseline_positions(panel: DataFrame, target: str = "forward_return_5d") -> DataFrame:
    """Equal weight plus the naive score portfolios whose score column exists."""
    scored = add_portfolio_scores(panel)
    columns = ["date", "ticker", "strategy", "weight"]
    carried = [c for c in panel.columns if c not in ("date", "ticker") and "return" in c]
    frames = [select_all(scored, target).select(*columns, *carried)]
    for strategy, (score, n) in BASELINES.items():
        frames.append(select_top_n(scored, score, n, strategy, target).select(*columns, *carried))
    return reduce(DataFrame.unionByName, frames)


def portfolio_returns(
    positions: DataFrame,
    stock_return: str = "forward_return_5d",
    benchmark_return: str = "benchmark_forward_return_5d",
    active_return: str = "forward_relative_return_5d",
) -> DataFrame:
    """Weighted stock, benchmark and active return per date and strategy."""

    def weighted(name: str) -> Column:
        return F.coalesce(F.sum(F.col("weight") * F.col(name)), F.lit(0.0))

    return positions.groupBy("date", "strategy").agg(
        weighted(stock_return).alias("portfolio_return"),
        weighted(benchmark_return).alias("benchmark_return"),
        weighted(active_return).alias("active_return"),
        F.count(F.lit(1)).alias("selected_count"),
    )


def returns_versus_index(returns: DataFrame, index_returns: DataFrame, column: str) -> DataFrame:
    """Baseline returns with one benchmark row per date attached."""
    return returns.join(F.broadcast(index_returns), "date", "left").withColumn(
        "active_return_vs_index", F.col("portfolio_return") - F.col(column)
    )


def top_n_flags(
    predictions: DataFrame, score: str = "predicted_return", n: int = 5, by: Sequence[str] = ("date",)
) -> DataFrame:
    """Descending rank per group and whether it is within n.

    Ties go to the smaller ticker; the order of input rows has no meaning here.
    """
    ranked = with_ranks(predictions, by, score, ascending=False, ordinal="prediction_rank")
    return ranked.withColumn("selected", F.coalesce(F.col("prediction_rank") <= n, F.lit(False)))


def selection_turnover(selections: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Names added and removed since the previous date, relative to the larger selection.

    Works on counts: a selected name that was also selected on the previous date of its
    group is neither added nor removed, so sets are never collected.
    """
    by = list(by)
    dates = selections.groupBy(*by, "date").agg(
        F.count_if("selected").alias("selected_count")
    )
    order = Window.partitionBy(*by).orderBy("date")
    dates = dates.withColumns(
        {
            "__previous_date": F.lag("date").over(order),
            "__previous_count": F.lag("selected_count").over(order),
        }
    )
    chosen = selections.where("selected").select(*by, "date", "ticker").distinct()
    previous = dates.select(*by, "date", F.col("__previous_date"))
    kept = (
        chosen.join(previous, [*by, "date"])
        .join(
            chosen.withColumnRenamed("date", "__previous_date"),
            [*by, "__previous_date", "ticker"],
            "left_semi",
        )
        .groupBy(*by, "date")
        .agg(F.count(F.lit(1)).alias("__kept"))
    )
    moved = (
        F.col("selected_count") + F.col("__previous_count") - 2 * F.coalesce("__kept", F.lit(0))
    )
    larger = F.greatest("selected_count", "__previous_count", F.lit(1))
    return dates.join(kept, [*by, "date"], "left").select(
        *by,
        "date",
        "selected_count",
        F.when(F.col("__previous_count").isNotNull(), moved / larger).alias("turnover"),
    )


def latest_ranking(predictions: DataFrame, score: str = "predicted_return") -> DataFrame:
    """Names of the latest date by score."""
    latest = predictions.agg(F.max("date").alias("date"))
    rows = predictions.join(F.broadcast(latest), "date", "left_semi")
    return with_ranks(rows, ["date"], score, ascending=False, ordinal="predicted_rank")


def latest_weights(weights: DataFrame, preferred: str = "normal") -> DataFrame:
    """Weights of the latest date, of the preferred mode when it exists."""
    latest = weights.agg(
        F.max("date").alias("date"),
        F.max(F.col("optimization_mode") == preferred).alias("__has_preferred"),
    )
    return (
        weights.join(F.broadcast(latest), "date")
        .where(~F.col("__has_preferred") | (F.col("optimization_mode") == preferred))
        .drop("__has_preferred")
    )
