"""The combined feature job and the modelling tables built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.features import (
    add_basic_features,
    add_liquidity_series,
    add_momentum,
    add_price_limits,
    add_traded_value_rank,
    winsorised,
)
from tidepanel.operators.herding import daily_herding
from tidepanel.operators.labels import (
    forward_labels,
    known_targets,
    leave_one_out_labels,
    modelling_dataset,
    relative_return,
)
from tidepanel.session import checkpoint


def time_features(bars: DataFrame) -> DataFrame:
    """Everything computed along each ticker, in one exchange by ticker."""
    return add_price_limits(add_momentum(add_basic_features(bars)))


def combined_features(bars: DataFrame, pairs: str = "complete") -> DataFrame:
    """Basic, momentum, price-limit, liquidity and herding features of every bar.

    ``pairs`` says which names enter the correlation of the herding index; see
    ``average_pairwise_correlation``.

    The cross-sections read the time features several times over, so those are
    checkpointed once instead of being windowed again for each of them.
    """
    timed = checkpoint(add_liquidity_series(time_features(bars)))
    clipped = winsorised(timed, "amihud_illiquidity_raw", "amihud_illiquidity")
    herding = daily_herding(timed, pairs=pairs)
    return add_traded_value_rank(clipped, timed).join(F.broadcast(herding), "date", "left")


def standard_labels(bars: DataFrame) -> DataFrame:
    return leave_one_out_labels(forward_labels(bars))


def model_inputs(bars: DataFrame, horizon: int = 5, pairs: str = "complete") -> DataFrame:
    """Combined features with the relative forward return as target."""
    return modelling_dataset(combined_features(bars, pairs), standard_labels(bars), relative_return(horizon))


def baseline_dataset(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """Rows with a known target."""
    return known_targets(model_inputs(bars, horizon))


def score_predictions(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """Two model-free prediction sets, momentum and reversal, against the relative return.

    They take the place of fitted models where exact results are compared.
    """
    scored = add_momentum(bars).select(
        "date",
        "ticker",
        F.col("return_10d").alias("momentum"),
        (-F.col("distance_from_20d_high")).alias("reversal"),
    )
    outcome = standard_labels(bars).select(
        "date", "ticker", F.col(relative_return(horizon)).alias("actual_return")
    )
    return (
        scored.join(outcome, ["date", "ticker"])
        .unpivot(["date", "ticker", "actual_return"], ["momentum", "reversal"], "model_name", "predicted_return")
        .where("predicted_return IS NOT NULL AND actual_return IS NOT NULL")
    )
