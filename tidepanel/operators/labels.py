"""Forward returns, benchmarks and relative labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.numeric import change
from tidepanel.functions.ranking import with_ranks
from tidepanel.functions.rolling import timeline

HORIZONS = (1, 5, 10)


def forward_return(horizon: int) -> str:
    return f"forward_return_{horizon}d"


def relative_return(horizon: int) -> str:
    return f"forward_relative_return_{horizon}d"


def forward_labels(bars: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Return from each row to the row ``horizon`` rows later of the same ticker."""
    series = timeline("ticker")
    price = F.col("adjusted_close")
    return bars.select(
        "date",
        "ticker",
        *[change(F.lead(price, h).over(series), price).alias(forward_return(h)) for h in horizons],
    )


def index_forward_returns(index_prices: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Forward returns of one benchmark series with one row per date."""
    series = timeline()
    price = F.col("adjusted_close")
    return index_prices.select(
        "date",
        *[change(F.lead(price, h).over(series), price).alias(f"benchmark_{forward_return(h)}") for h in horizons],
    )


def equal_weight_forward_returns(labels: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    return labels.groupBy("date").agg(
        *[F.avg(forward_return(h)).alias(f"benchmark_{forward_return(h)}") for h in horizons]
    )


def relative_to_benchmark(
    labels: DataFrame, benchmark: DataFrame, horizons: Sequence[int] = HORIZONS
) -> DataFrame:
    """Excess over a series with one row per date."""
    joined = labels.join(F.broadcast(benchmark), "date", "left")
    return joined.withColumns(
        {
            relative_return(h): F.col(forward_return(h)) - F.col(f"benchmark_{forward_return(h)}")
            for h in horizons
        }
    )


def leave_one_out_labels(labels: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Excess over the mean of all *other* names of the date; null for a lone name."""
    sums = labels.groupBy("date").agg(
        *[F.sum(forward_return(h)).alias(f"__sum_{h}") for h in horizons],
        *[F.count(forward_return(h)).alias(f"__count_{h}") for h in horizons],
    )
    joined = labels.join(F.broadcast(sums), "date", "left")
    others = {
        f"benchmark_{forward_return(h)}": F.try_divide(
            F.col(f"__sum_{h}") - F.col(forward_return(h)), F.col(f"__count_{h}") - 1
        )
        for h in horizons
    }
    return (
        joined.withColumns(others)
        .withColumns(
            {
                relative_return(h): F.col(forward_return(h)) - F.col(f"benchmark_{forward_return(h)}")
                for h in horizons
            }
        )
        .select(
            "date",
            "ticker",
            *[forward_return(h) for h in horizons],
            *[f"benchmark_{forward_return(h)}" for h in horizons],
            *[relative_return(h) for h in horizons],
        )
    )


def top_quintile_label(
    rows: DataFrame,
    target: str,
    label: str = "top_quintile_label",
    fraction: float = 0.20,
) -> DataFrame:
    """1 for the best ``fraction`` of known targets of a date (at least one), 0 below, null unknown."""
    known = rows.groupBy("date").agg(F.count(target).alias("__known"))
    ranked = with_ranks(rows, ["date"], target, ascending=False, ordinal="__place")
    limit = F.greatest(F.lit(1), F.ceil(F.col("__known") * F.lit(fraction)))
    return (
        ranked.join(F.broadcast(known), "date", "left")
        .withColumn(
            label,
            F.when(F.col(target).isNotNull(), (F.col("__place") <= limit).cast("int")),
        )
        .drop("__place", "__known")
    )


def modelling_dataset(features: DataFrame, labels: DataFrame, target: str, name: str = "target") -> DataFrame:
    """Features with one label column; keys stay unique when both inputs are."""
    chosen = labels.select("date", "ticker", F.col(target).alias(name))
    return features.join(chosen, ["date", "ticker"], "left")


def key_violations(frame: DataFrame) -> DataFrame:
    return frame.groupBy("date", "ticker").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def known_targets(dataset: DataFrame, target: str = "target") -> DataFrame:
    return dataset.where(F.col(target).isNotNull())


def unknown_targets(dataset: DataFrame, target: str = "target") -> DataFrame:
    return dataset.where(F.col(target).isNull())


