"""Features along each ticker's own history and simple cross-sections of one date.

The time features share one window specification, so Spark plans one exchange and one
sort by (ticker, date) for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.numeric import (
    NORMAL_DAILY_LIMIT,
    ceiling_price,
    change,
    floor_price,
    truthy,
)
from tidepanel.functions.ranking import group_quantiles, with_ranks
from tidepanel.functions.rolling import (
    fill_forward,
    rolling,
    so_far,
    timeline,
    with_run_lengths,
    z_score,
)
from tidepanel.session import checkpoint

PERIODS_PER_YEAR = 252
SERIES = ("ticker",)
MOMENTUM_ROWS = (1, 3, 5, 10, 20, 60)


def add_returns(bars: DataFrame) -> DataFrame:
    series = timeline(*SERIES)
    price = F.col("adjusted_close")
    previous = F.lag(price, 1).over(series)
    return bars.withColumns(
        {
            "simple_return_1d": change(price, previous),
            "log_return_1d": F.log(F.try_divide(price, previous)),
            "rolling_return_5d": change(price, F.lag(price, 5).over(series)),
            "rolling_return_20d": change(price, F.lag(price, 20).over(series)),
        }
    )


def add_volatility(panel: DataFrame, window: int = 20) -> DataFrame:
    """Annualised rolling deviation; needs ``simple_return_1d``."""
    spread = rolling(F.stddev_samp, "simple_return_1d", timeline(*SERIES), window)
    return panel.withColumn("rolling_vol_20d", spread * F.sqrt(F.lit(float(PERIODS_PER_YEAR))))


def add_drawdown(panel: DataFrame) -> DataFrame:
    peak = F.max("adjusted_close").over(so_far(timeline(*SERIES)))
    return panel.withColumn("drawdown", change("adjusted_close", peak))


def add_average_volume(panel: DataFrame, window: int = 20) -> DataFrame:
    series = timeline(*SERIES)
    return panel.withColumns(
        {
            "average_daily_volume_20d": rolling(F.avg, "volume", series, window),
            "average_daily_value_20d": rolling(F.avg, "value_traded", series, window),
        }
    )


def add_traded_value_rank(panel: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Share of the date's names with at most this average value, ties averaged."""
    return with_ranks(
        panel, ["date"], "average_daily_value_20d", percent="traded_value_rank_20d", counted=counted
    )


def add_momentum(bars: DataFrame, extreme_window: int = 20) -> DataFrame:
    series = timeline(*SERIES)
    price = F.col("adjusted_close")
    returns = {f"return_{k}d": change(price, F.lag(price, k).over(series)) for k in MOMENTUM_ROWS}
    r1 = F.col("return_1d")
    return bars.withColumns(returns).withColumns(
        {
            "distance_from_20d_high": change(price, rolling(F.max, price, series, extreme_window)),
            "distance_from_20d_low": change(price, rolling(F.min, price, series, extreme_window)),
            "negative_shock_1d": F.when(r1.isNotNull(), F.least(r1, F.lit(0.0))),
            "positive_shock_1d": F.when(r1.isNotNull(), F.greatest(r1, F.lit(0.0))),
        }
    )


def add_price_limits(
    bars: DataFrame, price: str = "close", limit: float = NORMAL_DAILY_LIMIT
) -> DataFrame:
    """Estimated ceiling and floor from the previous price, hits and hit streaks.

    Hits use the day's high and low when the panel has them, otherwise the price.
    """
    value = F.col(price)
    top = F.col("high" if "high" in bars.columns else price)
    bottom = F.col("low" if "low" in bars.columns else price)
    ceiling, floor = F.col("estimated_ceiling_price"), F.col("estimated_floor_price")
    flagged = (
        bars.withColumn("reference_price", F.lag(value, 1).over(timeline(*SERIES)))
        .withColumns(
            {
                "estimated_ceiling_price": ceiling_price("reference_price", limit),
                "estimated_floor_price": floor_price("reference_price", limit),
            }
        )
        .withColumns(
            {
                "distance_to_ceiling": F.try_divide(ceiling - value, value),
                "distance_to_floor": F.try_divide(value - floor, value),
                "hit_ceiling_today": truthy(top >= ceiling),
                "hit_floor_today": truthy(bottom <= floor),
                "close_at_ceiling_today": truthy(value >= ceiling),
                "close_at_floor_today": truthy(value <= floor),
            }
        )
    )
    return with_run_lengths(
        flagged,
        {
            "hit_ceiling_today": "consecutive_ceiling_days",
            "hit_floor_today": "consecutive_floor_days",
        },
        SERIES,
    )


def winsorised(
    panel: DataFrame, value: str, output: str, lower: float = 0.01, upper: float = 0.99
) -> DataFrame:
    """Clip a column to its exact quantiles on each date."""
    bounds = group_quantiles(panel, ["date"], value, {"__lower": lower, "__upper": upper})
    clipped = F.least(F.greatest(F.col(value), F.col("__lower")), F.col("__upper"))
    return (
        panel.join(F.broadcast(bounds), "date", "left")
        .withColumn(output, F.when(F.col(value).isNotNull(), clipped))
        .drop("__lower", "__upper")
    )


def add_liquidity_series(panel: DataFrame, window: int = 20, abnormal_z: float = 2.0) -> DataFrame:
    """Volume and value z-scores, volume change, turnover and raw illiquidity; needs ``return_1d``."""
    series = timeline(*SERIES)
    volume = fill_forward("volume", series)
    if "shares_outstanding" in panel.columns:
        panel = panel.withColumn("turnover", F.try_divide("volume", "shares_outstanding"))
        turnover_z: Column = z_score("turnover", series, window)
    else:
        turnover_z = F.lit(None).cast("double")
    return (
        panel.withColumn("__filled_volume", volume)
        .withColumns(
            {
                "volume_z_20": z_score("volume", series, window),
                "value_traded_z_20": z_score("value_traded", series, window),
                "volume_change_5d": change("__filled_volume", F.lag("__filled_volume", 5).over(series)),
                "turnover_z_20": turnover_z,
                "amihud_illiquidity_raw": F.try_divide(F.abs("return_1d"), F.col("value_traded")),
            }
        )
        .withColumn("abnormal_volume_flag", truthy(F.abs("volume_z_20") >= abnormal_z))
        .drop("__filled_volume")
    )


def add_liquidity(panel: DataFrame, window: int = 20, abnormal_z: float = 2.0) -> DataFrame:
    """Liquidity series with illiquidity clipped to the date's 1% and 99% quantiles."""
    timed = add_liquidity_series(panel, window, abnormal_z)
    return winsorised(timed, "amihud_illiquidity_raw", "amihud_illiquidity")


def rank_by_liquidity(panel: DataFrame, date: object | None = None) -> DataFrame:
    """Liquidity ranking of one date, by default the latest."""
    if date is None:
        latest = panel.agg(F.max("date").alias("date"))
        rows = panel.join(F.broadcast(latest), "date", "left_semi")
    else:
        rows = panel.where(F.col("date") == F.lit(date))
    # One date only, but read by four ranks.
    rows = checkpoint(rows.select("date", "ticker", "value_traded", "volume", "amihud_illiquidity"))
    ranked = with_ranks(rows, ["date"], "value_traded", ascending=False, minimum="value_traded_rank")
    ranked = with_ranks(ranked, ["date"], "volume", ascending=False, minimum="volume_rank", counted=rows)
    ranked = with_ranks(ranked, ["date"], "amihud_illiquidity", minimum="amihud_rank", counted=rows)
    scored = ranked.withColumn(
        "liquidity_rank_score",
        F.col("value_traded_rank") + F.col("volume_rank") + F.col("amihud_rank"),
    )
    return with_ranks(checkpoint(scored), ["date"], "liquidity_rank_score", minimum="liquidity_rank")


def snapshot_average_value(bars: DataFrame, window: int = 20, unit: float = 1000.0) -> DataFrame:
    """Latest row per ticker with the mean traded value of up to ``window`` rows and limit flags."""
    value = F.col("close") * F.col("volume") * F.lit(unit)
    timed = add_price_limits(
        bars.withColumn("average_daily_value", rolling(F.avg, value, timeline(*SERIES), window, at_least=1))
    )
    latest = bars.agg(F.max("date").alias("date"))
    return timed.join(F.broadcast(latest), "date", "left_semi").select(
        F.col("date").alias("data_date"),
        "ticker",
        (F.col("close") * unit).alias("price"),
        "average_daily_value",
        F.col("close_at_ceiling_today").alias("at_ceiling"),
        F.col("close_at_floor_today").alias("at_floor"),
    )


def add_basic_features(bars: DataFrame) -> DataFrame:
    return add_average_volume(add_drawdown(add_volatility(add_returns(bars))))
