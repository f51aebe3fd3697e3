"""Market returns, rolling beta and residual returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.numeric import as_column
from tidepanel.functions.rolling import last_rows, timeline


def market_return(panel: DataFrame, value: str = "return_1d") -> DataFrame:
    return panel.groupBy("date").agg(F.avg(value).alias("market_return_1d"))


def with_market_return(panel: DataFrame, value: str = "return_1d") -> DataFrame:
    """Equal-weight market return of the date and the excess over it."""
    return (
        panel.select("date", "ticker", value)
        .join(F.broadcast(market_return(panel, value)), "date", "left")
        .withColumn("stock_minus_market_return_1d", as_column(value) - F.col("market_return_1d"))
    )


def rolling_beta(
    returns: DataFrame, window: int = 60, at_least: int = 20, value: str = "return_1d"
) -> DataFrame:
    """Beta from earlier rows only, and today's return without its market part.

    The covariance uses rows where both lagged returns exist, the variance every lagged
    market return, as pandas does for rolling ``cov`` and ``var``.
    """
    series = timeline("ticker")
    frame = last_rows(series, window)
    lagged = returns.withColumns(
        {
            "__stock": F.lag(value, 1).over(series),
            "__market": F.lag("market_return_1d", 1).over(series),
        }
    ).withColumn("__paired", F.col("__stock").isNotNull() & F.col("__market").isNotNull())
    pairs = F.count(F.when(F.col("__paired"), 1)).over(frame)
    enough_market = F.count("__market").over(frame) >= at_least
    return (
        lagged.withColumns(
            {
                "rolling_covariance_with_market": F.when(
                    pairs >= at_least, F.covar_samp("__stock", "__market").over(frame)
                ),
                "rolling_market_variance": F.when(enough_market, F.var_samp("__market").over(frame)),
            }
        )
        .withColumn(
            "rolling_beta_to_market",
            F.try_divide("rolling_covariance_with_market", "rolling_market_variance"),
        )
        .withColumn(
            "residual_return_1d",
            as_column(value) - F.col("rolling_beta_to_market") * F.col("market_return_1d"),
        )
        .drop("__stock", "__market", "__paired")
    )
