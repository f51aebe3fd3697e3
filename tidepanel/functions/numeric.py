"""Null-safe arithmetic shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exchange price steps (below 10, below 50, otherwise) and daily limits.
TICK_BELOW_10 = 0.01
TICK_BELOW_50 = 0.05
TICK_OTHERWISE = 0.10
NORMAL_DAILY_LIMIT = 0.07
WIDE_DAILY_LIMIT = 0.20


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def change(current: Column | str, base: Column | str) -> Column:
    """Relative change; a zero base gives null."""
    return F.try_divide(as_column(current), as_column(base)) - F.lit(1.0)


def no_nan(value: Column | str) -> Column:
    """NaN becomes null, the only missing value inside the library."""
    column = as_column(value)
    return F.when(~F.isnan(column), column)


def truthy(condition: Column) -> Column:
    """A comparison with a missing side counts as false."""
    return F.coalesce(condition, F.lit(False))


def share(condition: Column) -> Column:
    """Fraction of rows meeting a condition; missing comparisons stay in the denominator."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate correlation over rows where both sides exist; null when undefined."""
    left, right = as_column(x), as_column(y)
    paired_x = F.when(right.isNotNull(), left)
    paired_y = F.when(left.isNotNull(), right)
    spread = F.stddev_samp(paired_x) * F.stddev_samp(paired_y)
    return F.try_divide(F.covar_samp(paired_x, paired_y), spread)


def sharpe(mean: Column, deviation: Column, periods: float = 1.0) -> Column:
    """Mean over deviation, scaled to ``periods``; null for a zero deviation."""
    return F.try_divide(mean, deviation) * F.sqrt(F.lit(float(periods)))


def tick_size(price: Column | str) -> Column:
    column = as_column(price)
    return (
        F.when(column < 10, F.lit(TICK_BELOW_10))
        .when(column < 50, F.lit(TICK_BELOW_50))
        .when(column.isNotNull(), F.lit(TICK_OTHERWISE))
    )


def _whole_ticks(price: Column) -> tuple[Column, Column, Column]:
    tick = tick_size(price)
    remainder = price % tick
    return tick, remainder, F.rint((price - remainder) / tick)


def floor_to_tick(price: Column | str) -> Column:
    tick, _, count = _whole_ticks(as_column(price))
    return count * tick


def ceil_to_tick(price: Column | str) -> Column:
    tick, remainder, count = _whole_ticks(as_column(price))
    return (count + F.when(remainder != 0, 1.0).otherwise(0.0)) * tick


def ceiling_price(reference: Column | str, limit: float = NORMAL_DAILY_LIMIT) -> Column:
    return floor_to_tick(as_column(reference) * F.lit(1 + limit))


def floor_price(reference: Column | str, limit: float = NORMAL_DAILY_LIMIT) -> Column:
    return ceil_to_tick(as_column(reference) * F.lit(1 - limit))
