"""Row-based windows along one series.

Every frame counts rows of the series, not calendar days, and ``at_least`` counts
non-null values, so gaps never shorten a lookback silently.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidepanel.functions.numeric import as_column


def timeline(*keys: str, order: str = "date") -> WindowSpec:
    """Window over one series.

    Without keys the series is a table with one row per date, which the calendar
    bounds, so a single task is enough.
    """
    return Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)


def last_rows(series: WindowSpec, rows: int) -> WindowSpec:
    return series.rowsBetween(1 - rows, Window.currentRow)


def so_far(series: WindowSpec) -> WindowSpec:
    return series.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rolling(
    aggregate: Callable[[Column], Column],
    value: Column | str,
    series: WindowSpec,
    rows: int,
    at_least: int | None = None,
) -> Column:
    column, frame = as_column(value), last_rows(series, rows)
    enough = F.count(column).over(frame) >= (rows if at_least is None else at_least)
    return F.when(enough, aggregate(column).over(frame))


def z_score(value: Column | str, series: WindowSpec, rows: int) -> Column:
    """Distance from the rolling mean in rolling deviations; null for a flat window."""
    mean = rolling(F.avg, value, series, rows)
    deviation = rolling(F.stddev_samp, value, series, rows)
    return F.try_divide(as_column(value) - mean, deviation)


def fill_forward(value: Column | str, series: WindowSpec) -> Column:
    return F.last(as_column(value), ignorenulls=True).over(so_far(series))


def compounded(value: Column | str, series: WindowSpec, rows: int | None = None) -> Column:
    """Product of one plus each return; missing returns count as zero."""
    frame = so_far(series) if rows is None else last_rows(series, rows)
    return F.product(F.lit(1.0) + F.coalesce(as_column(value), F.lit(0.0))).over(frame)


def with_run_lengths(
    frame: DataFrame, flags: dict[str, str], keys: Sequence[str], order: str = "date"
) -> DataFrame:
    """Add, per flag column, the number of consecutive true rows ending here."""
    series = timeline(*keys, order=order)
    for flag, output in flags.items():
        island = f"__{output}"
        frame = frame.withColumn(
            island, F.count(F.when(~F.col(flag), 1)).over(so_far(series))
        )
        within = so_far(timeline(*keys, island, order=order))
        frame = frame.withColumn(output, F.count(F.when(F.col(flag), 1)).over(within)).drop(island)
    return frame
