"""Date indexes and the trading calendar.

Calendar tables hold one row per day, so they are the tables this library broadcasts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.numeric import as_column


def date_index(panel: DataFrame, name: str = "date_idx") -> DataFrame:
    """Distinct dates with a dense position starting at 0."""
    return (
        panel.select("date")
        .distinct()
        .withColumn(name, (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))
    )


def with_date_index(panel: DataFrame, index: DataFrame | None = None) -> DataFrame:
    return panel.join(F.broadcast(date_index(panel) if index is None else index), "date")


def trading_calendar(
    spark: SparkSession,
    start: dt.date,
    end: dt.date,
    holidays: Iterable[dt.date] = (),
) -> DataFrame:
    """Weekdays from start to end without holidays, with a dense position."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("date")
    )
    open_days = days.where(F.weekday("date") < 5)
    closed = list(holidays)
    if closed:
        open_days = open_days.where(~F.col("date").isin(closed))
    return date_index(open_days, "trading_idx")


def shift_trading_days(
    frame: DataFrame, calendar: DataFrame, column: str, offset: int, output: str
) -> DataFrame:
    """Date ``offset`` trading days away; null when ``column`` is no trading day."""
    here = calendar.select(F.col("date").alias(column), "trading_idx")
    there = calendar.select(
        F.col("date").alias(output), (F.col("trading_idx") - offset).alias("trading_idx")
    )
    steps = here.join(there, "trading_idx", "left").drop("trading_idx")
    return frame.join(F.broadcast(steps), column, "left")


def nearest_trading_days(frame: DataFrame, calendar: DataFrame, column: str) -> DataFrame:
    """Add ``on_or_before``, ``on_or_after`` and ``is_trading_day`` for a date column.

    The calendar is filled to every day first, so the lookup is an equi-join.
    """
    span = calendar.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    every = span.select(
        F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias(column)
    ).join(calendar.select(F.col("date").alias("__open")), F.col(column) == F.col("__open"), "left")
    order = Window.orderBy(column)
    lookup = every.select(
        column,
        F.last("__open", True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("on_or_before"),
        F.first("__open", True).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("on_or_after"),
        F.col("__open").isNotNull().alias("is_trading_day"),
    )
    return frame.join(F.broadcast(lookup), column, "left")


def _local_clock(generated_at: dt.datetime, timezone: str) -> tuple[Column, Column]:
    """Local date and time of day of an aware run time, independent of the session zone."""
    if generated_at.tzinfo is None:
        raise ValueError("generated_at needs a time zone")
    local = generated_at.astimezone(ZoneInfo(timezone))
    return F.lit(local.date()), F.lit(local.strftime("%H:%M:%S"))


def _last_completed(today: Column, clock: Column, cutoff: str) -> Column:
    last_day = F.when(clock >= F.lit(f"{cutoff}:00"), today).otherwise(F.date_sub(today, 1))
    return F.max(F.when(F.col("date") <= last_day, F.col("date")))


def latest_completed_day(
    calendar: DataFrame, generated_at: dt.datetime, timezone: str, cutoff: str
) -> DataFrame:
    """Last trading day whose local cutoff has passed at an aware run time."""
    today, clock = _local_clock(generated_at, timezone)
    return calendar.agg(_last_completed(today, clock, cutoff).alias("completed_date"))


def signal_timing(
    calendar: DataFrame,
    data_date: dt.date,
    generated_at: dt.datetime,
    timezone: str,
    data_cutoff: str,
    submission_cutoff: str,
    enforce_submission: bool = True,
) -> DataFrame:
    """One row: data date, next execution date, expected date and timing status."""
    today, clock = _local_clock(generated_at, timezone)
    data_day = F.lit(data_date)
    bounds = calendar.agg(
        _last_completed(today, clock, data_cutoff).alias("expected_data_date"),
        F.min(F.when(F.col("date") > data_day, F.col("date"))).alias("intended_execution_date"),
    )
    missed = (today > F.col("intended_execution_date")) | (
        (today == F.col("intended_execution_date")) & (clock > F.lit(f"{submission_cutoff}:00"))
    )
    status = F.when(F.col("expected_data_date") != data_day, "unexpected_data_date")
    if enforce_submission:
        status = status.when(missed, "submission_cutoff_passed")
    return bounds.select(
        data_day.alias("data_asof_date"),
        data_day.alias("signal_date"),
        "intended_execution_date",
        "expected_data_date",
        status.otherwise("ok").alias("timing_status"),
    )


def week_ending_friday(date: Column | str) -> Column:
    return F.next_day(F.date_sub(as_column(date), 1), "Fri")


def signal_id(date: Column | str, model: Column | str, horizon: Column | str, ticker: Column | str) -> Column:
    return F.concat_ws(
        "-",
        F.lit("signal"),
        F.date_format(as_column(date), "yyyyMMdd"),
        as_column(model),
        F.concat(as_column(horizon).cast("string"), F.lit("d")),
        as_column(ticker),
    )
