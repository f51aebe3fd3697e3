"""Incremental updates of the bar table from landed provider rows."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.quality import completed_day_checks, suspicious_moves


def coverage_audit(universe: DataFrame, landed: DataFrame) -> DataFrame:
    """Landed rows, first and last date and status per universe ticker."""
    per_ticker = landed.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    return (
        universe.select("ticker")
        .distinct()
        .join(per_ticker, "ticker", "left")
        .withColumn("status", F.when(F.col("row_count").isNull(), "error").otherwise("ok"))
        .withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("bigint")))
    )


def update_window(existing: DataFrame, completed: dt.date, overlap_days: int) -> DataFrame:
    """One row: start and end of the re-read window and whether existing data is newer."""
    return existing.agg(F.max("date").alias("latest_date")).select(
        F.date_sub("latest_date", overlap_days).alias("start_date"),
        F.lit(completed).alias("end_date"),
        (F.col("latest_date") > F.lit(completed)).alias("existing_is_newer"),
    )


def window_bounds(existing: DataFrame, completed: dt.date, overlap_days: int) -> tuple[dt.date, dt.date]:
    row = update_window(existing, completed, overlap_days).first()
    if row["existing_is_newer"]:
        raise ValueError(f"Existing data is newer than {completed}")
    return row["start_date"], row["end_date"]


def merge_window(existing: DataFrame, landed: DataFrame, start: dt.date) -> DataFrame:
    """Existing rows before the window, landed rows from its start."""
    return existing.where(F.col("date") < F.lit(start)).unionByName(
        landed.where(F.col("date") >= F.lit(start)).select(*existing.columns)
    )


def landed_problems(landed: DataFrame, end: dt.date) -> DataFrame:
    """Rows after the window and repeated keys."""
    late = landed.where(F.col("date") > F.lit(end)).select(
        "date", "ticker", F.lit("after_window").alias("problem")
    )
    repeated = (
        landed.groupBy("date", "ticker").count().where("count > 1")
        .select("date", "ticker", F.lit("duplicate_key").alias("problem"))
    )
    return late.unionByName(repeated)


def overlap_problems(
    existing: DataFrame, landed: DataFrame, tolerance: float, start: dt.date
) -> DataFrame:
    """Closes that changed too much and existing keys the landed window lacks."""
    old = existing.where(F.col("date") >= F.lit(start)).select(
        "date", "ticker", F.col("close").alias("existing_close")
    )
    new = landed.where(F.col("date") >= F.lit(start)).select(
        "date", "ticker", F.col("close").alias("landed_close"), F.lit(True).alias("__landed")
    )
    joined = old.join(new, ["date", "ticker"], "left")
    shift = F.try_divide(
        F.abs(F.col("landed_close") - F.col("existing_close")), F.abs(F.col("existing_close"))
    )
    problem = F.when(F.col("__landed").isNull(), "missing_from_update").when(
        (F.col("existing_close") == 0) | (shift > tolerance),
        "close_changed",
    )
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select(
        "date", "ticker", "existing_close", "landed_close", "problem"
    )


@dataclass(frozen=True)
class DailyUpdate:
    """Merged table with its audit tables and window."""

    data: DataFrame
    audit: DataFrame
    checks: DataFrame
    moves: DataFrame
    start: dt.date
    end: dt.date


def _require_none(problems: DataFrame, what: str) -> None:
    sample = problems.limit(5).collect()
    if sample:
        raise ValueError(f"{what}, for example {[tuple(r) for r in sample]}")


def daily_update(
    existing: DataFrame,
    landed: DataFrame,
    universe: DataFrame,
    completed: dt.date,
    overlap_days: int = 14,
    close_tolerance: float = 0.05,
    move_threshold: float = 0.15,
) -> DailyUpdate:
    """Replace the overlap window by landed rows after checking them.

    Corrections inside the window win, rows before it stay as they are and rows after it
    are rejected.  Landed rows before the window are ignored.
    """
    start, end = window_bounds(existing, completed, overlap_days)
    fresh = landed.where(F.col("date") >= F.lit(start))
    audit = coverage_audit(universe, fresh)
    _require_none(audit.where("status = 'error'"), "Tickers without landed rows")
    _require_none(landed_problems(fresh, end), "Landed rows break the window rules")
    _require_none(
        overlap_problems(existing, fresh, close_tolerance, start), "Landed rows disagree with history"
    )
    merged = merge_window(existing, fresh, start)
    checks = completed_day_checks(merged, universe, completed)
    _require_none(checks.where("severity = 'error'"), "Completed day is not valid")
    return DailyUpdate(merged, audit, checks, suspicious_moves(merged, move_threshold, start), start, end)
