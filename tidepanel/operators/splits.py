"""Date windows for walk-forward evaluation.

All window logic runs on positions of the date index; rows meet their windows through a
broadcast of the small (window, role, date) table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.dates import date_index
from tidepanel.functions.rolling import so_far, timeline
from tidepanel.schemas import KEYS, PRICES

# Label columns and raw market columns that may never be features.
LABEL_COLUMNS = [
    *[f"forward_return_{h}d" for h in (1, 5, 10)],
    *[f"benchmark_forward_return_{h}d" for h in (1, 5, 10)],
    *[f"forward_relative_return_{h}d" for h in (1, 5, 10)],
    "target",
    "top_quintile_label",
]
RAW_COLUMNS = [*PRICES, "volume", "value_traded"]

# Feature groups removed in ablation runs.
ABLATION_GROUPS: dict[str, list[str]] = {
    "all_features": [],
    "without_volume_liquidity": [
        "average_daily_volume_20d",
        "average_daily_value_20d",
        "traded_value_rank_20d",
        "volume_z_20",
        "value_traded_z_20",
        "volume_change_5d",
        "amihud_illiquidity_raw",
        "amihud_illiquidity",
        "abnormal_volume_flag",
        "volume_concentration_top5",
        "herding_volume_concentration_score",
    ],
    "without_price_limit": [
        "reference_price",
        "estimated_ceiling_price",
        "estimated_floor_price",
        "distance_to_ceiling",
        "distance_to_floor",
        "hit_ceiling_today",
        "hit_floor_today",
        "close_at_ceiling_today",
        "close_at_floor_today",
        "consecutive_ceiling_days",
        "consecutive_floor_days",
        "percent_hitting_ceiling",
        "percent_hitting_floor",
        "price_limit_pressure",
        "herding_price_limit_score",
    ],
    "without_herding": [
        "market_return_dispersion",
        "percent_stocks_up",
        "percent_stocks_down",
        "rolling_avg_pairwise_corr",
        "market_direction_agreement",
        "herding_corr_score",
        "herding_low_dispersion_score",
        "herding_direction_score",
        "herding_volume_concentration_score",
        "herding_index",
    ],
    "without_risk": ["rolling_vol_20d", "drawdown"],
}


def feature_columns(dataset: DataFrame, extra_excluded: Sequence[str] = ()) -> list[str]:
    """Columns usable as features: no key, label or raw column, and not entirely null."""
    excluded = {*KEYS, *LABEL_COLUMNS, *RAW_COLUMNS, *extra_excluded}
    candidates = [c for c in dataset.columns if c not in excluded]
    if not candidates:
        return []
    known = dataset.agg(*[F.count(c).alias(c) for c in candidates]).first()
    return [c for c in candidates if known[c] > 0]


def check_features(columns: Sequence[str]) -> None:
    leaked = sorted(set(columns) & {*KEYS, *LABEL_COLUMNS})
    if leaked:
        raise ValueError(f"Keys or labels used as features: {leaked}")


def ablation_feature_sets(columns: Sequence[str]) -> dict[str, list[str]]:
    return {
        name: [c for c in columns if c not in removed] for name, removed in ABLATION_GROUPS.items()
    }


def check_score_columns(columns: Sequence[str], target: str = "target") -> None:
    forbidden = sorted(set(columns) & {*KEYS, target})
    if forbidden:
        raise ValueError(f"Not usable as scores: {forbidden}")


def walk_forward_windows(
    dates: DataFrame,
    train_size: int = 3,
    validation_size: int = 1,
    test_size: int = 1,
    purge_size: int = 5,
    step_size: int = 1,
) -> DataFrame:
    """(window_id, role, date_idx, date): train, gap, validation, gap, test, moved by step."""
    index = date_index(dates)
    starts = {
        "train": 0,
        "validation": train_size + purge_size,
        "test": train_size + validation_size + 2 * purge_size,
    }
    sizes = {"train": train_size, "validation": validation_size, "test": test_size}
    length = starts["test"] + test_size
    total = index.agg(F.count(F.lit(1)).alias("dates"))
    last_start = F.col("dates") - length
    windows = (
        total.where(last_start >= 0)
        .select(F.explode(F.sequence(F.lit(0).cast("bigint"), last_start, F.lit(step_size).cast("bigint"))).alias("start"))
        .withColumn("window_id", (F.col("start") / step_size).cast("int"))
    )
    offsets = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.lit(starts[role] + i).alias("offset"))
            for role in starts
            for i in range(sizes[role])
        ]
    )
    placed = windows.select("window_id", "start", F.explode(offsets).alias("slot")).select(
        "window_id", "slot.role", (F.col("start") + F.col("slot.offset")).cast("int").alias("date_idx")
    )
    return placed.join(F.broadcast(index), "date_idx")


def window_rows(
    rows: DataFrame,
    windows: DataFrame,
    roles: Sequence[str] = ("train", "validation", "test"),
    label: str | None = None,
) -> DataFrame:
    """Rows with the windows and roles their date plays in; rows without a label drop out."""
    chosen = windows.where(F.col("role").isin(list(roles))).select("window_id", "role", "date")
    kept = rows if label is None else rows.where(F.col(label).isNotNull())
    return kept.join(F.broadcast(chosen), "date")


def expanding_signals(
    dates: DataFrame, horizon: int = 10, minimum_dates: int = 252, step: int = 10
) -> DataFrame:
    """(signal_idx, signal_date, cutoff_idx, training_cutoff) every ``step`` dates.

    The cutoff lies ``horizon`` dates before the signal, so every training label is known
    on the signal date.
    """
    index = date_index(dates)
    first = minimum_dates - 1 + horizon
    cutoff = index.select(
        (F.col("date_idx") + horizon).alias("signal_idx"),
        F.col("date_idx").alias("cutoff_idx"),
        F.col("date").alias("training_cutoff"),
    )
    return (
        index.where((F.col("date_idx") >= first) & ((F.col("date_idx") - first) % step == 0))
        .select(F.col("date_idx").alias("signal_idx"), F.col("date").alias("signal_date"))
        .join(cutoff, "signal_idx")
    )


def usable_signals(signals: DataFrame, dataset: DataFrame, minimum_dates: int, target: str = "target") -> DataFrame:
    """Signals whose date has only known targets and enough earlier dates with targets."""
    per_date = dataset.groupBy("date").agg(
        F.count(F.lit(1)).alias("rows"), F.count(target).alias("known")
    )
    ready = per_date.withColumn(
        "training_date_count", F.count_if(F.col("known") > 0).over(so_far(timeline()))
    )
    complete = ready.where("rows = known").select(F.col("date").alias("signal_date"))
    training = ready.select(F.col("date").alias("training_cutoff"), "training_date_count")
    return (
        signals.join(F.broadcast(complete), "signal_date")
        .join(F.broadcast(training), "training_cutoff")
        .where(F.col("training_date_count") >= minimum_dates)
    )


def pending_signals(signals: DataFrame, finished: DataFrame) -> DataFrame:
    """Signals without stored predictions, the resume rule of a long history."""
    done = finished.select(F.col("date").alias("signal_date"), "model_name").distinct()
    return signals.join(done, ["signal_date", "model_name"], "left_anti")


def with_period(history: DataFrame, holdout_start: dt.date | str) -> DataFrame:
    """Mark each row as training or holdout by a chronological split."""
    split = F.lit(holdout_start).cast("date")
    return history.withColumn("period", F.when(F.col("date") < split, "training").otherwise("holdout"))
