"""Portfolio construction: capped targets, turnover-limited paths, concentration.

Target weights are relational and parallel over every (mode, date).  Only the turnover
limit depends on the previous result, so only that step walks through dates, one grouped
function per scenario over at most ``top_n`` rows per date.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.numeric import truthy
from tidepanel.functions.ranking import top_n
from tidepanel.operators.selection import best_first

TOP_N = 5
MAX_WEIGHT = 0.20
MAX_TURNOVER = 0.40
MAX_ISSUER_GROUP_WEIGHT = 0.40
MAX_SECTOR_WEIGHT = 0.35
MIN_WEIGHT = 1e-8
TURNOVER_BUFFER = 1e-6
# A turnover this close to the limit counts as on it, so summation order cannot decide.
LIMIT_TOLERANCE = 1e-12
CAP_TOLERANCE = 1e-8

# Controls on high-herding days.
HERDING_TOP_N = 5
HERDING_MAX_WEIGHT = 0.15
HERDING_EXPOSURE = 0.75
HERDING_MIN_PREDICTION = 0.0

MODES = ("normal", "herding_aware", "sector_aware")


def attach_context(predictions: DataFrame, universe: DataFrame, herding: DataFrame) -> DataFrame:
    """Predictions with issuer group, sector and the herding state of the date."""
    return predictions.join(universe.select("ticker", "issuer_group", "sector"), "ticker", "left").join(
        F.broadcast(herding), "date", "left"
    )


def missing_context(predictions: DataFrame) -> DataFrame:
    """Rows without issuer group or sector, which portfolio construction must not see."""
    return predictions.where("issuer_group IS NULL OR sector IS NULL").select("date", "ticker")


def with_mode_parameters(predictions: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """One copy of the predictions per mode with that mode's limits as columns."""
    return mode_parameters(
        predictions.withColumn("optimization_mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    )


def mode_parameters(expanded: DataFrame) -> DataFrame:
    """Limits of each row's ``optimization_mode``; an unknown mode gets the normal limits."""
    if "high_herding_day" not in expanded.columns:
        expanded = expanded.withColumn("high_herding_day", F.lit(False))
    careful = (F.col("optimization_mode") == "herding_aware") & truthy(F.col("high_herding_day"))
    return expanded.withColumns(
        {
            "max_names": F.when(careful, HERDING_TOP_N).otherwise(TOP_N),
            "max_weight": F.when(careful, HERDING_MAX_WEIGHT).otherwise(MAX_WEIGHT),
            "exposure": F.when(careful, HERDING_EXPOSURE).otherwise(1.0),
            "min_prediction": F.when(careful, F.lit(HERDING_MIN_PREDICTION)),
            "max_sector_weight": F.when(
                F.col("optimization_mode") == "sector_aware", F.lit(MAX_SECTOR_WEIGHT)
            ),
        }
    )


def cap_groups(
    targets: DataFrame, group: str, cap: Column | float, weight: str, by: Sequence[str]
) -> DataFrame:
    """Scale the weights of every group above its cap down to the cap; a null cap is no cap."""
    total = F.sum(weight).over(Window.partitionBy(*by, group))
    limit = cap if isinstance(cap, Column) else F.lit(cap)
    scale = F.coalesce(F.least(F.try_divide(limit, total), F.lit(1.0)), F.lit(1.0))
    scale = F.when(limit.isNull(), F.lit(1.0)).otherwise(scale)
    return targets.withColumn(weight, F.col(weight) * scale)


def target_weights(
    predictions: DataFrame, by: Sequence[str] = ("optimization_mode",), widest: int = max(TOP_N, HERDING_TOP_N)
) -> DataFrame:
    """Capped equal-weight targets of the best names per date and scenario.

    Needs the columns of ``with_mode_parameters``.  Weight cut by a cap stays in cash.
    """
    keys = [*by, "date"]
    eligible = predictions.where(
        F.col("predicted_return").isNotNull()
        & (F.col("min_prediction").isNull() | (F.col("predicted_return") > F.col("min_prediction")))
    )
    chosen = top_n(eligible, keys, best_first("predicted_return"), widest, rank="__place").where(
        F.col("__place") <= F.col("max_names")
    )
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    weighted = chosen.withColumn("target_weight", F.least(F.col("exposure") / count, F.col("max_weight")))
    capped = cap_groups(weighted, "issuer_group", MAX_ISSUER_GROUP_WEIGHT, "target_weight", keys)
    capped = cap_groups(capped, "sector", F.col("max_sector_weight"), "target_weight", keys)
    return capped.select(
        *keys, "ticker", "issuer_group", "sector", "predicted_return", "target_weight"
    )


def turnover(previous: dict[str, float], target: dict[str, float]) -> float:
    names = sorted(previous.keys() | target.keys())
    return 0.5 * sum(abs(target.get(t, 0.0) - previous.get(t, 0.0)) for t in names)


def capped_step(
    previous: dict[str, float],
    target: dict[str, float],
    limit: float,
    buffer: float = TURNOVER_BUFFER,
    smallest: float = MIN_WEIGHT,
) -> dict[str, float]:
    """Move from previous towards target as far as the turnover limit allows."""
    needed = turnover(previous, target)
    if needed <= limit + LIMIT_TOLERANCE:
        moved = dict(target)
    else:
        part = max((limit - buffer) / needed, 0.0)
        moved = {
            t: previous.get(t, 0.0) + part * (target.get(t, 0.0) - previous.get(t, 0.0))
            for t in previous.keys() | target.keys()
        }
    return {t: w for t, w in moved.items() if w > smallest}


def turnover_limited_path(
    targets: DataFrame,
    dates: DataFrame,
    scenario: str = "optimization_mode",
    limits: dict[str, float] | None = None,
    default_limit: float = MAX_TURNOVER,
) -> DataFrame:
    """Weights held on each date when every date may trade at most the turnover limit.

    ``dates`` lists (scenario, date); a listed date without targets moves towards cash.
    """
    limits = limits or {}
    plan = dates.select(scenario, "date").distinct().join(
        targets.select(scenario, "date", "ticker", "target_weight"), [scenario, "date"], "left"
    )

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        name = group[scenario].iloc[0]
        limit = limits.get(name, default_limit)
        held: dict[str, float] = {}
        rows = []
        for date, day in group.sort_values(["date", "ticker"]).groupby("date", sort=True):
            day = day[day["ticker"].notna()]
            wanted = dict(zip(day["ticker"], day["target_weight"]))
            following = capped_step(held, wanted, limit)
            moved = turnover(held, following)
            rows += [(name, date, t, w, moved) for t, w in sorted(following.items())]
            held = following
        return pd.DataFrame(rows, columns=[scenario, "date", "ticker", "weight", "portfolio_turnover"])

    schema = f"{scenario} string, date date, ticker string, weight double, portfolio_turnover double"
    return plan.groupBy(scenario).applyInPandas(walk, schema)


def optimised_weights(
    predictions: DataFrame, modes: Sequence[str] = MODES, max_turnover: float = MAX_TURNOVER
) -> DataFrame:
    """Weight history per mode with turnover and the metadata of held names.

    ``predictions`` holds one model and carries issuer group, sector and herding state.
    """
    expanded = with_mode_parameters(predictions, modes)
    targets = target_weights(expanded)
    path = turnover_limited_path(
        targets, expanded.select("optimization_mode", "date"), default_limit=max_turnover
    )
    return with_holding_details(path, predictions)


def with_holding_details(path: DataFrame, predictions: DataFrame) -> DataFrame:
    """Attach group, sector and the prediction of the date, where one exists."""
    names = predictions.groupBy("ticker").agg(
        F.first("issuer_group", True).alias("issuer_group"), F.first("sector", True).alias("sector")
    )
    details = predictions.select(
        "date",
        "ticker",
        *[
            c
            for c in ("predicted_return", "actual_return", "herding_corr_score", "high_herding_day", "model_name")
            if c in predictions.columns
        ],
    )
    return path.join(names, "ticker", "left").join(details, ["date", "ticker"], "left")


def turnover_between_dates(weights: DataFrame, by: Sequence[str] = ("optimization_mode",)) -> DataFrame:
    """One-way turnover, buys and sells of each date against the previous held date.

    Every weight is counted once on its own date and once, negated, on the next date of
    its scenario, so one aggregate replaces the outer join of consecutive dates.
    """
    by = list(by)
    order = Window.partitionBy(*by).orderBy("date")
    steps = weights.select(*by, "date").distinct().withColumn("__next", F.lead("date").over(order))
    now = weights.select(*by, "date", "ticker", "weight")
    carried = (
        now.join(steps, [*by, "date"])
        .where(F.col("__next").isNotNull())
        .select(*by, F.col("__next").alias("date"), "ticker", (-F.col("weight")).alias("weight"))
    )
    changes = now.unionByName(carried).groupBy(*by, "date", "ticker").agg(F.sum("weight").alias("change"))
    return changes.groupBy(*by, "date").agg(
        (F.sum(F.abs("change")) * 0.5).alias("turnover"),
        F.sum(F.greatest("change", F.lit(0.0))).alias("buys"),
        F.sum(F.greatest(-F.col("change"), F.lit(0.0))).alias("sells"),
    )


def daily_concentration(weights: DataFrame, by: Sequence[str] = ("optimization_mode",)) -> DataFrame:
    """Concentration of each portfolio and date, by name and by issuer group."""
    keys = [*by, "date"]
    at_cap = F.col("weight") >= MAX_WEIGHT - CAP_TOLERANCE
    groups = weights.groupBy(*keys, "issuer_group").agg(
        F.sum("weight").alias("group_weight"),
        F.count(F.lit(1)).alias("names"),
        F.max("weight").alias("largest"),
        F.count_if(at_cap).alias("capped"),
        F.sum(F.col("weight") * F.col("weight")).alias("squares"),
    )
    first_largest = F.min_by("issuer_group", F.struct(-F.col("group_weight"), F.col("issuer_group")))
    daily = groups.groupBy(*keys).agg(
        F.sum("names").alias("holding_count"),
        F.sum("group_weight").alias("total_weight"),
        F.max("largest").alias("max_single_name_weight"),
        F.sum("capped").alias("positions_at_cap"),
        F.sum("squares").alias("hhi"),
        first_largest.alias("top_issuer_group"),
        F.max("group_weight").alias("top_issuer_group_weight"),
        F.count_if(F.col("group_weight") >= MAX_ISSUER_GROUP_WEIGHT - CAP_TOLERANCE).alias(
            "issuer_groups_at_cap"
        ),
    )
    return daily.withColumns(
        {
            "single_name_cap_hit_share": F.col("positions_at_cap") / F.col("holding_count"),
            "all_positions_at_cap": F.col("positions_at_cap") == F.col("holding_count"),
            "effective_position_count": F.try_divide(F.lit(1.0), F.col("hhi")),
        }
    )


def concentration_flag() -> Column:
    flags = F.concat_ws(
        "; ",
        F.when(F.col("all_positions_at_cap"), "all_positions_at_20pct_cap"),
        F.when(
            F.col("top_issuer_group_weight") >= MAX_ISSUER_GROUP_WEIGHT - CAP_TOLERANCE,
            "issuer_group_at_40pct_cap",
        ),
        F.when(F.col("effective_position_count") <= 5.0 + CAP_TOLERANCE, "low_effective_position_count"),
    )
    return F.when(flags == "", "normal").otherwise(flags)
