"""Market-wide co-movement: cross-sectional aggregates, correlation and herding index."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.dates import date_index, with_date_index
from tidepanel.functions.numeric import share, truthy
from tidepanel.functions.ranking import top_n
from tidepanel.functions.rolling import timeline
from tidepanel.session import checkpoint

DAILY_COLUMNS = [
    "market_return_dispersion",
    "percent_stocks_up",
    "percent_stocks_down",
    "percent_hitting_ceiling",
    "percent_hitting_floor",
    "volume_concentration_top5",
    "rolling_avg_pairwise_corr",
]
SCORES = {
    "herding_corr_score": ("rolling_avg_pairwise_corr", True),
    "herding_low_dispersion_score": ("market_return_dispersion", False),
    "herding_direction_score": ("market_direction_agreement", True),
    "herding_price_limit_score": ("price_limit_pressure", True),
    "herding_volume_concentration_score": ("volume_concentration_top5", True),
}


def value_concentration(panel: DataFrame, n: int = 5, value: str = "value_traded") -> DataFrame:
    """Share of the n largest values in each date's total; null without a positive total."""
    largest = top_n(
        panel.where(F.col(value).isNotNull()).select("date", "ticker", value),
        ["date"],
        [F.col(value).desc(), F.col("ticker")],
        n,
    )
    totals = panel.groupBy("date").agg(F.sum(value).alias("__total"))
    tops = largest.groupBy("date").agg(F.sum(value).alias("__top"))
    return totals.join(tops, "date", "left").select(
        "date",
        F.when(F.col("__total") > 0, F.col("__top") / F.col("__total")).alias(f"volume_concentration_top{n}"),
    )


def cross_sectional_state(panel: DataFrame, n: int = 5) -> DataFrame:
    """One row per date: dispersion, shares of rising and limit-hitting names, concentration."""
    for flag in ("hit_ceiling_today", "hit_floor_today"):
        if flag not in panel.columns:
            panel = panel.withColumn(flag, F.lit(False))
    daily = panel.groupBy("date").agg(
        F.stddev_pop("return_1d").alias("market_return_dispersion"),
        share(F.col("return_1d") > 0).alias("percent_stocks_up"),
        share(F.col("return_1d") < 0).alias("percent_stocks_down"),
        share(truthy(F.col("hit_ceiling_today"))).alias("percent_hitting_ceiling"),
        share(truthy(F.col("hit_floor_today"))).alias("percent_hitting_floor"),
    )
    return daily.join(value_concentration(panel, n), "date", "left")


def _window_vectors(panel: DataFrame, index: DataFrame, window: int, value: str) -> DataFrame:
    """Per window end and name: values by window position and the bit set of known positions.

    ``index`` carries ``date_idx`` and ``last_idx``.

    A name also counts at ends where it has no row itself, as long as one of its rows is
    still inside the window.
    """
    rows = with_date_index(panel.select("date", "ticker", value), index).where(F.col(value).isNotNull())
    series = timeline("ticker", order="date_idx")
    recent = F.collect_list(F.struct("date_idx", value)).over(series.rangeBetween(1 - window, 0))
    following = F.lead("date_idx").over(series) - 1
    listed = rows.select("date_idx", "last_idx", recent.alias("__recent"), following.alias("__until"))
    reach = F.least(F.coalesce("__until", "last_idx"), F.col("date_idx") + (window - 1), F.col("last_idx"))
    start = F.col("end_idx") - (window - 1)
    by_position = F.map_from_entries(
        F.transform(
            F.filter("__recent", lambda r: r["date_idx"] >= start),
            lambda r: F.struct(r["date_idx"] - start, r[value]),
        )
    )
    bits = F.aggregate(
        F.map_keys("__map"),
        F.lit(0).cast("bigint"),
        lambda acc, k: acc + F.pow(F.lit(2.0), k).cast("bigint"),
    )
    return (
        listed.withColumn("end_idx", F.explode(F.sequence(F.col("date_idx"), reach)))
        .where(F.col("end_idx") >= window - 1)
        .withColumn("__map", by_position)
        .select("end_idx", "__map", bits.alias("mask"))
    )


def complete_window_correlation(panel: DataFrame, window: int = 20, value: str = "return_1d") -> DataFrame:
    """Mean correlation of all pairs of names that have a value on every one of the last ``window`` dates.

    (date, rolling_avg_pairwise_corr, complete_share): complete_share is the part of the names
    seen in the window that are complete.  The sum over all pairs of such names is a square
    of per-date sums of standard scores, so the work grows with names times dates.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    index = date_index(panel)
    last = F.max("date_idx").over(Window.partitionBy())
    rows = with_date_index(panel.select("date", "ticker", value), index.withColumn("last_idx", last)).where(
        F.col(value).isNotNull()
    )
    series = timeline("ticker", order="date_idx")
    recent = F.collect_list(value).over(series.rangeBetween(1 - window, 0))
    known = F.col("__recent")
    mean = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x) / window
    squares = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + (x - F.col("__mean")) * (x - F.col("__mean")))
    full = (
        rows.withColumn("__recent", recent)
        .where((F.size("__recent") == window) & (F.array_max("__recent") > F.array_min("__recent")))
        .withColumn("__mean", mean)
        .withColumn("__scale", F.sqrt(squares))
    )
    sums = full.groupBy("date_idx").agg(
        F.count(F.lit(1)).alias("names"),
        F.array(*[F.sum((known[k] - F.col("__mean")) / F.col("__scale")) for k in range(window)]).alias("sums"),
    )
    total = F.aggregate(F.transform("sums", lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x)
    pairs = F.col("names") * (F.col("names") - 1)
    # Complete or not, a name counts at every window end one of its rows still reaches.
    following = F.lead("date_idx").over(series) - 1
    reach = F.least(F.coalesce(following, "last_idx"), F.col("date_idx") + (window - 1), F.col("last_idx"))
    seen = (
        rows.select("date_idx", reach.alias("reach"))
        .select(F.explode(F.sequence("date_idx", "reach")).alias("date_idx"))
        .groupBy("date_idx")
        .agg(F.count(F.lit(1)).alias("seen"))
    )
    by_end = (
        seen.where(F.col("date_idx") >= window - 1)
        .join(sums, "date_idx", "left")
        .select(
            "date_idx",
            F.try_divide(total - F.col("names"), pairs).alias("rolling_avg_pairwise_corr"),
            (F.coalesce("names", F.lit(0)) / F.col("seen")).alias("complete_share"),
        )
    )
    return index.join(by_end, "date_idx", "left").select("date", "rolling_avg_pairwise_corr", "complete_share")


def average_pairwise_correlation(
    panel: DataFrame, window: int = 20, value: str = "return_1d", pairs: str = "complete"
) -> DataFrame:
    """(date, rolling_avg_pairwise_corr): mean correlation of all pairs of names over the last ``window`` dates.

    ``pairs="complete"`` takes names without a gap in the window, in time linear in the names.
    ``pairs="available"`` takes for every two names the dates both have; choose it for panels
    with few gaps or few names, since its cost grows with the square of the different gap
    patterns in a window, which may be as many as the names.
    """
    if pairs == "complete":
        return complete_window_correlation(panel, window, value).select("date", "rolling_avg_pairwise_corr")
    if pairs == "available":
        return available_pairs_correlation(panel, window, value)
    raise ValueError(f"pairs must be 'complete' or 'available', not {pairs!r}")


def available_pairs_correlation(panel: DataFrame, window: int = 20, value: str = "return_1d") -> DataFrame:
    """Mean pairwise-complete correlation of all names over the last ``window`` dates.

    Names are classed by the set of window dates on which they have a value (a bit mask).  For
    two classes A and B the correlations run over the dates in both, and the sum over all
    their pairs is a product of per-date sums of the names' standard scores, so each name
    only adds to the sums of its class.  Pairs of classes are formed: a full panel has one class
    per window, a panel full of gaps as many as names.
    """
    if not 2 <= window <= 62:
        raise ValueError("window must lie between 2 and 62")
    index = date_index(panel)
    ordered = index.withColumn("last_idx", F.max("date_idx").over(Window.partitionBy()))
    vectors = _window_vectors(panel, ordered, window, value)
    classes = vectors.select("end_idx", "mask").distinct()
    blocks = classes.join(classes.withColumnRenamed("mask", "other"), "end_idx").withColumn(
        "overlap", F.col("mask").bitwiseAND(F.col("other"))
    )
    overlaps = blocks.select("end_idx", "mask", "overlap").distinct()
    known = F.map_filter("__map", lambda k, _: F.getbit(F.col("overlap"), k) == 1)
    numbers = F.map_values("__known")
    mean = F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x) / F.size("__known")
    squares = F.aggregate(
        numbers,
        F.lit(0.0),
        lambda acc, x: acc + (x - F.col("__mean")) * (x - F.col("__mean")),
    )
    scores = F.transform_values("__known", lambda _, x: (x - F.col("__mean")) / F.col("__scale"))
    scored = (
        vectors.join(overlaps, ["end_idx", "mask"])
        .withColumn("__known", known)
        .where((F.size("__known") >= 2) & (F.array_max(numbers) > F.array_min(numbers)))
        .withColumn("__mean", mean)
        .withColumn("__scale", F.sqrt(squares))
        .withColumn("__scores", scores)
    )
    per_date = F.array(
        *[F.coalesce(F.sum(F.try_element_at("__scores", F.lit(k))), F.lit(0.0)) for k in range(window)]
    )
    sums = scored.groupBy("end_idx", "mask", "overlap").agg(
        F.count(F.lit(1)).alias("names"), per_date.alias("sums")
    )
    left = sums.withColumnsRenamed({"names": "n_a", "sums": "s_a"})
    right = sums.withColumnsRenamed({"mask": "other", "names": "n_b", "sums": "s_b"})
    product = F.aggregate(
        F.zip_with("s_a", "s_b", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )
    same = F.col("mask") == F.col("other")
    by_end = (
        blocks.where(F.col("mask") <= F.col("other"))
        .join(left, ["end_idx", "mask", "overlap"])
        .join(right, ["end_idx", "other", "overlap"])
        .select(
            F.col("end_idx").alias("date_idx"),
            F.when(same, (product - F.col("n_a")) / 2).otherwise(product).alias("total"),
            F.when(same, F.col("n_a") * (F.col("n_a") - 1) / 2)
            .otherwise(F.col("n_a") * F.col("n_b"))
            .alias("pairs"),
        )
        .groupBy("date_idx")
        .agg(F.try_divide(F.sum("total"), F.sum("pairs")).alias("rolling_avg_pairwise_corr"))
    )
    return index.join(by_end, "date_idx", "left").select("date", "rolling_avg_pairwise_corr")


def with_expanding_percentiles(
    frame: DataFrame, scores: Mapping[str, tuple[str, bool]], order: str = "date"
) -> DataFrame:
    """Add per score the share of the values so far, this one included, on the lesser side of this one.

    ``scores`` maps a new column to (value column, whether higher values score higher).  The
    ``order`` column must be unique.  Missing values have no score and are not counted.

    Earlier smaller values are counted level by level of a binary tree over the places of the rows: on level k a
    row in the right half of its block of 2**(k+1) places counts the values of the left half.
    Every pair of rows meets on exactly one level, so a value is sorted once per level
    instead of being compared with all before it.
    """
    placed = frame.select(order, *{value for value, _ in scores.values()})
    known = placed.select(
        order,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("score"),
                        (F.col(value) if higher else -F.col(value)).cast("double").alias("value"),
                    )
                    for name, (value, higher) in scores.items()
                ]
            )
        ).alias("item"),
    ).select(order, "item.*").where("value IS NOT NULL")
    along = Window.partitionBy("score").orderBy(order)
    numbered = known.withColumn("place", (F.row_number().over(along) - 1).cast("bigint")).withColumn(
        "rows", F.count(F.lit(1)).over(Window.partitionBy("score"))
    )
    levels = F.greatest(F.ceil(F.log2(F.col("rows"))).cast("int"), F.lit(1))
    level = F.explode(F.sequence(F.lit(0), levels - 1)).alias("level")
    leveled = numbered.select(order, "score", "value", "place", level)
    right = F.expr("shiftright(place, level) % 2 = 1")
    block = F.expr("shiftright(place, level + 1)")
    smaller = Window.partitionBy("score", "level", "block").orderBy("value").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    met = leveled.withColumns({"right": right, "block": block}).withColumn(
        "lesser", F.sum(F.when(F.col("right"), 0).otherwise(1)).over(smaller)
    )
    counted = met.groupBy(order, "score").agg(
        F.sum(F.when(F.col("right"), F.col("lesser")).otherwise(0)).alias("beaten"), F.max("place").alias("place")
    )
    share = (F.col("beaten") + 1) / (F.col("place") + 1)
    wide = counted.groupBy(order).agg(
        *[F.max(F.when(F.col("score") == name, share)).alias(name) for name in scores]
    )
    return frame.join(wide, order, "left")


def herding_index(daily: DataFrame) -> DataFrame:
    """Expanding scores of the daily state and their mean, one row per date."""
    state = daily.withColumns(
        {
            "market_direction_agreement": F.greatest("percent_stocks_up", "percent_stocks_down"),
            "price_limit_pressure": F.col("percent_hitting_ceiling") + F.col("percent_hitting_floor"),
        }
    )
    # One row per date: kept, so that scoring does not compute the state a second time.
    scored = with_expanding_percentiles(checkpoint(state), SCORES)
    present = reduce(lambda a, b: a + b, [F.col(s).isNotNull().cast("int") for s in SCORES])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(s), F.lit(0.0)) for s in SCORES])
    return scored.withColumn("herding_index", F.try_divide(total, present))


def daily_herding(panel: DataFrame, window: int = 20, n: int = 5, pairs: str = "complete") -> DataFrame:
    state = cross_sectional_state(panel, n).join(
        average_pairwise_correlation(panel, window, pairs=pairs), "date", "left"
    )
    return herding_index(state)


def add_herding(panel: DataFrame, window: int = 20, n: int = 5, pairs: str = "complete") -> DataFrame:
    return panel.join(F.broadcast(daily_herding(panel, window, n, pairs)), "date", "left")


def extreme_herding_dates(daily: DataFrame, n: int = 5) -> DataFrame:
    columns = ["date", "herding_index", *[c for c in DAILY_COLUMNS if c in daily.columns]]
    return (
        daily.select(*columns)
        .distinct()
        .orderBy(F.col("herding_index").desc_nulls_last(), "date")
        .limit(n)
    )


def herding_state(daily: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Date, score and high-herding flag, the state used by portfolio construction."""
    score = F.first("herding_corr_score", ignorenulls=True).alias("herding_corr_score")
    return daily.groupBy("date").agg(score).withColumn(
        "high_herding_day", truthy(F.col("herding_corr_score") >= threshold)
    )
