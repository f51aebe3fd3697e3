"""Distribution drift between a reference and a recent window of dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.ranking import group_quantiles

EPSILON = 1e-6
SIGNIFICANT = 0.25
MODERATE = 0.10


def long_features(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, window, date, ticker, value) rows."""
    numeric = frame.select(
        "date", "ticker", "window", *[F.col(c).cast("double").alias(c) for c in features]
    )
    return numeric.unpivot(["date", "ticker", "window"], list(features), "feature", "value")


def split_windows(
    features: DataFrame, reference_dates: int = 756, recent_dates: int = 126
) -> DataFrame:
    """Rows of the last ``recent_dates`` dates and the ``reference_dates`` before, marked."""
    newest_first = F.row_number().over(Window.orderBy(F.col("date").desc()))
    dates = features.select("date").distinct().withColumn("__place", newest_first)
    window = (
        F.when(F.col("__place") <= recent_dates, "recent")
        .when(F.col("__place") <= recent_dates + reference_dates, "reference")
    )
    marked = dates.withColumn("window", window).where(F.col("window").isNotNull()).select("date", "window")
    return features.join(F.broadcast(marked), "date")


def stability_index(long: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index per feature, all features in one plan.

    Bin edges are the distinct quantiles of the reference values, open at both ends; a
    feature with fewer than three distinct edges gets a narrow middle bin around its
    first reference value.
    """
    known = long.where(F.col("value").isNotNull())
    reference = known.where(F.col("window") == "reference")
    names = [f"q{i}" for i in range(bins + 1)]
    quantiles = group_quantiles(
        reference, ["feature"], "value", {name: i / bins for i, name in enumerate(names)}
    )
    distinct = F.array_distinct(F.array(*names))
    # Few features are this narrow; only their rows are searched for the first value.
    narrow = quantiles.where(F.size(distinct) < 3).select("feature")
    center = (
        reference.join(F.broadcast(narrow), "feature", "left_semi")
        .groupBy("feature")
        .agg(F.min_by("value", F.struct("date", "ticker")).alias("center"))
    )
    tolerance = F.greatest(F.abs("center") * 1e-6, F.lit(1e-6))
    # Inner edges only: a value's bin is the number of inner edges at or below it.
    edges = quantiles.join(center, "feature", "left").select(
        "feature",
        F.when(
            F.size(distinct) < 3, F.array(F.col("center") - tolerance, F.col("center") + tolerance)
        )
        .otherwise(F.slice(distinct, F.lit(2), F.size(distinct) - 2))
        .alias("inner"),
    )
    # One row per feature: bounded by the number of columns.
    binned = known.join(F.broadcast(edges), "feature").withColumn(
        "bin", F.size(F.filter("inner", lambda e: e <= F.col("value")))
    )
    counts = binned.groupBy("feature", "bin").agg(
        F.count_if(F.col("window") == "reference").alias("reference_rows"),
        F.count_if(F.col("window") == "recent").alias("recent_rows"),
    )
    spine = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin"))
    filled = spine.join(counts, ["feature", "bin"], "left").na.fill(0)
    per_feature = Window.partitionBy("feature")

    def smoothed(column: str):
        rows = F.sum(column).over(per_feature)
        return (F.col(column) + EPSILON) / (rows + EPSILON * F.count(F.lit(1)).over(per_feature))

    p, q = F.col("p"), F.col("q")
    shares = filled.withColumns({"p": smoothed("reference_rows"), "q": smoothed("recent_rows")})
    result = shares.groupBy("feature").agg(
        F.sum((q - p) * F.log(q / p)).alias("psi"),
        F.sum("reference_rows").alias("__reference"),
        F.sum("recent_rows").alias("__recent"),
    )
    usable = (F.col("__reference") >= bins) & (F.col("__recent") > 0)
    return result.select("feature", F.when(usable, F.col("psi")).alias("psi"))


def drift_report(
    features: DataFrame,
    columns: Sequence[str],
    reference_dates: int = 756,
    recent_dates: int = 126,
    bins: int = 10,
) -> DataFrame:
    """Stability index, status, means and missing rates per feature."""
    long = long_features(split_windows(features, reference_dates, recent_dates), columns)

    def of(window: str, value):
        return F.avg(F.when(F.col("window") == window, value))

    missing = F.col("value").isNull().cast("double")
    facts = long.groupBy("feature").agg(
        of("reference", F.col("value")).alias("reference_mean"),
        of("recent", F.col("value")).alias("recent_mean"),
        of("reference", missing).alias("reference_missing_rate"),
        of("recent", missing).alias("recent_missing_rate"),
    )
    psi = F.col("psi")
    status = (
        F.when(psi >= SIGNIFICANT, "significant_shift")
        .when(psi >= MODERATE, "moderate_shift")
        .otherwise("stable")
    )
    return (
        stability_index(long, bins)
        .where(psi.isNotNull())
        .withColumn("drift_status", status)
        .join(facts, "feature")
    )


def enough_dates(features: DataFrame, needed: int) -> DataFrame:
    """One row: available dates and whether the two windows fit."""
    return features.agg(F.countDistinct("date").alias("available_dates")).withColumn(
        "sufficient", F.col("available_dates") >= needed
    )
