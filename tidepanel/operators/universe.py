"""Point-in-time membership: interval checks, joins and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def _end(column: str = "effective_to") -> Column:
    return F.coalesce(F.col(column), F.lit(OPEN_END).cast("date"))


def normalise_membership(membership: DataFrame) -> DataFrame:
    """Trimmed upper-case tickers and dates; a blank end is open."""
    def as_date(name: str) -> Column:
        return F.nullif(F.trim(F.col(name).cast("string")), F.lit("")).cast("date").alias(name)

    return membership.select(
        F.upper(F.trim("ticker")).alias("ticker"), as_date("effective_from"), as_date("effective_to")
    )


def membership_problems(membership: DataFrame) -> DataFrame:
    """Blank tickers, reversed ranges and intervals that touch an earlier one."""
    order = Window.partitionBy("ticker").orderBy("effective_from", _end())
    earlier = F.max(_end()).over(order.rowsBetween(Window.unboundedPreceding, -1))
    problem = (
        F.when(F.coalesce(F.col("ticker"), F.lit("")) == "", "blank_ticker")
        .when(F.col("effective_from").isNull(), "missing_start")
        .when(_end() < F.col("effective_from"), "reversed_range")
        .when(F.col("effective_from") <= F.col("__earlier"), "overlap")
    )
    return (
        membership.withColumn("__earlier", earlier)
        .withColumn("problem", problem)
        .where("problem IS NOT NULL")
        .drop("__earlier")
    )


def _inside() -> Column:
    return (F.col("date") >= F.col("effective_from")) & (F.col("date") <= _end())


def point_in_time(market: DataFrame, membership: DataFrame) -> DataFrame:
    """Market rows whose ticker was a member on that date, both ends included.

    The join key is the ticker; the interval test runs on the matches.  Membership that
    passed ``membership_problems`` matches each row at most once.
    """
    return market.join(membership, "ticker").where(_inside()).select(*market.columns)


def ambiguous_members(market: DataFrame, membership: DataFrame) -> DataFrame:
    """Market keys that match more than one interval."""
    return (
        market.select("date", "ticker")
        .join(membership, "ticker")
        .where(_inside())
        .groupBy("date", "ticker")
        .agg(F.count(F.lit(1)).alias("matches"))
        .where("matches > 1")
    )


def membership_coverage(membership: DataFrame, dates: DataFrame, expected: int = 30) -> DataFrame:
    """Members per market date.

    Every interval adds one at its first market date and removes one after its last, so
    the count is a running sum over the calendar instead of a join of dates and
    intervals.  Intervals of one ticker that overlap are merged first.
    """
    order = Window.partitionBy("ticker").orderBy("effective_from", _end())
    before = F.max(_end()).over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        membership.withColumn("__new", (F.col("effective_from") > before) | before.isNull())
        .withColumn("__island", F.count_if("__new").over(order))
        .groupBy("ticker", "__island")
        .agg(F.min("effective_from").alias("first"), F.max(_end()).alias("last"))
    )
    steps = merged.select(
        F.explode(
            F.array(
                F.struct(F.col("first").alias("date"), F.lit(1).alias("step")),
                F.struct(F.date_add("last", 1).alias("date"), F.lit(-1).alias("step")),
            )
        ).alias("change")
    ).select("change.*")
    market = dates.select("date").distinct().select("date", F.lit(0).alias("step"), F.lit(1).alias("is_market"))
    timeline = (
        steps.groupBy("date").agg(F.sum("step").alias("step")).withColumn("is_market", F.lit(0)).unionByName(market)
        .groupBy("date")
        .agg(F.sum("step").alias("step"), F.max("is_market").alias("is_market"))
    )
    members = F.sum("step").over(
        Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        timeline.withColumn("active_constituents", members.cast("bigint"))
        .where("is_market = 1")
        .select(
            "date",
            "active_constituents",
            F.lit(expected).cast("bigint").alias("expected_constituents"),
            (F.col("active_constituents") == expected).alias("coverage_complete"),
        )
    )


def coverage_audit(market: DataFrame, membership: DataFrame, expected: int = 30) -> DataFrame:
    """Per market date: members, market rows of members and whether the date is complete."""
    coverage = membership_coverage(membership, market, expected)
    held = point_in_time(market, membership).groupBy("date").agg(
        F.count(F.lit(1)).alias("member_rows")
    )
    return coverage.join(held, "date", "left").withColumn(
        "member_rows", F.coalesce("member_rows", F.lit(0).cast("bigint"))
    )
