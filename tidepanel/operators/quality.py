"""Row-level quality rules, completed-day checks and suspicious moves."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.numeric import change, truthy
from tidepanel.functions.rolling import so_far, timeline
from tidepanel.schemas import BAR_COLUMNS, PRICES
from tidepanel.session import stored

JUMP_THRESHOLD = 0.10
STALE_RUN_LENGTH = 3


def _listed(*names: str) -> Column:
    return F.concat_ws(", ", *[F.coalesce(F.col(n).cast("string"), F.lit("null")) for n in names])


def counted_copies(bars: DataFrame) -> DataFrame:
    """Distinct rows with their number of identical copies.

    Copies are merged on their own partition first, so a row repeated many times does not
    reach the per-ticker windows more than once.
    """
    return bars.select(*BAR_COLUMNS).groupBy(*BAR_COLUMNS).agg(F.count(F.lit(1)).alias("copies"))


def _with_runs(rows: DataFrame) -> DataFrame:
    """Add ``adjusted_return_1d``, ``stale_run_length`` and ``__key_rows`` along each ticker.

    The key is not unique here, so a ticker may hold any number of rows.  Only rows of one
    ticker and date are ordered together; the last price of each day and the number of runs
    it begins, one row per ticker and date, carry the order from day to day.  A run inside a day
    is summed there; only the first and the last run of a day can go on in others, and they are
    summed along the days.  So the rows themselves are moved once.
    """
    price = F.col("adjusted_close")
    key = ["ticker", "date"]
    # Rows of one key have no order of their own; the remaining columns settle it.
    tie = [c for c in BAR_COLUMNS if c not in ("date", "ticker")]
    in_day = Window.partitionBy(*key).orderBy(*tie)
    days = timeline("ticker")
    lasts = rows.groupBy(*key).agg(F.max_by("adjusted_close", F.struct(*tie)).alias("__last"))
    # Stored, so that their size is known when Spark plans the joins.
    carried = stored(lasts.select(*key, F.lag("__last").over(days).alias("__carried")), "carried")
    opened = rows.join(carried, key).withColumns(
        {"__first": F.row_number().over(in_day) == 1, "__before": F.lag(price).over(in_day)}
    )
    previous = F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__before"))
    same_price = price.eqNullSafe(F.col("__previous")) & price.isNotNull()
    stepped = stored(
        opened.withColumn("__previous", previous)
        .withColumns({"adjusted_return_1d": change(price, F.col("__previous")), "__starts": (~same_price).cast("long")})
        .withColumn("__begun", F.sum("__starts").over(so_far(in_day)))
        .withColumn("__key_rows", F.sum("copies").over(Window.partitionBy(*key)))
        .withColumn("__length", F.sum("copies").over(Window.partitionBy(*key, "__begun")))
        .drop("__first", "__before", "__carried", "__previous"),
        "stepped",
    )
    # Every row of a day's run has its length; the first run of a day has number 0 if it goes on from the day before.
    per_day = stepped.groupBy(*key).agg(
        F.max("__begun").alias("__day_runs"),
        F.max(F.when(F.col("__begun") == 0, F.col("__length"))).alias("__head"),
        F.max_by("__length", "__begun").alias("__tail"),
    )
    offset = F.sum("__day_runs").over(so_far(days)) - F.col("__day_runs")
    ends = F.array(
        F.struct(F.lit(0).cast("long").alias("begun"), F.col("__head").alias("length")),
        F.when(F.col("__day_runs") > 0, F.struct(F.col("__day_runs").alias("begun"), F.col("__tail").alias("length"))),
    )
    edges = (
        per_day.withColumn("__offset", offset)
        .select(*key, "__offset", F.explode(F.filter(ends, lambda e: e["length"].isNotNull())).alias("__end"))
        .select(*key, "__end.begun", "__end.length", (F.col("__offset") + F.col("__end.begun")).alias("__run"))
        .withColumn("__whole", F.sum("length").over(Window.partitionBy("ticker", "__run")))
    )
    wholes = stored(
        edges.groupBy(*key).agg(
            F.max(F.when(F.col("begun") == 0, F.col("__whole"))).alias("__head_whole"),
            F.max("begun").alias("__day_runs"),
            F.max_by("__whole", "begun").alias("__tail_whole"),
        ),
        "runs",
    )
    length = (
        F.when(price.isNull(), F.lit(1))
        .when(F.col("__begun") == 0, F.col("__head_whole"))
        .when(F.col("__begun") == F.col("__day_runs"), F.col("__tail_whole"))
        .otherwise(F.col("__length"))
    )
    return stepped.join(wholes, key).withColumn("stale_run_length", length)


def data_issues(
    bars: DataFrame,
    jump_threshold: float = JUMP_THRESHOLD,
    stale_run_length: int = STALE_RUN_LENGTH,
) -> DataFrame:
    """One row per (distinct bar, broken rule) with the values that break it and its copies."""
    tracked = _with_runs(stored(counted_copies(bars), "counted"))
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in BAR_COLUMNS])
    any_missing = F.lit(False)
    for name in BAR_COLUMNS:
        any_missing = any_missing | F.col(name).isNull()
    any_low_price = F.lit(False)
    for name in PRICES:
        any_low_price = any_low_price | truthy(F.col(name) <= 0)
    o, h, l, c = F.col("open"), F.col("high"), F.col("low"), F.col("close")
    rules: list[tuple[str, Column, Column]] = [
        ("missing_values", any_missing, F.concat(F.lit("missing:"), missing)),
        ("duplicate_ticker_date", F.col("__key_rows") > 1, _listed("open", "high", "low", "close")),
        ("non_positive_volume", F.col("volume") <= 0, _listed("volume")),
        ("non_positive_value_traded", F.col("value_traded") <= 0, _listed("value_traded")),
        ("non_positive_price", any_low_price, _listed(*PRICES)),
        ("high_below_low", h < l, _listed("high", "low")),
        ("open_outside_daily_range", (o < l) | (o > h), _listed("open", "low", "high")),
        ("close_outside_daily_range", (c < l) | (c > h), _listed("close", "low", "high")),
        (
            "suspicious_adjusted_close_jump",
            F.abs("adjusted_return_1d") > jump_threshold,
            _listed("adjusted_close", "adjusted_return_1d"),
        ),
        (
            "stale_adjusted_close",
            F.col("stale_run_length") >= stale_run_length,
            _listed("adjusted_close", "stale_run_length"),
        ),
    ]
    found = F.filter(
        F.array(
            *[
                F.when(truthy(test), F.struct(F.lit(name).alias("issue"), details.alias("details")))
                for name, test, details in rules
            ]
        ),
        lambda x: x.isNotNull(),
    )
    flagged = tracked.withColumn("__found", F.explode(found)).select(
        "date", "ticker", "__found.issue", "__found.details", "copies"
    )
    # Only the first of identical copies can jump; every copy breaks the other rules.
    first_only = F.col("issue") == "suspicious_adjusted_close_jump"
    return flagged.withColumn("copies", F.when(first_only, F.lit(1).cast("bigint")).otherwise(F.col("copies")))


def expand_copies(issues: DataFrame, chunk: int = 1000) -> DataFrame:
    """One row per copy.

    A row with many copies is first cut into chunks that are spread over the cluster, so
    no task writes all of them.
    """
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / chunk).cast("bigint"))
    size = F.least(F.lit(chunk).cast("bigint"), F.col("copies") - F.col("__chunk") * chunk).cast("int")
    return (
        issues.withColumn("__chunk", F.explode(chunks))
        .repartition("date", "ticker", "issue", "__chunk")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), size)))
        .select("date", "ticker", "issue", "details")
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    """Counts by issue, by ticker and by date from one pass over the issues."""
    counted = issues.groupingSets(
        [[F.col("issue")], [F.col("ticker")], [F.col("date")]],
        F.col("issue"), F.col("ticker"), F.col("date"),
    ).agg(F.sum("copies").alias("issue_count"), F.grouping_id().alias("__set"))
    level = F.when(F.col("__set") == 3, "issue").when(F.col("__set") == 5, "ticker").otherwise("date")
    key = F.coalesce(F.col("issue"), F.col("ticker"), F.col("date").cast("string"))
    return counted.select(level.alias("level"), key.alias("key"), "issue_count")


def first_issues(issues: DataFrame, n: int = 200) -> DataFrame:
    return issues.orderBy("date", "ticker", "issue", "details").limit(n)


def quality_overview(bars: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: size, date range, number of issues and status."""
    facts = bars.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct("ticker").alias("ticker_count"),
        F.countDistinct("date").alias("date_count"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    total = issues.agg(F.sum("copies").alias("issue_count"))
    # Each side is one row with its own columns; the aggregate lays them over each other.
    return (
        facts.unionByName(total, allowMissingColumns=True)
        .agg(
            *[F.max(c).alias(c) for c in facts.columns],
            F.coalesce(F.max("issue_count"), F.lit(0).cast("bigint")).alias("issue_count"),
        )
        .withColumn("status", F.when(F.col("issue_count") == 0, "PASS").otherwise("REVIEW"))
    )


def completed_day_checks(
    bars: DataFrame, universe: DataFrame, expected_date: dt.date | None = None
) -> DataFrame:
    """(rule, severity, ticker) for every violated rule of the latest date.

    Covers the ticker set against the universe, price presence, sign and ranges, volume
    and traded value, repeated keys in the whole table and the latest date itself.
    """
    latest = bars.agg(F.max("date").alias("date"))
    day = bars.join(F.broadcast(latest), "date", "left_semi")
    members = universe.select("ticker").distinct().withColumn("__expected", F.lit(True))
    joined = day.withColumn("__observed", F.lit(True)).join(members, "ticker", "full_outer")
    expected, observed = F.col("__expected").isNotNull(), F.col("__observed").isNotNull()
    o, h, l, c = F.col("open"), F.col("high"), F.col("low"), F.col("close")
    prices = [F.col(p) for p in PRICES]
    any_null, any_low = F.lit(False), F.lit(False)
    for p in prices:
        any_null = any_null | p.isNull()
        any_low = any_low | truthy(p <= 0)
    bad_range = truthy((h < l) | (o < l) | (o > h) | (c < l) | (c > h))
    checks = [
        ("missing_ticker", "error", expected & ~observed),
        ("unexpected_ticker", "error", observed & ~expected),
        ("missing_price", "error", observed & any_null),
        ("non_positive_price", "error", observed & any_low),
        ("invalid_range", "error", observed & bad_range),
        ("non_positive_volume", "warning", observed & F.coalesce(F.col("volume") <= 0, F.lit(True))),
        ("non_positive_value", "warning", observed & F.coalesce(F.col("value_traded") <= 0, F.lit(True))),
    ]
    found = F.filter(
        F.array(
            *[
                F.when(test, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")))
                for name, severity, test in checks
            ]
        ),
        lambda x: x.isNotNull(),
    )
    rows = joined.withColumn("__found", F.explode(found)).select("__found.rule", "__found.severity", "ticker")
    repeated = (
        bars.groupBy("date", "ticker").count().where("count > 1")
        .groupBy("ticker").count()
        .select(F.lit("duplicate_key").alias("rule"), F.lit("error").alias("severity"), "ticker")
    )
    result = rows.unionByName(repeated)
    if expected_date is not None:
        wrong = latest.where(F.col("date") != F.lit(expected_date)).select(
            F.lit("unexpected_latest_date").alias("rule"),
            F.lit("error").alias("severity"),
            F.lit(None).cast("string").alias("ticker"),
        )
        result = result.unionByName(wrong)
    return result


def require_valid_day(checks: DataFrame) -> None:
    """Fail the job when a check of error severity was violated."""
    errors = checks.where("severity = 'error'").limit(10).collect()
    if errors:
        raise ValueError(f"Market data is not usable, for example {[tuple(r) for r in errors]}")


def suspicious_moves(bars: DataFrame, threshold: float, start_date: dt.date | None = None) -> DataFrame:
    """Moves beyond the threshold from a date on, measured against the row before."""
    series = timeline("ticker")
    moved = bars.select(
        "date",
        "ticker",
        "adjusted_close",
        change("adjusted_close", F.lag("adjusted_close").over(series)).alias("adjusted_return"),
    ).where(F.abs("adjusted_return") > threshold)
    return moved if start_date is None else moved.where(F.col("date") >= F.lit(start_date))
