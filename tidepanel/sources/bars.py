"""Bar panels: CSV scan, provider rows, and panels derived from sales lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.numeric import no_nan
from tidepanel.schemas import BAR_COLUMNS, BAR_SCHEMA, PRICES


def _require(frame: DataFrame, columns: list[str], what: str) -> None:
    missing = sorted(set(columns) - set(frame.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")


def clean_ticker(column: str = "ticker") -> Column:
    return F.upper(F.trim(F.col(column)))


def typed_bars(raw: DataFrame) -> DataFrame:
    """Cast text columns to the bar schema; a malformed value fails the job."""
    lowered = raw.toDF(*[name.strip().lower() for name in raw.columns])
    _require(lowered, BAR_COLUMNS, "Bar data")
    numbers = [
        no_nan(F.nullif(F.trim(F.col(f.name).cast("string")), F.lit("")).cast("double"))
        .cast(f.dataType)
        .alias(f.name)
        for f in BAR_SCHEMA
        if f.name not in ("date", "ticker")
    ]
    extra = [name for name in lowered.columns if name not in BAR_COLUMNS]
    return lowered.select(
        F.col("date").cast("date").alias("date"), clean_ticker().alias("ticker"), *numbers, *extra
    )


def read_bars_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Daily bars from CSV files with a header."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    return typed_bars(raw)


def normalise_provider_rows(raw: DataFrame, ticker: str | None = None, strict: bool = True) -> DataFrame:
    """Bring landed provider rows to the bar schema.

    ``time`` stands in for a missing ``date``; the adjusted close defaults to the close and
    traded value to close times volume.  ``strict`` fails on text that is no number,
    otherwise such values become null.
    """
    frame = raw.toDF(*[name.strip().lower() for name in raw.columns])
    if "date" not in frame.columns and "time" in frame.columns:
        frame = frame.withColumnRenamed("time", "date")
    if "ticker" not in frame.columns:
        if ticker is None:
            raise ValueError("Provider rows carry no ticker and none was given")
        frame = frame.withColumn("ticker", F.lit(ticker))
    _require(frame, ["date", "open", "high", "low", "close", "volume"], "Provider data")

    def number(name: str) -> Column:
        text = F.col(name)
        return no_nan(text.cast("double") if strict else text.try_cast("double"))

    close, volume = number("close"), number("volume")
    adjusted = number("adjusted_close") if "adjusted_close" in frame.columns else close
    return frame.select(
        F.col("date").cast("date").alias("date"),
        clean_ticker().alias("ticker"),
        *[number(name).alias(name) for name in PRICES[:4]],
        F.coalesce(adjusted, close).alias("adjusted_close"),
        volume.cast("bigint").alias("volume"),
        (close * volume).alias("value_traded"),
    )


def duplicate_keys(bars: DataFrame) -> DataFrame:
    return bars.groupBy("date", "ticker").count().where("count > 1")


def numeric_columns(frame: DataFrame, keep: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """Cast each text column to double when every non-null value is a number."""
    texts = [f.name for f in frame.schema if isinstance(f.dataType, T.StringType) and f.name not in keep]
    if not texts:
        return frame
    bad = frame.agg(
        *[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in texts]
    ).first()
    return frame.withColumns({c: F.col(c).cast("double") for c in texts if bad[c] == 0})


def bars_from_sales(lines: DataFrame, period: str = "week") -> DataFrame:
    """Bars from (ticker, l_shipdate, l_quantity, l_extendedprice) sales lines.

    Lines are first reduced to one row per ticker and day on their own partition, so a
    ticker with a large part of all lines shuffles only its day totals.  Money is summed
    in whole cents, which keeps sums exact whatever the order.  Open and close are the
    mean prices of the first and last day with sales in the period.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    days = (
        lines.select(
            "ticker",
            F.to_date("l_shipdate").alias("day"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
            price.alias("price"),
        )
        .groupBy("ticker", "day")
        .agg(
            F.sum("quantity").alias("quantity"),
            F.sum("cents").alias("cents"),
            F.min("price").alias("low"),
            F.max("price").alias("high"),
        )
        .withColumn("mean_price", F.col("cents") / F.lit(100.0) / F.col("quantity"))
    )
    value = F.sum("cents") / F.lit(100.0)
    return (
        days.withColumn("date", F.to_date(F.date_trunc(period, F.col("day").cast("timestamp_ntz"))))
        .groupBy("date", "ticker")
        .agg(
            F.min_by("mean_price", "day").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("mean_price", "day").alias("close"),
            (value / F.sum("quantity")).alias("adjusted_close"),
            F.sum("quantity").alias("volume"),
            value.alias("value_traded"),
        )
    )


def brand_bars(spark: SparkSession, folder: str, period: str = "week") -> DataFrame:
    """One ticker per part brand."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    parts = spark.read.parquet(f"{folder}/part.parquet").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker")
    )
    return bars_from_sales(lines.join(parts, "l_partkey"), period)


def supplier_bars(spark: SparkSession, folder: str, period: str = "week") -> DataFrame:
    """One ticker per supplier: the wide panel, with gaps."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    ticker = F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    return bars_from_sales(lines.withColumn("ticker", ticker), period)


def brand_universe(spark: SparkSession, folder: str) -> DataFrame:
    """Ticker, issuer group and sector per brand."""
    number = F.regexp_extract("ticker", r"(\d+)$", 1).cast("int")
    return (
        spark.read.parquet(f"{folder}/part.parquet")
        .select(F.col("p_brand").alias("ticker"))
        .distinct()
        .select(
            "ticker",
            F.concat(F.lit("G"), F.floor((number - 1) / 4).cast("string")).alias("issuer_group"),
            F.concat(F.lit("S"), (number % 5).cast("string")).alias("sector"),
        )
    )


def read_universe_csv(spark: SparkSession, path: str) -> DataFrame:
    """Universe dimension; ``universe_problems`` lists rows that break its rules."""
    raw = spark.read.option("header", True).csv(path)
    frame = raw.toDF(*[name.strip().lower() for name in raw.columns])
    _require(frame, ["ticker", "issuer_group"], "Universe")
    return frame.select(
        clean_ticker().alias("ticker"),
        *[F.trim(F.col(c)).alias(c) for c in frame.columns if c != "ticker"],
    )


def universe_problems(universe: DataFrame) -> DataFrame:
    """Blank or repeated tickers and blank groups."""
    texts = [c for c in ("ticker", "issuer_group", "sector") if c in universe.columns]
    blank = universe.select(
        "ticker",
        F.explode(
            F.filter(
                F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"blank_{c}")) for c in texts]),
                lambda x: x.isNotNull(),
            )
        ).alias("problem"),
    )
    repeated = universe.groupBy("ticker").count().where("count > 1").select(
        "ticker", F.lit("duplicate_ticker").alias("problem")
    )
    return blank.unionByName(repeated)
