"""Shared SQL relations and Spark frames of the test panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import relation
from tidepanel.plans.features import score_predictions, standard_labels, time_features
from tidepanel.session import checkpoint
from tidepanel.sources.bars import brand_bars, brand_universe, supplier_bars


def bars(spark: SparkSession, folder: str) -> DataFrame:
    return brand_bars(spark, folder)


def wide(spark: SparkSession, folder: str) -> DataFrame:
    return supplier_bars(spark, folder)


def universe(spark: SparkSession, folder: str) -> DataFrame:
    return brand_universe(spark, folder)


def features(spark: SparkSession, folder: str) -> DataFrame:
    return time_features(bars(spark, folder))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return standard_labels(bars(spark, folder))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Stored like a model's predictions would be, since every metric reads them several times."""
    return checkpoint(score_predictions(bars(spark, folder)))


def membership(spark: SparkSession, folder: str) -> DataFrame:
    """Brand n joins in week 4n; every third brand leaves in week 300."""
    number = F.regexp_extract("ticker", r"(\d+)$", 1).cast("int")
    start = F.lit("1995-01-02").cast("date")
    return universe(spark, folder).select(
        "ticker",
        F.date_add(start, number * 28).alias("effective_from"),
        F.when(number % 3 == 0, F.date_add(start, 2100)).alias("effective_to"),
    )


def _bars_sql(source: str) -> str:
    return f"""
    SELECT CAST(date_trunc('week', day) AS DATE) AS date, ticker,
           arg_min(mean_price, day) AS open, max(high) AS high, min(low) AS low,
           arg_max(mean_price, day) AS close,
           CAST(sum(cents) AS DOUBLE) / 100 / CAST(sum(quantity) AS DOUBLE) AS adjusted_close,
           CAST(sum(quantity) AS BIGINT) AS volume,
           CAST(sum(cents) AS DOUBLE) / 100 AS value_traded
    FROM (SELECT ticker, day, sum(quantity) AS quantity, sum(cents) AS cents,
                 min(price) AS low, max(price) AS high,
                 CAST(sum(cents) AS DOUBLE) / 100 / CAST(sum(quantity) AS DOUBLE) AS mean_price
          FROM (SELECT ticker, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS BIGINT) AS quantity,
                       CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
                       l_extendedprice / l_quantity AS price
                FROM ({source}))
          GROUP BY ticker, day)
    GROUP BY 1, 2"""


relation(
    "bars",
    _bars_sql("SELECT p_brand AS ticker, lineitem.* FROM lineitem JOIN part ON l_partkey = p_partkey"),
)
relation(
    "wide_bars",
    _bars_sql("SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS ticker, * FROM lineitem"),
)
relation(
    "names",
    """SELECT DISTINCT p_brand AS ticker,
       'G' || CAST((CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) - 1) // 4 AS VARCHAR) AS issuer_group,
       'S' || CAST(CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 5 AS VARCHAR) AS sector
       FROM part""",
)
relation(
    "members",
    """SELECT ticker, DATE '1995-01-02' + 28 * n AS effective_from,
              CASE WHEN n % 3 = 0 THEN DATE '1995-01-02' + 2100 END AS effective_to
       FROM (SELECT ticker, CAST(regexp_extract(ticker, '(\\d+)$', 1) AS INT) AS n FROM names)""",
)
relation("date_list", "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS date_idx FROM (SELECT DISTINCT date FROM bars)")

_W = "PARTITION BY ticker ORDER BY date"


def lag_return(k: int, price: str = "adjusted_close") -> str:
    return f"{price} / lag({price}, {k}) OVER ({_W}) - 1"


def rolled(aggregate: str, value: str, rows: int, at_least: int | None = None) -> str:
    frame = f"({_W} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    need = rows if at_least is None else at_least
    return f"CASE WHEN count({value}) OVER {frame} >= {need} THEN {aggregate}({value}) OVER {frame} END"


def tick(price: str) -> str:
    return f"(CASE WHEN {price} < 10 THEN 0.01::DOUBLE WHEN {price} < 50 THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END)"


def tick_down(price: str) -> str:
    return f"(round_even(({price} - ({price} % {tick(price)})) / {tick(price)}, 0) * {tick(price)})"


def tick_up(price: str) -> str:
    return (
        f"((round_even(({price} - ({price} % {tick(price)})) / {tick(price)}, 0)"
        f" + CASE WHEN ({price} % {tick(price)}) <> 0 THEN 1 ELSE 0 END) * {tick(price)})"
    )


relation(
    "moves",
    f"""SELECT *, {', '.join(f'{lag_return(k)} AS return_{k}d' for k in (1, 3, 5, 10, 20, 60))},
        adjusted_close / ({rolled('max', 'adjusted_close', 20)}) - 1 AS distance_from_20d_high,
        adjusted_close / ({rolled('min', 'adjusted_close', 20)}) - 1 AS distance_from_20d_low,
        {rolled('avg', 'volume', 20)} AS average_daily_volume_20d,
        {rolled('avg', 'value_traded', 20)} AS average_daily_value_20d,
        adjusted_close / max(adjusted_close) OVER ({_W}) - 1 AS drawdown,
        lag(close) OVER ({_W}) AS reference_price
        FROM bars""",
)
relation(
    "limits",
    f"""SELECT *, (estimated_ceiling_price - close) / close AS distance_to_ceiling,
        (close - estimated_floor_price) / close AS distance_to_floor,
        coalesce(high >= estimated_ceiling_price, false) AS hit_ceiling_today,
        coalesce(low <= estimated_floor_price, false) AS hit_floor_today,
        coalesce(close >= estimated_ceiling_price, false) AS close_at_ceiling_today,
        coalesce(close <= estimated_floor_price, false) AS close_at_floor_today
        FROM (SELECT *, {tick_down('(reference_price * 1.07::DOUBLE)')} AS estimated_ceiling_price,
                     {tick_up('(reference_price * 0.9299999999999999::DOUBLE)')} AS estimated_floor_price FROM moves)""",
)
relation(
    "vols",
    f"""SELECT date, ticker, {rolled('stddev_samp', 'return_1d', 20)} * sqrt(252) AS rolling_vol_20d FROM moves""",
)
relation(
    "forwards",
    "SELECT date, ticker, "
    + ", ".join(f"lead(adjusted_close, {h}) OVER ({_W}) / adjusted_close - 1 AS forward_return_{h}d" for h in (1, 5, 10))
    + " FROM bars",
)
relation(
    "loo",
    "SELECT *, "
    + ", ".join(f"forward_return_{h}d - benchmark_forward_return_{h}d AS forward_relative_return_{h}d" for h in (1, 5, 10))
    + " FROM (SELECT *, "
    + ", ".join(
        f"(sum(forward_return_{h}d) OVER (PARTITION BY date) - forward_return_{h}d)"
        f" / nullif(count(forward_return_{h}d) OVER (PARTITION BY date) - 1, 0) AS benchmark_forward_return_{h}d"
        for h in (1, 5, 10)
    )
    + " FROM forwards)",
)
relation(
    "scored",
    """SELECT m.date, m.ticker, return_10d, -distance_from_20d_high AS reversal, forward_relative_return_5d AS actual_return
       FROM moves m JOIN loo USING (date, ticker)""",
)
relation(
    "preds",
    """SELECT * FROM (
         SELECT date, ticker, 'momentum' AS model_name, return_10d AS predicted_return, actual_return FROM scored
         UNION ALL
         SELECT date, ticker, 'reversal', reversal, actual_return FROM scored)
       WHERE predicted_return IS NOT NULL AND actual_return IS NOT NULL""",
)
