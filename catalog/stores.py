"""Queries that write tables to the session's shared folder and read them back."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import panel
from catalog.accounts import _kept_orders
from catalog.registry import query
from tidepanel.operators import ingest, splits
from tidepanel.schemas import BAR_SCHEMA, LEDGERS
from tidepanel.session import checkpoint, working_folder
from tidepanel.sources import bars as sb
from tidepanel.sources import ledgers as sl
from tidepanel.sources import tables
from tidepanel.streaming import incremental as inc

BARS = "date ticker open:5s high:5s low:5s close:5s adjusted_close:5s volume:i value_traded:4s"
CUT = "DATE '2001-01-01'"


@query("a01_csv_bars", BARS, "SELECT * FROM bars")
def _csv_bars(spark, folder):
    path = working_folder(spark, "bars-csv")
    # Headers in other cases and blanks around names are part of what the scan puts right.
    raw = panel.bars(spark, folder).withColumn("ticker", F.concat(F.lit(" "), F.lower("ticker"), F.lit(" ")))
    raw.withColumnsRenamed({"date": "Date", "value_traded": "VALUE_TRADED"}).write.option("header", True).csv(path)
    brand = F.regexp_replace("ticker", "^BRAND", "Brand")
    return sb.read_bars_csv(spark, path).withColumn("ticker", brand)


@query("b01_numeric_columns", "date ticker close:5s volume:4s note", "SELECT date, ticker, close, volume::DOUBLE AS volume, CASE WHEN volume % 2 = 0 THEN 'even' ELSE '7' END AS note FROM bars")
def _numeric(spark, folder):
    """Numbers kept as text become numbers; a column with one word in it stays text."""
    texts = panel.bars(spark, folder).select(
        "date", "ticker", F.col("close").cast("string").alias("close"), F.col("volume").cast("string").alias("volume"),
        F.when(F.col("volume") % 2 == 0, "even").otherwise("7").alias("note"),
    )
    return sb.numeric_columns(texts)


_LATER = f"date >= (SELECT max(date) - 14 FROM bars WHERE date < {CUT})"
_MERGED = "SELECT date, ticker, " + ", ".join(
    f"CASE WHEN {_LATER} THEN {c} * 1.01::DOUBLE ELSE {c} END AS {c}" for c in ("open", "high", "low", "close")
) + ", adjusted_close, volume, value_traded FROM bars"


def _corrected(spark, folder):
    """What a provider sends later: every price one percent higher, for far more days than the overlap."""
    rows = panel.bars(spark, folder).where(f"date >= {CUT} - INTERVAL 90 DAYS")
    return rows.withColumns({c: F.col(c) * F.lit(1.01) for c in ("open", "high", "low", "close")})


@query("a06_daily_update", BARS, _MERGED)
def _daily_update(spark, folder):
    before = checkpoint(panel.bars(spark, folder).where(f"date < {CUT}"))
    landed = checkpoint(_corrected(spark, folder))
    last = landed.agg(F.max("date")).first()[0]
    present = landed.where(F.col("date") == F.lit(last)).select("ticker")
    return ingest.daily_update(before, landed, present, last).data


@query("n01_merged_bars", BARS, _MERGED)
def _merged_bars(spark, folder):
    """The streaming merge: a first batch, a corrected one, and a refused one that changes nothing."""
    path = working_folder(spark, "merge")
    target = f"{path}/bars"
    first = checkpoint(panel.bars(spark, folder).where(f"date < {CUT}").select(*BAR_SCHEMA.fieldNames()))
    last = first.agg(F.max("date")).first()[0]
    inc.apply_batch(first, target, f"{path}/batch-0", last)
    second = checkpoint(_corrected(spark, folder).select(*BAR_SCHEMA.fieldNames()))
    end = second.agg(F.max("date")).first()[0]
    inc.apply_batch(second, target, f"{path}/batch-1", end)
    third = second.where(F.col("date") >= F.lit(end)).withColumn("date", F.date_add("date", 7))
    inc.apply_batch(third, target, f"{path}/batch-2", end)
    return inc.stored_bars(spark, target)


@query(
    "n01_refused_rows",
    "problem rows:i",
    f"""SELECT 'after_window' AS problem, count(*) AS rows FROM bars WHERE date > {CUT}
        UNION ALL SELECT 'close_changed', count(*) FROM bars WHERE date < {CUT} AND date >= (SELECT max(date) - 14 FROM bars WHERE date < {CUT}) AND volume % 2 = 0
        UNION ALL SELECT 'duplicate_key', count(*) FROM bars WHERE date >= (SELECT max(date) - 14 FROM bars WHERE date < {CUT}) AND volume % 3 = 0""",
)
def _refused(spark, folder):
    """A batch that breaks three rules at once, against the bars before the cut."""
    before = checkpoint(panel.bars(spark, folder).where(f"date < {CUT}"))
    latest = before.agg(F.max("date")).first()[0]
    start = latest - dt.timedelta(days=14)
    batch = panel.bars(spark, folder).where(F.col("date") >= F.lit(start))
    doubled = batch.withColumn("close", F.when(F.col("volume") % 2 == 0, F.col("close") * 2).otherwise(F.col("close")))
    rows = checkpoint(doubled.unionByName(doubled.where("volume % 3 = 0")))
    # The overlap rule compares each stored key with every landed row of it; one is enough here.
    problems = inc.batch_problems(before, rows, dt.date(2001, 1, 1), start, 0.05).distinct()
    return problems.groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


@query("a07_staged_bars", BARS, "SELECT * FROM bars")
def _staged(spark, folder):
    path = working_folder(spark, "staged")
    tables.staged_write(checkpoint(panel.bars(spark, folder)), f"{path}/bars", f"{path}/staging")
    return spark.read.parquet(f"{path}/bars")


@query("a08_report_table", "ticker rows:i last_close:5s", "SELECT ticker, count(*) AS rows, arg_max(close, date) AS last_close FROM bars GROUP BY 1")
def _report(spark, folder):
    path = working_folder(spark, "report")
    report = panel.bars(spark, folder).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.max_by("close", "date").alias("last_close"))
    tables.write_report(report, path)
    return spark.read.option("header", True).csv(path)


@query(
    "a09_stage_input",
    "date ticker close:5s source",
    f"SELECT date, ticker, close, 'new' AS source FROM bars WHERE date >= {CUT} UNION ALL SELECT date, ticker, close, NULL FROM bars WHERE date < {CUT}",
)
def _stage_input(spark, folder):
    """Two stage tables of different columns and one that was never written, read as one."""
    path = working_folder(spark, "stages")
    rows = checkpoint(panel.bars(spark, folder))
    kept = ["date", "ticker", "close"]
    old = tables.write_stage(rows.where(f"date < {CUT}").select(*kept), f"{path}/old")
    new = tables.write_stage(rows.where(f"date >= {CUT}").withColumn("source", F.lit("new")), f"{path}/new", ["ticker"])
    both = tables.union_existing(spark, [new, old, f"{path}/none"], BAR_SCHEMA)
    return both.select(*kept, "source")


@query(
    "a12_order_ledger",
    "account_id order_id intended_execution_date ticker side requested_quantity:i requested_value:2 status",
    "SELECT account_id, order_id, intended_execution_date, ticker, side, requested_quantity, unit_cents * requested_quantity / 100.0 AS requested_value, 'PENDING' AS status FROM order_rows",
)
def _order_ledger(spark, folder):
    """Orders appended in two batches, one of them twice, and read back under the exact schema."""
    path = working_folder(spark, "orders")
    price = (F.col("unit_cents").cast("decimal(20,0)") / 100).cast("decimal(18,2)")
    values = {
        "signal_id": F.concat(F.lit("signal-"), F.col("order_id")),
        "order_date": F.date_sub("intended_execution_date", 1),
        "estimated_price": price,
        "requested_value": price * F.col("requested_quantity"),
        "reason_code": F.lit(""),
        "created_at": F.to_timestamp("intended_execution_date"),
    }
    # Stored without what their columns tell; the exact schema is made where the rows are read.
    rows = _kept_orders(spark, folder).withColumns(values)
    typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGERS["orders"]])
    sl.create_ledger(spark, "orders", path)
    sl.append_rows("orders", typed.where("side = 'BUY'"), path)
    sl.append_rows("orders", typed.where("side = 'SELL'"), path)
    sl.append_rows("orders", typed.where("side = 'SELL'"), path)
    return sl.read_ledger(spark, "orders", path)





@query(
    "b04_ablation_values",
    "scenario feature known:i",
    """SELECT scenario, feature, known FROM (
         SELECT unnest(['return_1d', 'return_5d', 'average_daily_value_20d', 'drawdown']) AS feature,
                unnest([count(return_1d), count(return_5d), count(average_daily_value_20d), count(drawdown)]) AS known FROM moves) f,
       (SELECT unnest(['all_features', 'without_volume_liquidity', 'without_price_limit', 'without_herding', 'without_risk']) AS scenario)
       WHERE NOT (scenario = 'without_risk' AND feature = 'drawdown') AND NOT (scenario = 'without_volume_liquidity' AND feature = 'average_daily_value_20d')""",
)
def _ablation_values(spark, folder):
    """Known values of every feature that each scenario keeps."""
    features = ["return_1d", "return_5d", "average_daily_value_20d", "drawdown"]
    rows = panel.features(spark, folder)
    counts = rows.agg(*[F.count(f).alias(f) for f in features]).unpivot([], features, "feature", "known")
    sets = splits.ablation_feature_sets(features)
    kept = [counts.where(F.col("feature").isin(chosen)).withColumn("scenario", F.lit(name)) for name, chosen in sets.items()]
    return reduce(DataFrame.unionByName, kept)


@query(
    "h03_score_columns",
    "score_column usable known:i",
    """SELECT unnest(['date', 'ticker', 'predicted_return', 'actual_return']) AS score_column, unnest([false, false, true, false]) AS usable,
       unnest([count(date), count(ticker), count(predicted_return), count(actual_return)]) AS known FROM preds""",
)
def _score_columns(spark, folder):
    """Which columns of the prediction table the guard lets through as scores, with their known values."""
    rows = panel.predictions(spark, folder)
    columns = ["date", "ticker", "predicted_return", "actual_return"]
    usable = F.lit(False)
    for name in columns:
        try:
            splits.check_score_columns([name], "actual_return")
        except ValueError:
            continue
        usable = usable | (F.col("score_column") == name)
    counts = rows.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "score_column", "known")
    return counts.withColumn("usable", usable)
