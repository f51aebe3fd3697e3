"""Incremental ingest of landed files and bars from an event stream.

Late data follows one rule: corrections inside the overlap window replace what is stored,
older rows stay frozen, and a batch with rows after the completed day, with gaps or with implausible
corrections is refused.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidepanel.operators.ingest import landed_problems, overlap_problems
from tidepanel.schemas import BAR_SCHEMA
from tidepanel.session import checkpoint
from tidepanel.sources.bars import typed_bars
from tidepanel.sources.tables import write_partitions

LANDED_SCHEMA = T.StructType([T.StructField(f.name, T.StringType()) for f in BAR_SCHEMA])


def landed_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of bar rows from CSV files that arrive in a folder."""
    raw = spark.readStream.schema(LANDED_SCHEMA).option("header", True).csv(folder)
    return typed_bars(raw)


def _month(frame: DataFrame) -> DataFrame:
    return frame.withColumn("month", F.date_format("date", "yyyy-MM"))


def stored_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bar table written by ``apply_batch``; empty before the first batch."""
    try:
        return spark.read.parquet(path).select(*BAR_SCHEMA.fieldNames())
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], BAR_SCHEMA)


def batch_problems(
    stored: DataFrame, rows: DataFrame, end: dt.date, start: dt.date | None, close_tolerance: float
) -> DataFrame:
    """(date, ticker, problem) of a batch against the stored bars: what the daily update refuses.

    Rows after the completed day ``end``, repeated keys, and inside the overlap window closes
    that moved too far and stored keys the batch lacks.
    """
    found = landed_problems(rows, end).select("date", "ticker", "problem")
    if start is not None:
        overlap = overlap_problems(stored, rows, close_tolerance, start)
        found = found.unionByName(overlap.select("date", "ticker", "problem"))
    return found


def apply_batch(
    batch: DataFrame,
    target: str,
    staging: str,
    end: dt.date,
    overlap_days: int = 14,
    close_tolerance: float = 0.05,
) -> dict[str, int]:
    """Merge one batch into the month-partitioned bar table; ``end`` is the last completed day.

    A batch with a row that breaks a rule is refused as a whole: nothing of it is written,
    ``refused`` counts the problems, and they are listed in the staging folder under
    ``problems``.  Rows before the overlap window stay as they are stored and are counted as
    ``frozen``.

    Only the months the batch touches are read back and rewritten.  The merged months are
    staged first; a batch whose staged months are already complete, because the driver was
    lost while publishing, is only published again.
    """
    spark = batch.sparkSession
    counts = {"written": 0, "frozen": 0, "refused": 0}
    if not _complete(spark, staging):
        rows = checkpoint(batch.select(*BAR_SCHEMA.fieldNames()))
        total = rows.count()
        if not total:
            return counts
        stored = stored_bars(spark, target)
        latest = stored.agg(F.max("date").alias("latest")).first()["latest"]
        start = None if latest is None else latest - dt.timedelta(days=overlap_days)
        fresh = rows if start is None else rows.where(F.col("date") >= F.lit(start))
        problems = checkpoint(batch_problems(stored, fresh, end, start, close_tolerance))
        counts["refused"] = problems.count()
        if counts["refused"]:
            problems.write.mode("overwrite").parquet(f"{staging}/problems")
            return counts
        counts["written"] = fresh.count()
        counts["frozen"] = total - counts["written"]
        if not counts["written"]:
            return counts
        months = _month(fresh).select("month").distinct()
        touched = _month(stored).join(F.broadcast(months), "month", "left_semi").drop("month")
        kept = touched.join(fresh.select("date", "ticker"), ["date", "ticker"], "left_anti")
        # The target cannot be read and overwritten in one plan.
        _month(kept.unionByName(fresh)).write.mode("overwrite").parquet(f"{staging}/rows")
        spark.range(1).write.mode("overwrite").parquet(f"{staging}/done")
    write_partitions(spark.read.parquet(f"{staging}/rows"), target, ["month"])
    return counts


def _complete(spark: SparkSession, staging: str) -> bool:
    """True when the marker written after the staged rows exists."""
    try:
        return spark.read.parquet(f"{staging}/done").count() > 0
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


def run_landing(
    spark: SparkSession, landing: str, target: str, staging: str, progress: str, end: dt.date, **rules: float
) -> StreamingQuery:
    """Process every landed file once and stop; ``progress`` keeps the exactly-once state.

    A refused batch fails the query, so it comes again once its file or the table is put right.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        counts = apply_batch(batch, target, f"{staging}/{batch_id}", end, **rules)
        if counts["refused"]:
            raise ValueError(f"Batch {batch_id} breaks {counts['refused']} rules, listed in {staging}/{batch_id}/problems")

    return (
        landed_bars(spark, landing)
        .writeStream.foreachBatch(each)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def event_bars(events: DataFrame, lateness: str = "14 days", width: str = "1 day") -> DataFrame:
    """Daily value bars per event type; works on a stream and on a table.

    The first and last value of a bar follow the event time and, inside it, the event id.
    """
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    order = F.struct("ts", "event_id")
    return (
        timed.groupBy(F.window("ts", width), "event_type")
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            F.count("value").alias("volume"),
            F.sum("value").alias("value_traded"),
        )
        .select(
            F.to_date("window.start").alias("date"),
            F.col("event_type").alias("ticker"),
            "open", "high", "low", "close", "volume", "value_traded",
        )
    )
