"""Stage tables: reading, writing and bringing prediction sources to one schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted score and outcome column names, in order of preference.
SCORE_COLUMNS = [
    "predicted_return",
    "predicted_probability",
    "positive_class_probability",
    "probability",
    "score",
]
OUTCOME_COLUMNS = [
    "actual_return",
    "forward_relative_return_5d",
    "target_return",
    "target",
]


def write_stage(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    frame.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_report(frame: DataFrame, path: str) -> str:
    frame.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_stage(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Stage table projected to the required columns, so the scan reads only those."""
    frame = spark.read.parquet(path)
    if columns is not None:
        missing = sorted(set(columns) - set(frame.columns))
        if missing:
            raise ValueError(f"{path} lacks columns: {missing}")
        frame = frame.select(*columns)
    if "date" in frame.columns and not isinstance(frame.schema["date"].dataType, T.DateType):
        frame = frame.withColumn("date", F.to_date("date"))
    return frame


def read_stage_if_exists(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return read_stage(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def union_existing(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Union of whichever tables exist, with missing columns as null."""
    frames = [read_stage_if_exists(spark, path, schema) for path in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def harmonise_predictions(frame: DataFrame, model_family: str) -> DataFrame:
    """Project any prediction table to family, model, key, score and outcome."""

    def first_present(candidates: Sequence[str]) -> str:
        for name in candidates:
            if name in frame.columns:
                return name
        raise ValueError(f"None of {list(candidates)} is present")

    model = F.col("model_name") if "model_name" in frame.columns else F.lit(model_family)
    return frame.select(
        F.lit(model_family).alias("model_family"),
        model.alias("model_name"),
        "date",
        "ticker",
        F.col(first_present(SCORE_COLUMNS)).alias("model_score"),
        F.col(first_present(OUTCOME_COLUMNS)).alias("realized_forward_return"),
    ).dropna(subset=["date", "ticker", "model_score", "realized_forward_return"])


def write_partitions(frame: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions present in ``frame``."""
    (
        frame.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def staged_write(
    frame: DataFrame,
    target: str,
    staging: str,
    keys: Sequence[str] = ("date", "ticker"),
    dry_run: bool = False,
) -> dict[str, object]:
    """Write to staging, read back and check, then replace the target.

    The row count, column order, key uniqueness and latest date of the copy on disk must
    match the input.  With ``dry_run`` nothing is written.
    """

    def facts(table: DataFrame) -> dict[str, object]:
        per_key = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
        row = per_key.agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
            F.count_if(F.col("copies") > 1).alias("duplicate_keys"),
            F.max("date").alias("latest_date"),
        ).first()
        return {**row.asDict(), "columns": list(table.columns)}

    expected = facts(frame)
    if expected["duplicate_keys"]:
        raise ValueError(f"{expected['duplicate_keys']} duplicate keys; nothing written")
    if dry_run:
        return expected
    frame.write.mode("overwrite").parquet(staging)
    staged = frame.sparkSession.read.parquet(staging)
    found = facts(staged)
    if found != expected:
        raise ValueError(f"Staged table differs: {found} instead of {expected}")
    staged.write.mode("overwrite").parquet(target)
    return found
