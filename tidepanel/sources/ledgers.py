"""Account ledgers as tables with exact schemas and idempotent appends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.schemas import LEDGER_KEYS, LEDGERS


def check_columns(name: str, columns: Sequence[str]) -> None:
    expected = LEDGERS[name].fieldNames()
    if list(columns) != expected:
        raise ValueError(f"Ledger {name} has columns {list(columns)}; expected {expected}")


def read_ledger_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Ledger from CSV: header checked in order, text typed exactly, blanks become null."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    check_columns(name, raw.columns)
    return raw.select(
        *[
            F.nullif(F.trim(F.col(field.name)), F.lit("")).cast(field.dataType).alias(field.name)
            for field in LEDGERS[name]
        ]
    )


def read_ledger(spark: SparkSession, name: str, path: str) -> DataFrame:
    frame = spark.read.parquet(path)
    check_columns(name, frame.columns)
    return frame


def _blank(keys: Sequence[str]) -> str:
    return " OR ".join(f"{key} IS NULL OR trim(cast({key} as string)) = ''" for key in keys)


def row_problems(name: str, rows: DataFrame) -> DataFrame:
    """Blank required identifiers and repeated keys."""
    keys = LEDGER_KEYS[name]
    blank = rows.where(_blank(keys)).select(*keys, F.lit("blank_identifier").alias("problem"))
    repeated = (
        rows.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("duplicate_identifier").alias("problem"))
    )
    return blank.unionByName(repeated)


def append_status(name: str, new_rows: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: batch size, keys already present and what an append would do."""
    keys = LEDGER_KEYS[name]
    known = existing.select(*keys).distinct().withColumn("known", F.lit(1))
    batch = new_rows.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    decision = (
        F.when(F.col("duplicate_keys") > 0, "reject_duplicates")
        .when(F.col("present_keys") == 0, "append")
        .when(F.col("present_keys") == F.col("batch_keys"), "no_op")
        .otherwise("reject_overlap")
    )
    return (
        batch.join(known, keys, "left")
        .agg(
            F.count(F.lit(1)).alias("batch_keys"),
            F.count("known").alias("present_keys"),
            F.count_if(F.col("copies") > 1).alias("duplicate_keys"),
        )
        .withColumn("decision", decision)
    )


def append_rows(name: str, new_rows: DataFrame, path: str) -> bool:
    """Append a batch once.  True when written, False when it was already there."""
    spark = new_rows.sparkSession
    check_columns(name, new_rows.columns)
    keys = LEDGER_KEYS[name]
    existing = read_ledger(spark, name, path)
    one = new_rows.select(*keys).first()
    if one is None:
        return False
    # Where one key of the batch is known, a repeated batch is likely: its keys are compared at once.
    known = not existing.where(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(one[k]) for k in keys])).isEmpty()
    if (known or not _unmet(keys, new_rows, existing)) and not _compared(name, keys, new_rows, existing):
        return False
    new_rows.write.mode("append").option("compression", "zstd").parquet(path)
    return True


def _unmet(keys: Sequence[str], new_rows: DataFrame, existing: DataFrame) -> bool:
    """Whether hashes alone tell that a batch has no blank or repeated key and none of the ledger.

    Equal keys have equal hashes, so hashes that differ prove it; where two meet, the keys have to be compared.
    Only hashes are moved.
    """
    state = F.when(F.expr(_blank(keys)), F.lit(2)).otherwise(F.lit(1))
    hashed = F.xxhash64(*keys).alias("key")
    both = new_rows.select(hashed, state.alias("state")).unionByName(existing.select(hashed, F.lit(0).alias("state")))
    # A sum of exactly one is a single whole key of the batch; a repeated key of the ledger alone does not matter.
    per_hash = both.groupBy("key").agg(F.sum("state").alias("states"), F.count(F.lit(1)).alias("rows"))
    fresh = (F.col("states") == 1) & (F.col("rows") == 1)
    return per_hash.where((F.col("states") > 0) & ~fresh).isEmpty()


def _compared(name: str, keys: Sequence[str], new_rows: DataFrame, existing: DataFrame) -> bool:
    """Whether a batch is to be appended, from its keys; a batch with wrong or some known keys is refused."""
    one, none = F.lit(1).alias("new"), F.lit(0).alias("new")
    # Batch and ledger meet once by key; blank and repeated keys are seen on the way.
    both = new_rows.select(*keys, one).unionByName(existing.select(*keys, none))
    per_key = both.groupBy(*keys).agg(F.sum("new").alias("copies"), F.min("new").alias("least"))
    batch = F.col("copies") > 0
    row = per_key.agg(
        F.count_if(batch).alias("batch_keys"),
        F.count_if(batch & (F.col("least") == 0)).alias("present_keys"),
        F.count_if(batch & ((F.col("copies") > 1) | F.expr(_blank(keys)))).alias("problems"),
    ).first()
    if row["problems"]:
        raise ValueError(f"Invalid {name} batch, for example {row_problems(name, new_rows).limit(5).collect()}")
    if 0 < row["present_keys"] < row["batch_keys"]:
        raise ValueError(f"{row['present_keys']} of {row['batch_keys']} keys already exist in {name}")
    return row["present_keys"] < row["batch_keys"]


def create_ledger(spark: SparkSession, name: str, path: str) -> None:
    spark.createDataFrame([], LEDGERS[name]).write.mode("overwrite").parquet(path)


def upsert_rows(existing: DataFrame, new_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace existing rows with the same key."""
    kept = existing.join(new_rows.select(*keys).distinct(), list(keys), "left_anti")
    return kept.select(*existing.columns).unionByName(new_rows)


def replace_performance_date(existing: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert_rows(existing, rows, LEDGER_KEYS["daily_performance"])


def empty_ledger(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType(LEDGERS[name].fields))
