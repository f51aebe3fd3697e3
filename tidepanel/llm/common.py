"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.session import checkpoint, shared_root

__all__ = ["batches", "checkpoint", "mapped", "marked_possible", "picked", "possible", "shared_folder", "stored", "table", "utf8"]

#: Longs of a bitmap of keys: 16 million bits, whatever the number of keys.
MAP_WORDS = 1 << 18


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def picked(frame: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names: ``picked(pages, id="page_id")``.

    Other columns may have any name, also one that differs from a wanted one only by case; the
    exact spelling wins, and the columns are found by place so that no reference is ambiguous.
    """
    places = {}
    for new, wanted in columns.items():
        exact = [k for k, name in enumerate(frame.columns) if name == wanted]
        loose = [k for k, name in enumerate(frame.columns) if name.lower() == wanted.lower()]
        if not loose:
            raise ValueError(f"no column {wanted}; there are {', '.join(frame.columns)}")
        places[new] = (exact or loose)[0]
    renamed = frame.toDF(*(f"c{k}" for k in range(len(frame.columns))))
    return renamed.select(*(F.col(f"c{k}").alias(new) for new, k in places.items()))


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text; null becomes empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def mapped(frame: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; a partition may hold no batch or empty ones."""
    return frame.mapInArrow(work, schema)


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096, weight: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches from tuples, cut by rows and by the bytes of their binary or text values."""
    held: list[tuple] = []
    heavy = [k for k, field in enumerate(schema) if pa.types.is_binary(field.type) or pa.types.is_string(field.type)]
    load = 0
    for row in rows:
        held.append(row)
        load += sum(len(row[k]) for k in heavy if row[k] is not None)
        if len(held) >= size or load >= weight:
            yield _batch(held, schema)
            held, load = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(columns, schema, strict=True)], schema=schema
    )


def marked_possible(frame: DataFrame, key: str, wanted: DataFrame, words: int = MAP_WORDS) -> DataFrame:
    """frame with ``possible``: false where ``key``, a 64-bit hash, is none of those in ``wanted`` (its one column).

    All tasks get a bitmap of the wanted keys, of bounded size.  Keys that share a bit with a wanted one are possible
    too, so a join has to follow; it then moves few of the other rows.
    """
    bits = wanted.toDF("key").select(F.pmod("key", F.lit(64 * words)).alias("bit"))
    mask = F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))")
    found = bits.groupBy(F.shiftright("bit", 6).alias("__word")).agg(mask.alias("__mask"))
    bit = F.pmod(key, F.lit(64 * words))
    joined = frame.withColumn("__bit", bit).join(F.broadcast(found), F.shiftright("__bit", 6) == F.col("__word"), "left")
    held = F.expr("shiftright(__mask, CAST(__bit % 64 AS INT)) & 1L") == 1
    return joined.withColumn("possible", F.coalesce(held, F.lit(False))).drop("__bit", "__word", "__mask")


def possible(frame: DataFrame, key: str, wanted: DataFrame, words: int = MAP_WORDS) -> DataFrame:
    """The rows of frame whose ``key`` may be in ``wanted``."""
    return marked_possible(frame, key, wanted, words).where("possible").drop("possible")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which the driver and all executors can reach."""
    # Spark states the folder with its file system, also where the setting leaves that to the default.
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Written as Parquet into a new shared folder and read again."""
    folder = shared_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)
