"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns several points of a ring; a row belongs to the first point clockwise of its own
place, which is a hash of its text.  No shard takes more than its bound: what a full shard cannot
hold goes on clockwise to the next point whose shard has room.  With a bound of the mean load the counts of any two
shards differ by one at most.  Rows that fit into the shard they belong to stay there, so a shard
more or some rows more move little.

Only counts per arc of the ring decide how many rows of an arc go where.  There are as many arcs as
points, whatever the table holds, so the walk around the ring is done on those few counts; it gives
ranges of ranks.  The rows find their rank in two levels: cells of the ring in order, then the
rows of a cell.  A cell with many rows is cut finer along the ring, and one where a single text
repeats very often by row, so no task orders more than a few times ``CELL`` rows.  Texts
themselves are not shuffled, unless asked for.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Sequence

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import picked, stored, utf8

SHARDS = 16
REPLICAS = 64
SLOT_BITS = 16
CELL = 100_000


def ring_points(shards: int, replicas: int = REPLICAS) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node in ring order.

    A point whose slot is taken moves on to the next free one; points of lower shards are set
    first, so another shard moves none of them.
    """
    size = 1 << SLOT_BITS
    if shards < 1 or replicas < 1 or shards * replicas > size:
        raise ValueError(f"a ring has 1 to {size} points")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for replica in range(replicas):
            slot = xxhash.xxh64_intdigest(f"{shard}:{replica}") % size
            while slot in taken:
                slot = (slot + 1) % size
            taken[slot] = shard
    return sorted(taken.items())


def bounds(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows per shard: the mean, rounded so that all fit, or ``slack`` above it."""
    if slack > 0:
        return [math.ceil((1 + slack) * total / shards)] * shards
    return [total // shards + (k < total % shards) for k in range(shards)]


def walk(counts: Sequence[int], owners: Sequence[int], most: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """(arc, low, high, shard): which ranks of an arc's rows go to which shard.

    Rows first fill the shard their arc belongs to, arcs in ring order.  The rest of each arc goes on
    clockwise, those under way longest first, into shards that still have room.
    """
    room = list(most)
    placed, waiting = [], deque()
    left = []
    for arc, (count, owner) in enumerate(zip(counts, owners, strict=True)):
        own = min(count, room[owner])
        room[owner] -= own
        left.append((arc, own, count))
        if own:
            placed.append((arc, 0, own, owner))
    for step in range(2 * len(counts)):
        arc = step % len(counts)
        owner = owners[arc]
        while waiting and room[owner]:
            source, low, high = waiting.popleft()
            taken = min(high - low, room[owner])
            placed.append((source, low, low + taken, owner))
            room[owner] -= taken
            if low + taken < high:
                waiting.appendleft((source, low + taken, high))
        if step < len(counts) and left[arc][1] < left[arc][2]:
            waiting.append(left[arc])
    return placed


def _rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small frame from literal values."""
    names = [part.split()[0] for part in schema.split(", ")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(':'.join(p.split()) for p in schema.split(', '))}>>")))


def _placed(measured: DataFrame, order: Sequence[str], shards: int, replicas: int, slack: float, cell: int) -> DataFrame:
    """``measured``, a stored frame with ``at`` and ``line``, with shard and slot."""
    spark = measured.sparkSession
    total = measured.count()
    finer = max(0, math.ceil(math.log2(max(1.0, total / (cell << SLOT_BITS)))))
    rows = measured.withColumn("fine", F.shiftrightunsigned("at", 64 - SLOT_BITS - finer))
    crowded = rows.groupBy("fine").count().where(F.col("count") > 2 * cell)
    crowded = crowded.select("fine", F.ceil(F.col("count") / cell).alias("parts"))
    rows = rows.join(crowded, "fine", "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("line"), F.col("parts")), F.lit(0))
    )

    points = ring_points(shards, replicas)
    arcs = []
    for k, (slot, _) in enumerate(points):
        arcs.append((k, points[k - 1][0] + 1 if k else 0, slot))
    if points[-1][0] + 1 < 1 << SLOT_BITS:
        arcs.append((0, points[-1][0] + 1, (1 << SLOT_BITS) - 1))
    ring = _rows(spark, arcs, "arc int, first bigint, last bigint").select(
        "arc", F.explode(F.sequence("first", "last")).alias("slot")
    )
    counted = rows.groupBy("fine", "salt").agg(F.count("*").alias("count"))
    cells = counted.withColumn("slot", F.shiftright("fine", finer)).join(ring, "slot").drop("slot")
    cells = stored(cells, "cells")

    counts = {r["arc"]: r["count"] for r in cells.groupBy("arc").agg(F.sum("count").alias("count")).collect()}
    filled = [0] * shards
    ranges = []
    for arc, low, high, shard in walk([counts.get(k, 0) for k in range(len(points))], [s for _, s in points], bounds(total, shards, slack)):
        ranges.append((arc, low, high, shard, filled[shard]))
        filled[shard] += high - low
    plan = _rows(spark, ranges, "arc int, low bigint, high bigint, shard int, slot bigint")

    before = Window.partitionBy("arc").orderBy("fine", "salt").rowsBetween(Window.unboundedPreceding, -1)
    begun = cells.withColumn("begin", F.coalesce(F.sum("count").over(before), F.lit(0)))
    meets = (begun["arc"] == plan["arc"]) & (plan["low"] < begun["begin"] + begun["count"]) & (plan["high"] > begun["begin"])
    dealt = begun.join(plan, meets).groupBy("fine", "salt", "begin").agg(
        F.collect_list(F.struct("low", "high", "shard", "slot")).alias("ranges")
    )
    inside = Window.partitionBy("fine", "salt").orderBy(*order, "line")
    ranked = rows.join(dealt, ["fine", "salt"]).withColumn("rank", F.col("begin") + F.row_number().over(inside) - 1)
    mine = F.filter("ranges", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0]
    return ranked.withColumn("mine", mine).withColumns(
        {"shard": F.col("mine.shard"), "slot": F.col("mine.slot") + F.col("rank") - F.col("mine.low")}
    )


def shard_places(
    documents: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    replicas: int = REPLICAS,
    slack: float = 0.0,
    cell: int = CELL,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    ``law`` is rows: counts of shards differ by one at most (with ``slack``, a part of the mean, none
    is further above the mean than that, and law is bounded).  ``slot`` counts a shard's rows from zero without a gap.
    The ring is bound to all counts, so which rows another shard would take is no matter of the row
    alone: grown_shard is null.

    Null and empty texts are equal and have size 1.  Equal texts lie together on the ring and share a
    shard as far as its bound allows.  Null and repeated ids and repeated rows are rows like any other; more than
    2 ``cell`` of them with one text are dealt by their place in the table.  Other columns are
    ignored, an empty table gives no rows.
    """
    given = picked(documents, doc_id=id, text=text)
    plain = utf8(F.col("text"))
    measured = stored(
        given.select(
            "doc_id",
            (F.octet_length(plain) + 1).cast("bigint").alias("size"),
            F.crc32(plain).alias("text_crc32"),
            F.xxhash64(plain).alias("at"),
            F.monotonically_increasing_id().alias("line"),
        ),
        "measured",
    )
    placed = _placed(measured, ["at", "doc_id", "text_crc32"], shards, replicas, slack, cell)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bounded" if slack > 0 else "rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(
    documents: DataFrame,
    key: str = "text",
    shards: int = SHARDS,
    replicas: int = REPLICAS,
    slack: float = 0.0,
    cell: int = CELL,
) -> DataFrame:
    """row, shard, slot: every whole row as a struct with its place, by the hash of any column as text.

    Columns keep their names inside the struct, so none can clash.
    """
    names = {name: f"c{k}" for k, name in enumerate(documents.columns)}
    frame = documents.toDF(*names.values())
    row = F.struct(*[F.col(c).alias(name) for name, c in names.items()])
    measured = stored(
        frame.select(row.alias("row"), F.xxhash64(utf8(F.col(names[key]))).alias("at"), F.monotonically_increasing_id().alias("line")),
        "rows",
    )
    return _placed(measured, ["at"], shards, replicas, slack, cell).select("row", "shard", "slot")


def write_shards(documents: DataFrame, folder: str, key: str = "text", shards: int = SHARDS) -> None:
    """One folder ``shard=N`` of Parquet files per shard, rows in slot order inside a file."""
    placed = sharded(documents, key, shards)
    # Ranges of slots, so that a shard is written by several tasks.
    ordered = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(folder)
