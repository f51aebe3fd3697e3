"""Ranks and quantiles of cross-sections of any size.

A window partitioned by date would put a whole cross-section into one task.  Here the
values are first cut into *value buckets*: a bucket number that only depends on the
value and grows with it.  Bucket sizes come from a partial aggregate, their running sums
give the number of rows before each bucket, and only the rows of one bucket are ordered
together.  A crowded bucket is cut further, by value and inside one value by the tie-break
key, at rows drawn from the bucket itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import stored

BUCKETS_PER_DOUBLING = 64
# Doubles span 2**-1074 to 2**1024, so this offset keeps bucket numbers positive.
BUCKET_OFFSET = 1080 * BUCKETS_PER_DOUBLING
MISSING_BUCKET = 4 * BUCKET_OFFSET
# Rows of one group that are ordered in one task.
BLOCK_ROWS = 100_000


def value_bucket(value: Column) -> Column:
    """Monotone bucket number: 0 for zero, one per 1/64 doubling on either side."""
    number = value.cast("double")
    size = (F.floor(F.log2(F.abs(number)) * BUCKETS_PER_DOUBLING) + BUCKET_OFFSET).cast("int")
    return F.when(number > 0, size).when(number < 0, -size).when(number == 0, F.lit(0))


def top_n(
    frame: DataFrame, by: Sequence[str], order: Sequence[Column], n: int | Column, rank: str = "rank"
) -> DataFrame:
    """First n rows per group.

    The filter on ``row_number`` lets Spark keep only n rows per group and partition
    before the shuffle, so hot groups stay small.
    """
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return frame.withColumn(rank, position).where(F.col(rank) <= n)


def in_blocks(
    frame: DataFrame, by: Sequence[str], order: Sequence[str], expected_rows: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Cut rows sorted by (by, order) into blocks of about ``block_rows``; adds ``block`` and ``place``.

    Blocks rise with the order and a large group has many of them; ``place`` counts from 1 within a group's
    part of a block.  (by, order) has to be unique.  The cut is stored, since it comes from a sample.
    """
    count = expected_rows // block_rows + 1
    cut = stored(frame.repartitionByRange(count, *by, *order).withColumn("block", F.spark_partition_id()), "blocks")
    return cut.withColumn("place", F.row_number().over(Window.partitionBy(*by, "block").orderBy(*order)))


def numbered(
    frame: DataFrame, by: Sequence[str], order: Sequence[str], name: str, expected_rows: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``row_number`` of a group of any size: place in its block plus the rows in blocks before."""
    placed = in_blocks(frame, by, order, expected_rows, block_rows)
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*by, "block").agg(F.max("place").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).drop("__size")
    return (
        placed.join(before, [*by, "block"])
        .withColumn(name, F.col("__before") + F.col("place"))
        .drop("block", "place", "__before")
    )


def _value_cuts(rows: DataFrame, by: Sequence[str], value: str, tie_break: str, block_rows: int) -> DataFrame:
    """About one row in ``block_rows``, chosen by its hash, gathered per bucket as places to cut at.

    A bucket has as many cuts as it has blocks of rows, so nearly all buckets have none.
    """
    chosen = F.pmod(F.xxhash64(*by, value, tie_break), F.lit(block_rows)) == 0
    place = F.struct(F.col(value).alias("value"), F.col(tie_break).alias("tie"))
    return (
        rows.where(F.col(value).isNotNull() & chosen)
        .groupBy(*by, "__bucket")
        .agg(F.collect_set(place).alias("__cuts"))
    )


def with_ranks(
    frame: DataFrame,
    by: Sequence[str],
    value: str,
    *,
    ascending: bool = True,
    tie_break: str = "ticker",
    ordinal: str | None = None,
    minimum: str | None = None,
    average: str | None = None,
    percent: str | None = None,
    counted: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the requested ranks of ``value`` inside each ``by`` group.

    ``ordinal`` breaks ties by ``tie_break`` ascending, ``minimum`` gives tied rows their
    lowest rank, ``average`` their mean rank and ``percent`` the mean rank over the
    number of ranked rows.  Missing values get null ranks.

    ``counted`` may name an earlier frame with the same rows; bucket sizes are then taken
    from it, so several ranks in a row do not repeat each other's work.

    Rows of a bucket are cut at places drawn from the rows themselves (``_value_cuts``).  A
    value that is drawn has a segment of its own, cut on at the drawn tie-break keys; values
    between two drawn ones share a segment.  So a task orders a small multiple of
    ``block_rows`` rows, however many rows share a value or lie close together; only rows
    equal in group, value and tie-break stay in one piece.
    """
    by = list(by)
    number = F.col(value)
    tie = F.col(tie_break)
    direction = F.lit(1 if ascending else -1)
    # Rows without a value are spread instead of meeting in one bucket.
    spread = F.lit(MISSING_BUCKET) + F.pmod(F.hash(tie_break), F.lit(1024))
    bucket = F.coalesce(value_bucket(number) * direction, spread)
    order = ["__bucket", "__segment", "__slice"]
    cell = [*by, *order]
    source = frame if counted is None else counted
    cuts = _value_cuts(source.withColumn("__bucket", bucket), by, value, tie_break, block_rows)

    def located(rows: DataFrame) -> DataFrame:
        below = F.size(F.filter("__cuts", lambda cut: cut["value"] < number))
        drawn = F.coalesce(F.exists("__cuts", lambda cut: cut["value"] == number), F.lit(False))
        earlier = F.size(F.filter("__cuts", lambda cut: (cut["value"] == number) & (cut["tie"] <= tie)))
        segment = F.when(F.col("__cuts").isNotNull(), (2 * below + drawn.cast("int")) * direction)
        return rows.withColumn("__bucket", bucket).join(cuts, [*by, "__bucket"], "left").withColumns(
            {
                "__drawn": drawn,
                "__segment": F.coalesce(segment, F.lit(0)),
                "__slice": F.when(drawn, earlier).otherwise(F.lit(0)),
            }
        ).drop("__cuts")

    same_value = Window.partitionBy(*by, "__bucket", "__segment")
    cells = (
        located(source.where(number.isNotNull()).select(*by, value, tie_break))
        .groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("__size"))
        .withColumn(
            "__before", F.sum("__size").over(Window.partitionBy(*by).orderBy(*order)) - F.col("__size")
        )
        .withColumn("__segment_before", F.min("__before").over(same_value))
        .withColumn("__segment_size", F.sum("__size").over(same_value))
        .withColumn("__total", F.sum("__size").over(Window.partitionBy(*by)))
    )
    ranked = located(frame).join(cells, cell, "left")
    in_cell = Window.partitionBy(*cell)
    sort_key = number.asc() if ascending else number.desc()
    known = number.isNotNull()
    lowest = F.when(F.col("__drawn"), F.col("__segment_before") + 1).otherwise(
        F.col("__before") + F.rank().over(in_cell.orderBy(sort_key))
    )
    ties = F.when(F.col("__drawn"), F.col("__segment_size")).otherwise(
        F.count(F.lit(1)).over(
            in_cell.orderBy(sort_key).rangeBetween(Window.currentRow, Window.currentRow)
        )
    )
    mean_rank = lowest + (ties - 1) / F.lit(2.0)
    outputs: dict[str, Column] = {}
    if ordinal:
        place = F.row_number().over(in_cell.orderBy(sort_key, tie.asc()))
        outputs[ordinal] = F.when(known, F.col("__before") + place)
    if minimum:
        outputs[minimum] = F.when(known, lowest)
    if average:
        outputs[average] = F.when(known, mean_rank)
    if percent:
        outputs[percent] = F.when(known, mean_rank / F.col("__total"))
    return ranked.withColumns(outputs).drop(
        *order, "__drawn", "__size", "__before", "__segment_before", "__segment_size", "__total"
    )


def group_quantiles(
    frame: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group.

    Only rows in the buckets that hold a needed position are looked at again, and those
    are reduced to counted distinct values before they are ordered.
    """
    by = list(by)
    rows = frame.where(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("__value"), value_bucket(F.col(value)).alias("__bucket")
    )
    ordered = Window.partitionBy(*by).orderBy("__bucket")
    cells = (
        rows.groupBy(*by, "__bucket")
        .agg(F.count(F.lit(1)).alias("__size"))
        .withColumn("__before", F.sum("__size").over(ordered) - F.col("__size"))
        .withColumn("__total", F.sum("__size").over(Window.partitionBy(*by)))
    )
    positions = {
        name: (F.col("__total") - 1) * F.lit(float(q)) for name, q in quantiles.items()
    }

    def covers(position: Column, start: str, size: str) -> Column:
        return (F.col(start) <= position) & (position < F.col(start) + F.col(size))

    wanted = F.lit(False)
    for position in positions.values():
        for end in (F.floor(position), F.ceil(position)):
            wanted = wanted | covers(end, "__before", "__size")
    needed = cells.where(wanted).select(*by, "__bucket", "__before", "__total")
    counted = (
        rows.join(needed, [*by, "__bucket"])
        .groupBy(*by, "__bucket", "__value", "__before", "__total")
        .agg(F.count(F.lit(1)).alias("__copies"))
    )
    in_bucket = Window.partitionBy(*by, "__bucket").orderBy("__value")
    placed = counted.withColumn(
        "__start", F.col("__before") + F.sum("__copies").over(in_bucket) - F.col("__copies")
    )
    bounds = []
    for name, position in positions.items():
        for suffix, end in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = F.when(covers(end, "__start", "__copies"), F.col("__value"))
            bounds.append(F.max(hit).alias(f"__{name}_{suffix}"))
    picked = placed.groupBy(*by).agg(F.max("__total").alias("__total"), *bounds)
    return picked.select(
        *by,
        *[
            (
                F.col(f"__{name}_lo")
                + (F.col(f"__{name}_hi") - F.col(f"__{name}_lo")) * (position - F.floor(position))
            ).alias(name)
            for name, position in positions.items()
        ],
    )
