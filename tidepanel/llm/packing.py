"""Packing documents into sequences by minimum bin slack.

Bins are filled one after another: the largest length left goes in, then the subset sum of the remaining
lengths that comes closest to the rest is found with a bitset and removed.

Lengths are whole numbers up to the capacity, so what there is to pack is a table of at most
``capacity`` counts, however many documents there are.  The plan is made on that table.  Equal counts
give equal bins, so a combination is applied as often as its lengths last: every step uses up
a length, and the plan has some thousand steps for a thousand documents or for a trillion.  Documents
take their places from the plan by their rank among those of the same length, which tasks
count locally and a small table of counts by task turns into global ranks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import batches, picked, stored
from tidepanel.llm.wordbpe import tokenizer_path, word_ids

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096


def fullest(rest: int, counts: dict[int, int]) -> Counter:
    """The multiset of available lengths whose sum comes closest to ``rest`` without passing it.

    Bit k of ``reach`` says that the lengths taken so far have a subset of sum k.  Copies of a
    length enter in powers of two.  Longer lengths come first and are preferred among equal
    sums, so short ones stay for later bins.
    """
    reach, mask = 1, (1 << rest + 1) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((n for n in counts if n <= rest), reverse=True):
        left, batch = min(counts[length], rest // length), 1
        while left:
            batch = min(batch, left)
            steps.append((length, batch, reach))
            reach |= reach << length * batch & mask
            left -= batch
            batch *= 2
        if reach >> rest & 1:
            break
    total = reach.bit_length() - 1
    chosen: Counter = Counter()
    for length, batch, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += batch
            total -= length * batch
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """(lengths of a bin, number of such bins) until nothing is left."""
    left = {length: count for length, count in counts.items() if count}
    steps = []
    while left:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        if not rest[largest]:
            del rest[largest]
        bin_ = fullest(capacity - largest, rest)
        bin_[largest] += 1
        times = min(left[length] // copies for length, copies in bin_.items())
        for length, copies in bin_.items():
            left[length] -= times * copies
            if not left[length]:
                del left[length]
        steps.append((bin_, times))
    return steps


class Places:
    """Sequence and offset of the r-th piece of a length, looked up for whole columns."""

    def __init__(self, steps: list[tuple[Counter, int]]):
        rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first bin, copies, offset
        used: Counter = Counter()
        bins = 0
        for bin_, times in steps:
            offset = 0
            for length in sorted(bin_, reverse=True):
                rows.append((length, used[length], bins, bin_[length], offset))
                used[length] += times * bin_[length]
                offset += length * bin_[length]
            bins += times
        self.bins = bins
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.length, self.rank, self.bin, self.copies, self.offset = table.T
        self.starts = {int(n): k for n, k in zip(*np.unique(self.length, return_index=True), strict=True)}
        self.ends = {int(n): int(k + c) for n, k, c in zip(*np.unique(self.length, return_index=True, return_counts=True), strict=True)}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.empty(len(length), dtype=np.int64)
        for one in np.unique(length):
            low, high = self.starts[int(one)], self.ends[int(one)]
            mine = length == one
            row[mine] = low + np.searchsorted(self.rank[low:high], rank[mine], side="right") - 1
        turn = rank - self.rank[row]
        copies = self.copies[row]
        return self.bin[row] + turn // copies, self.offset[row] + turn % copies * length


def pieces(
    documents: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, nth and, if asked for, the ids (32-bit little-endian).

    ``nth`` counts the pieces of the same length that the task met before.
    """
    path = tokenizer_path(tokenizer)
    given = picked(documents, doc_id=id, text=text)
    given = given.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder = word_ids(path)
        task = TaskContext.get().partitionId()
        nth: Counter = Counter()
        for part in parts:
            for doc, value in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.append(np.frombuffer(encoder.text(value), encoder.dtype).astype("<u4"), np.uint32(end_id))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    data = ids[start : start + capacity].tobytes()
                    length = len(data) // 4
                    row = (doc, piece, start, length, zlib.crc32(data), task, nth[length])
                    nth[length] += 1
                    yield (*row, data) if with_ids else row

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())]
        parts = iter(parts)
        first = next(parts, None)
        if first is None:
            return
        schema = pa.schema([("doc_id", first.schema.field("doc_id").type), *fields, *([("ids", pa.binary())] if with_ids else [])])

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from parts

        yield from batches(rows(again()), schema, size=1 << 14)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"
    return given.mapInArrow(work, schema + (", ids binary" if with_ids else ""))


def packed(
    documents: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids), one row per piece.

    Each document's ids end with ``end_id``; only a document longer than ``capacity`` is cut,
    and its last piece may be shorter.  Null and empty texts are a piece of one id.  Repeated
    rows and ids are packed one by one, an empty table gives no rows, other columns are ignored.
    Sequences are filled without gaps from offset 0.
    """
    cut = stored(pieces(documents, id, text, tokenizer, end_id, capacity, with_ids), "pieces")
    by_task = stored(cut.groupBy("task", "length").agg(F.count("*").alias("met")), "lengths")
    # At most ``capacity`` rows, whatever the size of the corpus.
    counts = {r["length"]: r["met"] for r in by_task.groupBy("length").agg(F.sum("met").alias("met")).collect()}
    places = cut.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("met").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["task", "length"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = ranked.select(*columns, (F.col("base") + F.col("nth")).alias("rank"))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bins, offsets = places.value(part.column("length").to_numpy(), part.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in columns), pa.array(bins), pa.array(offsets)], names=[*columns, "sequence_id", "offset"]
            )

    fields = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.mapInArrow(work, f"{fields}, sequence_id bigint, offset bigint")
