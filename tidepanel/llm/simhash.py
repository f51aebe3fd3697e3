"""Near duplicates by SimHash, found with a self-join of binary tries.

Documents become 64-bit fingerprints; equal fingerprints are one node.  Two fingerprints link
if at most ``budget`` bits differ.

The join.  The 64 bits are cut into blocks.  Of two fingerprints within the budget at least
``blocks - budget`` blocks agree, so for every choice of that many blocks one trie is laid over the
bits in the order "chosen blocks first".  Pairs of nodes that differ within the chosen
blocks are pruned at the root, which is what deals the work out: one task holds whole
subtries below equal chosen blocks.  Inside a subtrie node pairs are walked together from
the top, differing bits add up, and a pair is dropped as soon as they exceed the budget.
Every linked pair shares its chosen blocks in one trie at least, so none is missed.

Size.  Each fingerprint enters every trie once, so what is shuffled grows in proportion to
the distinct fingerprints.  With more blocks the subtries get smaller and the tries more.  A
subtrie with very many fingerprints is cut into parts by a hash, and every pair of parts is a
task of its own.  Of the linked pairs only a spanning forest of each subtrie leaves a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import picked, stored, utf8
from tidepanel.llm.components import connected

SEED = 42
SHINGLE = 4
BUDGET = 4
BLOCKS = 6
PART = 1024
FRONTIER = 1 << 18


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of lower-cased ASCII letters' words; zero for a text without words.

    Every shingle counts as often as it occurs.  A text with fewer words than a shingle is one
    shingle.  A bit is set if more than half of the shingle hashes have it.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    count = max(1, len(words) - shingle + 1)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[starts[k] : ends[min(k + shingle, len(words)) - 1] - 1], SEED) for k in range(count)]
    ones = np.zeros(64, dtype=np.int64)
    values = np.array(hashes, dtype=np.uint64)
    for low in range(0, count, 1 << 14):
        bits = np.unpackbits(values[low : low + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, bits): bits is the fingerprint as a signed 64-bit integer."""
    given = picked(documents, doc_id=id, text=text)
    given = given.select("doc_id", utf8(F.col("text")).alias("text"))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [fingerprint(value.as_buffer().to_pybytes(), shingle) for value in part.column("text")]
            bits = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bits)], names=["doc_id", "bits"])

    return given.mapInArrow(work, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, bits bigint")


def block_masks(blocks: int, budget: int) -> list[int]:
    """One mask per trie: the bits that come first in it."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    single = [sum(1 << b for b in range(low, high)) for low, high in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in itertools.combinations(single, blocks - budget)]


class Forest:
    """Disjoint sets over array places, united many pairs at a time."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self, places: np.ndarray) -> np.ndarray:
        found = self.parent[places]
        while True:
            above = self.parent[found]
            if np.array_equal(above, found):
                return found
            found = above

    def unite(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.roots(left), self.roots(right)
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            if len(a):
                np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
        self.parent = self.roots(np.arange(len(self.parent)))


def reordered(values: np.ndarray, mask: int) -> np.ndarray:
    """Bits outside the mask, gathered at the top in falling order: the path below the root."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    path = np.zeros(len(values), dtype=np.uint64)
    for place, bit in enumerate(free):
        path |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(63 - place)
    return path


def trie_links(path: np.ndarray, root: np.ndarray, side: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose paths differ in at most ``budget`` bits, below equal roots.

    The arrays are sorted by (root, side, path).  ``side`` is 0 and 1 where two parts of one
    large subtrie meet, so that only pairs across are wanted, and 0 everywhere else.

    A node is a range of the sorted paths that agree in the bits read so far.  Node pairs go
    down together, one bit at a time: children on the same bit keep the pair's differing bits,
    children on different bits add one, and pairs beyond the budget are dropped.  A pair of two single
    leaves is settled at once from the bits left.  Pairs wait on a stack in chunks, which
    bounds memory.
    """
    if not len(path):
        return
    key_change = np.flatnonzero((np.diff(root) != 0) | (np.diff(side) != 0)) + 1
    low = np.concatenate([[0], key_change])
    high = np.concatenate([key_change, [len(path)]])
    first, kind = root[low], side[low]
    crossing = np.flatnonzero((first[1:] == first[:-1]) & (kind[1:] != kind[:-1]))
    has_sides = np.zeros(len(low), dtype=bool)
    has_sides[crossing] = has_sides[crossing + 1] = True
    alone = np.flatnonzero(~has_sides & (kind == 0))
    a = np.concatenate([alone, crossing])
    b = np.concatenate([alone, crossing + 1])
    pairs = np.stack([low[a], high[a], low[b], high[b], np.zeros(len(a), dtype=np.int64)])
    # A stack entry is (bits read, node pairs).
    stack = [(0, pairs[:, k : k + FRONTIER]) for k in range(0, pairs.shape[1], FRONTIER)]
    while stack:
        level, now = stack.pop()
        same = now[0] == now[2]
        now = now[:, ~(same & (now[1] - now[0] < 2))]
        leaves = (now[1] - now[0] == 1) & (now[3] - now[2] == 1)
        if leaves.any():
            left, right = now[0, leaves], now[2, leaves]
            # Bits above the level are part of the sum already; equal there or counted.
            differ = np.bitwise_count((path[left] ^ path[right]) << np.uint64(level)) if level < 64 else 0
            near = now[4, leaves] + differ <= budget
            yield left[near], right[near]
            now = now[:, ~leaves]
        if not now.shape[1]:
            continue
        if level == depth:
            # Equal paths below one root: the same fingerprint on both sides of a cut.
            yield now[0], now[2]
            continue
        bit = np.uint64(63 - level)
        cut_a, cut_b = _cut(path, now[0], now[1], bit), _cut(path, now[2], now[3], bit)
        same = now[0] == now[2]
        nodes = [
            np.stack([now[0], cut_a, now[2], cut_b, now[4]]),
            np.stack([cut_a, now[1], cut_b, now[3], now[4]]),
            np.stack([now[0], cut_a, cut_b, now[3], now[4] + 1]),
            np.stack([cut_a, now[1], now[2], cut_b, now[4] + 1])[:, ~same],
        ]
        below = np.concatenate(nodes, axis=1)
        below = below[:, (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= budget)]
        stack += [(level + 1, below[:, k : k + FRONTIER]) for k in range(0, below.shape[1], FRONTIER)]


def _cut(path: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First place of each range whose bit is one; the ranges are sorted, so halving finds it."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        one = ((path[np.minimum(middle, len(path) - 1)] >> bit) & np.uint64(1)).astype(bool)
        high = np.where(open_ & one, middle, high)
        low = np.where(open_ & ~one, middle + 1, low)


def linked(distinct: DataFrame, budget: int = BUDGET, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """(a, b): a spanning forest of the links below each trie root, from distinct ``bits``.

    One row per fingerprint and trie is dealt out by (trie, chosen bits, pair of parts).  The
    count of fingerprints per root is a partial aggregate; a root with more than ``part`` of
    them is cut, so no task gets more than two parts of one root.
    """
    if blocks <= budget:
        raise ValueError("there must be more blocks than differing bits")
    masks = block_masks(blocks, budget)
    placed = distinct.select("bits", F.explode(F.array(*(F.struct(F.lit(k).alias("trie"), F.col("bits").bitwiseAND(F.lit(_signed(m))).alias("root")) for k, m in enumerate(masks)))).alias("at"))
    placed = placed.select("bits", "at.trie", "at.root")
    sizes = placed.groupBy("trie", "root").agg(F.count("*").alias("size"))
    crowded = sizes.where(F.col("size") > part).withColumn("parts", F.ceil(F.col("size") / part).cast("int")).drop("size")
    marked = placed.join(crowded, ["trie", "root"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("bits", F.lit(7)), F.col("parts")).cast("int")
    # A part meets itself and every other part: cells (x, y) with x <= y.
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(F.least("own", other).alias("x"), F.greatest("own", other).alias("y")),
    )
    dealt = marked.withColumn("own", own).select("bits", "trie", "root", "own", F.explode(cells).alias("cell"))
    dealt = dealt.select(
        "bits",
        "trie",
        F.xxhash64("trie", "root", "cell.x", "cell.y").alias("group"),
        F.col("root"),
        F.col("cell.x").alias("x"),
        F.col("cell.y").alias("y"),
        (F.col("own") != F.col("cell.x")).cast("int").alias("side"),
    )
    dealt = dealt.repartition("group").sortWithinPartitions("trie", "root", "x", "y")

    def work(parts_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in parts_:
            # Whole groups only: what shares its key with the last row waits for the next batch.
            held.append(batch)
            rows += batch.num_rows
            if rows < 1 << 16:
                continue
            table_ = pa.Table.from_batches(held).combine_chunks()
            cut = _last_group(table_)
            if cut:
                yield from _links(table_.slice(0, cut), masks, budget)
            held = table_.slice(cut).to_batches()
            rows = table_.num_rows - cut
        if held:
            yield from _links(pa.Table.from_batches(held).combine_chunks(), masks, budget)

    return dealt.select("bits", "trie", "root", "x", "y", "side").mapInArrow(work, "a bigint, b bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _keys(table_: pa.Table) -> np.ndarray:
    return np.stack([table_.column(c).to_numpy().astype(np.int64) for c in ("trie", "root", "x", "y")])


def _last_group(table_: pa.Table) -> int:
    """Row at which the last group begins."""
    keys = _keys(table_)
    changes = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0))
    return int(changes[-1]) + 1 if len(changes) else 0


def _links(table_: pa.Table, masks: list[int], budget: int) -> Iterator[pa.RecordBatch]:
    keys = _keys(table_)
    bits = table_.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    side = table_.column("side").to_numpy().astype(np.int64)
    group = np.concatenate([[0], np.cumsum((np.diff(keys, axis=1) != 0).any(axis=0))])
    # Cells off the diagonal hold two parts; rows of one part alone there have no partner.
    for trie in np.unique(keys[0]):
        mine = keys[0] == trie
        values, root = bits[mine], group[mine]
        off = (keys[2] != keys[3])[mine]
        own_side = np.where(off, side[mine], 0)
        path = reordered(values, masks[trie])
        order = np.lexsort((path, own_side, root))
        values, root, own_side, path, off = (x[order] for x in (values, root, own_side, path, off))
        depth = 64 - masks[trie].bit_count()
        forest = Forest(len(values))
        for left, right in trie_links(path, root, np.where(off, own_side + 1, 0), depth, budget):
            forest.unite(left, right)
        members = np.flatnonzero(forest.parent != np.arange(len(values)))
        if len(members):
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[members].view(np.int64)), pa.array(values[forest.parent[members]].view(np.int64))],
                names=["a", "b"],
            )


def near_duplicates(
    documents: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    budget: int = BUDGET,
    blocks: int = BLOCKS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id): the class of every document.

    component_id is the smallest doc_id reachable over links, the document itself included.
    Texts without words, null among them, have fingerprint zero and link like any other.
    Repeated rows and ids share their fingerprint's class; a null id takes no part in the
    minimum, and a class of null ids has a null component_id.  An empty table gives no rows.

    Links are found between distinct fingerprints, so copies never form pairs; the classes
    come back to the documents by a join on the fingerprint, where Spark splits the key of a
    large group of copies.
    """
    prints = stored(fingerprints(documents, id, text, shingle), "fingerprints")
    distinct = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    classes = connected(linked(distinct, budget, blocks), "a", "b")
    rooted = distinct.join(classes.withColumnRenamed("node", "bits"), "bits", "left").withColumn(
        "root", F.coalesce("root", "bits")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.select("bits", "root").join(least, "root").select("bits", "component_id")
    return prints.join(members, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
