"""Classes of documents that share a given part of their word shingles.

Candidates come from the trie self-join of ``simhash``, laid out for a similarity instead of a fixed
number of bits.  Of two texts with the wanted similarity a bit of the fingerprint agrees with a
probability near ``AGREE``, so a random choice of r bits agrees throughout with AGREE^r.  Each trie begins
with such a choice, and the number of tries is set so that a pair meets in one of them with probability
``RECALL``.  Each text enters every trie once whatever the corpus.  Inside a subtrie node pairs go down
together and are dropped beyond the budget of differing bits.

Fingerprints have four words of 64 bits.  The tries use the words in turn, so a pair that is unlucky in one
is not in all, and a pair that is left is compared in all 256 bits, which tell similarities
apart twice as finely.  Of each subtrie a few spanning forests of the closest pairs leave a task first,
each made of pairs the forests before left over, and of these only pairs that no earlier trie holds; so a group of very
many near copies gives links in proportion to its texts.  Every such link is then checked exactly: the
shingles of both texts are put side by side, and only links that have the similarity make classes.

A subtrie that still has other pairs is looked at again with these classes.  A pair inside a class changes
nothing; the texts of every pair between two classes are sent to the subtrie with their shingles, and all
its pairs between classes are checked there, until none is left.  So the forests only spare work, and every
pair that meets is either inside a class or checked.

Equal texts are one node from the start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import picked, possible, stored, utf8
from tidepanel.llm.components import connected
from tidepanel.llm.simhash import SEED, _signed, reordered, trie_links

SIMILARITY = 0.8
SHINGLE = 5
#: Measured at similarity 0.8: a bit agrees in 87 of 100 cases; 14 differing bits of 64 hold 99 % of the
#: pairs, and so do 48 of 256.  The budgets leave a margin.
AGREE = 0.85
RECALL = 0.98
#: Bits a trie begins with.  More of them make subtries smaller and tries more; a corpus of billions of texts wants 20 or more.
ROOT_BITS = 16
BUDGET = 18
WIDE_BUDGET = 56
WORDS = 4
PART = 1024
#: Spanning forests of each subtrie that are checked first: each from the pairs the ones before left over.
FORESTS = 4
#: Pairs held before they are cut to a forest.
HELD = 1 << 19
# Odd multipliers of a 64-bit mixing step.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, ASCII letters lowered; none for a text without words.

    A text with fewer words than a shingle is one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
    count = max(1, len(words) - shingle + 1)
    span = min(shingle, len(words))
    return np.unique(np.array([digest(joined[starts[k] : starts[k + span] - 1], SEED) for k in range(count)], dtype=np.uint64))


def wide_print(hashes: np.ndarray) -> list[int]:
    """256 bits in four words: bit majorities over the hashes and three remixed forms of them."""
    out = []
    for k in range(WORDS):
        values = hashes
        if k:
            values = hashes * np.uint64((MIX[0] + 2 * k) % (1 << 64))
            values = (values ^ (values >> np.uint64(29))) * np.uint64(MIX[1])
            values ^= values >> np.uint64(32)
        ones = np.zeros(64, dtype=np.int64)
        for low in range(0, len(values), 1 << 14):
            bits = np.unpackbits(values[low : low + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(values), bitorder="little").view(np.int64)[0]))
    return out


def _keyed(documents: DataFrame, id: str, text: str) -> DataFrame:
    """doc_id, node, text: node tells texts apart by 64 bits of hash."""
    given = picked(documents, doc_id=id, text=text)
    plain = utf8(F.col("text"))
    return given.select("doc_id", F.xxhash64(plain).alias("node"), plain.alias("text"))


def _prints(keyed: DataFrame, shingle: int) -> DataFrame:
    names = [f"p{k}" for k in range(WORDS)]

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.array([wide_print(shingle_hashes(t.as_buffer().to_pybytes(), shingle)) for t in part.column("text")], dtype=np.int64)
            columns = [pa.array(c) for c in found.reshape(-1, WORDS).T]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), *columns], names=["doc_id", "node", *names])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(work, f"doc_id {kind}, node bigint, " + ", ".join(f"{n} bigint" for n in names))


def trie_masks(bits: int = ROOT_BITS, recall: float = RECALL) -> list[int]:
    """First bits of each trie."""
    tries = math.ceil(math.log(1 - recall) / math.log(1 - AGREE**bits))
    rng = np.random.default_rng(SEED)
    return [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(tries)]


def first_meeting(a: np.ndarray, b: np.ndarray, trie: int, masks: list[int]) -> np.ndarray:
    """Whether two prints (rows of words) share no subtrie of an earlier trie."""
    fresh = np.ones(len(a), dtype=bool)
    for k in range(trie):
        fresh &= ((a[:, k % WORDS] ^ b[:, k % WORDS]) & np.uint64(masks[k])) != 0
    return fresh


def closest_forest(size: int, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the pairs that form a spanning forest of least total length.

    In turns every tree takes the shortest pair that leaves it; of equal ones the first.
    """
    tree = np.arange(size)
    order = np.argsort(length, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    live = np.arange(len(left))
    kept = []
    while len(live):
        a, b = tree[left[live]], tree[right[live]]
        live = live[a != b]
        if not len(live):
            break
        a, b = tree[left[live]], tree[right[live]]
        best = np.full(size, len(rank), dtype=np.int64)
        np.minimum.at(best, a, rank[live])
        np.minimum.at(best, b, rank[live])
        taken = order[np.unique(best[best < len(rank)])]
        kept.append(taken)
        # Trees that took a pair become one: labels fall until they agree.
        while True:
            a, b = tree[left[taken]], tree[right[taken]]
            low = np.minimum(a, b)
            down = np.arange(size)
            np.minimum.at(down, np.maximum(a, b), low)
            while not np.array_equal(down, down[down]):
                down = down[down]
            if np.array_equal(tree, down[tree]):
                break
            tree = down[tree]
    return np.unique(np.concatenate(kept)) if kept else np.empty(0, dtype=np.int64)


CELL = ["trie", "root", "x", "y"]


def candidate_links(
    nodes: DataFrame, recall: float = RECALL, bits: int = ROOT_BITS, budget: int = BUDGET, wide: int = WIDE_BUDGET, part: int = PART
) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of stored ``nodes`` (node, p0 to p3) that may be similar, each once, a below b; and the rest.

    The rest are the rows of subtries whose forests leave pairs over, for ``links_between``.
    """
    masks = trie_masks(bits, recall)
    tries = F.array(*(F.struct(F.lit(k).alias("trie"), F.col(f"p{k % WORDS}").bitwiseAND(F.lit(_signed(m))).alias("root")) for k, m in enumerate(masks)))
    names = [f"p{k}" for k in range(WORDS)]
    placed = nodes.select("node", *names, F.explode(tries).alias("at")).select("node", *names, "at.trie", "at.root")
    sizes = nodes.select(F.explode(tries).alias("at")).groupBy("at.trie", "at.root").agg(F.count("*").alias("size"))
    crowded = stored(sizes.where(F.col("size") > part).withColumn("parts", F.ceil(F.col("size") / part).cast("int")).drop("size"), "crowded")
    marked = placed.join(crowded, ["trie", "root"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    marked = marked.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(F.least("own", other).alias("x"), F.greatest("own", other).alias("y")),
    )
    dealt = marked.select("node", *names, "trie", "root", "own", F.explode(cells).alias("cell")).select(
        "node", *names, "trie", "root", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"),
        (F.col("own") != F.col("cell.x")).cast("int").alias("side"),
    )

    def work(parts_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _whole_cells(parts_, 1 << 16, lambda table_: _forests(table_, masks, budget, wide))

    found = stored(_by_cell(dealt).mapInArrow(work, "a bigint, b bigint, trie int, root bigint, x int, y int"), "met")
    unfinished = stored(found.where("a IS NULL").select(*CELL), "unfinished")
    return found.where("a IS NOT NULL").select("a", "b").distinct(), dealt.join(unfinished, CELL, "left_semi")


def links_between(
    rest: DataFrame, classes: DataFrame, keyed: DataFrame, similarity: float, shingle: int,
    recall: float = RECALL, bits: int = ROOT_BITS, budget: int = BUDGET, wide: int = WIDE_BUDGET,
) -> DataFrame:
    """(a, b): checked links of ``rest`` that join classes (node, root); every pair between two classes is looked at.

    A pair that the links of its cell already join is not checked.
    """
    masks = trie_masks(bits, recall)
    classed = rest.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))

    def open_nodes(parts_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _whole_cells(parts_, 1 << 16, lambda table_: _open(table_, masks, budget, wide))

    kept = "node bigint, p0 bigint, p1 bigint, p2 bigint, p3 bigint, trie int, root bigint, x int, y int, side int, class bigint"
    columns = [c.split()[0] for c in kept.split(", ")]
    opened = stored(_by_cell(classed.select(columns)).mapInArrow(open_nodes, kept), "open")
    asked = stored(opened.select("node").distinct(), "asked")
    texts = possible(keyed.select("node", "text"), "node", asked).join(asked, "node", "left_semi")

    def sets(parts_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_:
            found = [shingle_hashes(t.as_buffer().to_pybytes(), shingle).view(np.int64) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    shingles = stored(texts.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(sets, "node bigint, shingles array<bigint>"), "shingles")

    def work(parts_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _whole_cells(parts_, 1 << 12, lambda table_: _checked(table_, masks, budget, wide, similarity))

    return _by_cell(opened.join(shingles, "node")).mapInArrow(work, "a bigint, b bigint").distinct()


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.xxhash64(*CELL)).sortWithinPartitions(*CELL)


def _whole_cells(
    parts: Iterator[pa.RecordBatch], least: int, work: Callable[[pa.Table], Iterator[pa.RecordBatch]]
) -> Iterator[pa.RecordBatch]:
    """Work on whole cells, about ``least`` rows at a time: what shares its key with the last row waits for the next batch."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in parts:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table_ = pa.Table.from_batches(held).combine_chunks()
        changes = np.flatnonzero((np.diff(_keys(table_), axis=1) != 0).any(axis=0))
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if cut:
            yield from work(table_.slice(0, cut))
        held = table_.slice(cut).to_batches()
        rows = table_.num_rows - cut
    if held:
        yield from work(pa.Table.from_batches(held).combine_chunks())


def _keys(table_: pa.Table) -> np.ndarray:
    return np.stack([table_.column(c).to_numpy().astype(np.int64) for c in ("trie", "root", "x", "y")])


def _spread(a: np.ndarray, b: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of places of two runs, of one run each pair once; some runs at a time, so that few pairs are held."""
    sizes = count[a] * count[b]
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(sizes) // HELD)) + 1):
        run = np.repeat(part, sizes[part])
        place = np.arange(len(run)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
        left, right = first[a[run]] + place // count[b[run]], first[b[run]] + place % count[b[run]]
        wanted = (a[run] != b[run]) | (left < right)
        yield left[wanted], right[wanted]


def _near_pairs(
    table_: pa.Table, masks: list[int], budget: int, wide: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Per trie: its number, its rows and prints in path order, and near pairs (left, right, differing bits) of their places."""
    if not table_.num_rows:
        return
    keys = _keys(table_)
    group = np.concatenate([[0], np.cumsum((np.diff(keys, axis=1) != 0).any(axis=0))])
    prints = np.stack([table_.column(f"p{k}").to_numpy().astype(np.int64).view(np.uint64) for k in range(WORDS)], axis=1)
    off = keys[2] != keys[3]
    side = np.where(off, table_.column("side").to_numpy().astype(np.int64) + 1, 0)

    def near(path: np.ndarray, mine: np.ndarray, mask: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        # The trie tells apart words only; texts that share the word stand behind its first place.
        of, on = group[mine], side[mine]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(on) != 0) | (path[1:] != path[:-1])]))
        count = np.diff(np.append(first, len(path)))
        same = np.flatnonzero((count > 1) & (on[first] == 0))
        linked = trie_links(path[first], of[first], on[first], 64 - mask.bit_count(), budget)
        for a, b in chain([(same, same)], linked):
            for left, right in _spread(a, b, first, count):
                length = np.bitwise_count(prints[mine[left]] ^ prints[mine[right]]).sum(axis=1, dtype=np.int64)
                close = length <= wide
                yield left[close], right[close], length[close]

    for trie in np.unique(keys[0]).tolist():
        mine = np.flatnonzero(keys[0] == trie)
        path = reordered(prints[mine, trie % WORDS], masks[trie])
        order = np.lexsort((path, side[mine], group[mine]))
        mine, path = mine[order], path[order]
        yield trie, mine, prints[mine], near(path, mine, masks[trie])


def _forests(table_: pa.Table, masks: list[int], budget: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the first forests of every cell (a, b); a row without a pair names a cell that has more."""
    names = ["a", "b", *CELL]
    for trie, mine, prints, pairs in _near_pairs(table_, masks, budget, wide):
        kept = [np.empty((3, 0), dtype=np.int64)]
        load = 0
        unfinished = np.zeros(len(mine), dtype=bool)

        def forest(kept: list[np.ndarray]) -> np.ndarray:
            rest, out = np.concatenate(kept, axis=1), []
            for _ in range(FORESTS):
                taken = closest_forest(len(mine), *rest)
                out.append(rest[:, taken])
                rest = np.delete(rest, taken, axis=1)
            # A pair that meets in an earlier trie is left to that one.
            unfinished[rest[0, first_meeting(prints[rest[0]], prints[rest[1]], trie, masks)]] = True
            return np.concatenate(out, axis=1)

        for found in pairs:
            kept.append(np.stack(found))
            load += len(found[0])
            if load > HELD:
                kept = [forest(kept)]
                load = kept[0].shape[1]
        left, right, _ = forest(kept)
        fresh = first_meeting(prints[left], prints[right], trie, masks)
        left, right = left[fresh], right[fresh]
        if len(left):
            node = table_.column("node").to_numpy()
            a, b = node[mine[left]], node[mine[right]]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *(pa.nulls(len(a), kind) for kind in kinds)], names=names
            )
        if unfinished.any():
            cells = table_.take(pa.array(mine[unfinished])).select(CELL).group_by(CELL).aggregate([]).select(CELL)
            none = [pa.nulls(cells.num_rows, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*none, *(cells.column(c).combine_chunks() for c in CELL)], names=names)


def _open(table_: pa.Table, masks: list[int], budget: int, wide: int) -> Iterator[pa.RecordBatch]:
    """The rows that have a near pair between two classes."""
    if not table_.num_rows:
        return
    kind = table_.column("class").to_numpy()
    wanted = np.zeros(table_.num_rows, dtype=bool)
    for trie, mine, prints, pairs in _near_pairs(table_, masks, budget, wide):
        for left, right, _ in pairs:
            apart = kind[mine[left]] != kind[mine[right]]
            left, right = left[apart], right[apart]
            fresh = first_meeting(prints[left], prints[right], trie, masks)
            wanted[mine[left[fresh]]] = wanted[mine[right[fresh]]] = True
    yield from table_.filter(pa.array(wanted)).to_batches()


def _checked(table_: pa.Table, masks: list[int], budget: int, wide: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs between classes that have the similarity, as far as they join trees of their cell."""
    if not table_.num_rows:
        return
    node = table_.column("node").to_numpy()
    kind = table_.column("class").to_numpy()
    lists = table_.column("shingles").combine_chunks()
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    for trie, mine, prints, pairs in _near_pairs(table_, masks, budget, wide):
        tree = {c: c for c in np.unique(kind[mine]).tolist()}

        def root(c: int) -> int:
            while tree[c] != c:
                tree[c] = c = tree[tree[c]]
            return c

        links = []
        for left, right, _ in pairs:
            fresh = (kind[mine[left]] != kind[mine[right]]) & first_meeting(prints[left], prints[right], trie, masks)
            for i, j in zip(mine[left[fresh]].tolist(), mine[right[fresh]].tolist(), strict=True):
                a, b = root(int(kind[i])), root(int(kind[j]))
                if a == b:
                    continue
                x, y = values[ends[i] : ends[i + 1]], values[ends[j] : ends[j + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                if not union or both / union >= similarity:
                    tree[max(a, b)] = min(a, b)
                    links.append((min(node[i], node[j]), max(node[i], node[j])))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])


def similar_links(links: DataFrame, keyed: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b, similarity) of the links whose texts share that part of their shingles at least.

    Shingles are made anew for the texts that have a link.
    """
    # Stored, as it is read twice; texts without a link are not moved.
    linked = stored(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct(), "linked")
    texts = possible(keyed.select("node", "text"), "node", linked).join(linked, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingle_hashes(t.as_buffer().to_pybytes(), shingle).view(np.int64) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    sets = stored(texts.mapInArrow(work, "node bigint, shingles array<bigint>"), "shingles")
    left, right = (sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set")) for side in ("a", "b"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    counted = links.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("a_set") + F.size("b_set")).alias("sizes"))
    # Two texts without words are alike; a text without words is like no other.
    share = F.when(F.col("sizes") == 0, 1.0).otherwise(F.col("both") / F.greatest(F.col("sizes") - F.col("both"), F.lit(1)))
    return counted.select("a", "b", share.alias("similarity")).where(F.col("similarity") >= similarity)


def similar_documents(
    documents: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    recall: float = RECALL,
    bits: int = ROOT_BITS,
) -> DataFrame:
    """(doc_id, node, component_id, n_links): the class of every document.

    component_id is the smallest doc_id reachable over equal texts and checked links, the document itself
    included; n_links counts the links of its text that were checked to make the classes.  Null texts count as empty; texts without words
    are alike.  Repeated rows and ids share the class of their text; a null id takes no part in the
    minimum, and a class of null ids has a null component_id.  An empty table gives no rows; other columns are ignored.
    """
    keyed = _keyed(documents, id, text)
    prints = stored(_prints(keyed, shingle), "prints")
    names = [f"p{k}" for k in range(WORDS)]
    nodes = stored(prints.groupBy("node").agg(*[F.max(n).alias(n) for n in names], F.min("doc_id").alias("least")), "nodes")
    candidates, rest = candidate_links(nodes, recall, bits)
    links = stored(similar_links(stored(candidates, "candidates"), keyed, similarity, shingle).select("a", "b"), "links")
    roots = connected(links, "a", "b")
    classes = roots.withColumnRenamed("root", "class")
    more = stored(links_between(rest, classes, keyed, similarity, shingle, recall, bits), "more")
    if not more.isEmpty():
        links = links.unionByName(more).distinct()
        roots = connected(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    rooted = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.select("node", "root").join(least, "root").join(degree, "node", "left")
    members = members.select("node", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints.select("doc_id", "node").join(members, "node").select("doc_id", "node", "component_id", "n_links")
