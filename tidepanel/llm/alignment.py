"""Alignment of two tokenizers' ids over a corpus.

Both token rows of a text cover the same bytes.  Offsets where tokens of both end cut them into
groups, and the two tokens that end a group are linked.  How often a pair of ids is linked in the
whole corpus tells which ids of one vocabulary stand for which of the other.

Most groups are one token each, and then both have the same bytes.  For these an identity map, from
each A id to the B id of the same bytes, makes the pair known from the A id alone: they are counted in a vector
as long as the vocabulary and never enter a shuffle as pairs.  Only irregular groups do, summed per
task first.

A text's links look up the corpus counts on the map side wherever a table of proven size has
them: the vector, and the pairs with more than a 2^17th of all links, of which there are fewer than 2^17.
What is left is rare by that bound, so the join that looks up the rest has no hot key.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import batches, picked, stored
from tidepanel.llm.wordbpe import byte_letters, tokenizer_path

LEFT = "byte_bpe_50k.json"
RIGHT = "piece_bpe_32k.model"
SPACE = "▁"
#: Pairs with more than total / FREQUENT links are looked up in a broadcast table.
FREQUENT = 1 << 17
#: Distinct pairs a counting task holds before it passes sums on.
HELD = 1 << 20
#: Bytes of text encoded in one go.
CHUNK = 4 << 20
# Fixed value: how a byte-level tokenizer file of this kind splits text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_ranks(path: str) -> dict[bytes, int]:
    """Id of every token's bytes in a byte-level BPE file whose ids follow its merges.

    Special tokens are left out, so that their strings in a text are plain text.
    """
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    model, split = settings["model"], settings["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if settings["normalizer"] or not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    letters = {letter: byte for byte, letter in byte_letters().items()}
    vocabulary = model["vocab"]
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError(f"{path}: its ids do not follow its merges")
    special = {t["content"] for t in settings.get("added_tokens", []) if t["special"]}
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}


@dataclass
class Groups:
    """Token groups of one text: group k holds A ids up to ``a_ends[k]`` and B ids up to ``b_ends[k]``."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the identity map from A to B."""

    def __init__(self, left: str, right: str):
        import sentencepiece
        import tiktoken

        ranks = byte_level_ranks(left)
        self.left = tiktoken.Encoding("left", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.right = sentencepiece.SentencePieceProcessor(model_file=right)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        size = self.right.get_piece_size()
        self.b_bytes = [self._bytes(i) for i in range(size)]
        self.a_size = np.array([len(t) for t in self.a_bytes])
        self.b_size = np.array([len(t) for t in self.b_bytes])
        same: dict[bytes, int] = {}
        for i in range(size - 1, -1, -1):
            # Of ids with the same bytes the smallest that is a piece, else the byte id.
            token = self.b_bytes[i]
            if token not in same or not self.right.is_byte(i) or self.right.is_byte(same[token]):
                same[token] = i
        self.identity = np.array([same.get(t, -1) for t in self.a_bytes])
        written = [str(i).encode() for i in range(max(size, len(self.a_bytes)))]
        self.inner = np.array([w + b"," for w in written], dtype=object)
        self.bar = np.array([w + b"|" for w in written], dtype=object)
        self.stop = np.array([w + b";" for w in written], dtype=object)

    def _bytes(self, i: int) -> bytes:
        piece = self.right.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.right.is_byte(i) else piece.replace(SPACE, " ").encode()

    def groups(self, text: str, right: list[int]) -> Groups | None:
        """Groups of a text and its B ids; None where the tokens do not spell space and text."""
        data = b" " + text.encode()
        left = self.left.encode_ordinary(" " + text) if text else []
        if not left or not right:
            return None
        if b"".join(map(self.b_bytes.__getitem__, right)) != data or b"".join(map(self.a_bytes.__getitem__, left)) != data:
            return None
        a, b = np.array(left), np.array(right)
        a_stop, b_stop = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # A token without bytes would end where the one before it does; no such token spells text.
        at = np.searchsorted(b_stop, a_stop)
        both = np.flatnonzero(b_stop[at] == a_stop)
        return Groups(a, b, both + 1, at[both] + 1)

    def listing(self, g: Groups) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: ids of every group in order."""
        out = np.empty(len(g.a) + len(g.b), dtype=object)
        a_group = np.zeros(len(g.a), dtype=np.int64)
        a_group[g.a_ends[:-1]] = 1
        b_group = np.zeros(len(g.b), dtype=np.int64)
        b_group[g.b_ends[:-1]] = 1
        a_before = np.concatenate([[0], g.a_ends])
        b_before = np.concatenate([[0], g.b_ends])
        a_words = self.inner[g.a]
        a_words[g.a_ends - 1] = self.bar[g.a[g.a_ends - 1]]
        b_words = self.inner[g.b]
        b_words[g.b_ends - 1] = self.stop[g.b[g.b_ends - 1]]
        out[np.arange(len(g.a)) + b_before[np.cumsum(a_group)]] = a_words
        out[np.arange(len(g.b)) + a_before[np.cumsum(b_group) + 1]] = b_words
        return b"".join(out.tolist())[:-1]

    def links(self, g: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A ids and B ids that end each group, and which groups the identity map covers."""
        a, b = g.a[g.a_ends - 1], g.b[g.b_ends - 1]
        single = (np.diff(g.a_ends, prepend=0) == 1) & (np.diff(g.b_ends, prepend=0) == 1)
        return a, b, single & (self.identity[a] == b)


@lru_cache(maxsize=2)
def aligner(left: str, right: str) -> Aligner:
    """One per worker process."""
    return Aligner(left, right)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    held: list[str] = []
    load = 0
    for text in texts:
        held.append(text)
        load += len(text)
        if load >= CHUNK:
            yield held
            held, load = [], 0
    if held:
        yield held


def _given(documents: DataFrame, id: str, text: str) -> DataFrame:
    given = picked(documents, doc_id=id, text=text)
    return given.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def token_groups(documents: DataFrame, id: str = "doc_id", text: str = "text", left: str = LEFT, right: str = RIGHT) -> DataFrame:
    """doc_id, place, start, stop, a, b: every group of every text, its bytes in space + text and its ids.

    Texts that are null, empty, or not spelled by one of the tokenizers have no rows.
    """
    paths = tokenizer_path(left), tokenizer_path(right)
    given = _given(documents, id, text)

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        pair = aligner(*paths)
        for doc, value in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            g = pair.groups(value, pair.right.encode(value))
            if g is None:
                continue
            at = i = j = 0
            for place, (i_end, j_end) in enumerate(zip(g.a_ends.tolist(), g.b_ends.tolist(), strict=True)):
                stop = at + int(pair.a_size[g.a[i:i_end]].sum())
                yield doc, place, at, stop, g.a[i:i_end].tolist(), g.b[j:j_end].tolist()
                at, i, j = stop, i_end, j_end

    rest = [("place", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield from batches(rows(part), pa.schema([("doc_id", part.schema.field("doc_id").type), *rest]))

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(work, f"doc_id {kind}, place int, start bigint, stop bigint, a array<int>, b array<int>")


LISTS = ("same", "same_n", "odd_a", "odd_b", "odd_n")


def _lists(values: list[list[np.ndarray]]) -> list[pa.ListArray]:
    """One list column per place of the rows."""
    columns = []
    for arrays in zip(*values, strict=True):
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
        columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays), pa.int32())))
    return columns


def aligned(documents: DataFrame, id: str = "doc_id", text: str = "text", left: str = LEFT, right: str = RIGHT) -> DataFrame:
    """A stored row per text with its sums and digest, and its distinct links with how often each occurs.

    ``same`` lists A ids linked to the B id of their bytes, ``odd_a`` and ``odd_b`` the irregular pairs.
    ``line`` tells rows apart, since ids may repeat or be null.
    """
    paths = tokenizer_path(left), tokenizer_path(right)
    given = _given(documents, id, text).withColumn("line", F.monotonically_increasing_id())
    kind = given.schema["doc_id"].dataType.simpleString()
    none = [np.empty(0, np.int64)] * len(LISTS)

    def row(pair: Aligner, value: str, ids: list[int]) -> tuple[tuple, list[np.ndarray]]:
        g = pair.groups(value, ids)
        if g is None:
            return (0, 0, 0, ""), none
        a, b, same = pair.links(g)
        known, known_n = np.unique(a[same], return_counts=True)
        width = len(pair.b_bytes)
        odd, odd_n = np.unique(a[~same] * width + b[~same], return_counts=True)
        digest = hashlib.sha256(pair.listing(g)).hexdigest()
        return (len(g.a), len(g.b), len(g.a_ends), digest), [known, known_n, odd // width, odd % width, odd_n]

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = aligner(*paths)
        for part in parts:
            begin = 0
            for texts in _chunks(part.column("text").to_pylist()):
                found = [row(pair, t, ids) for t, ids in zip(texts, pair.right.encode(texts, num_threads=1), strict=True)]
                sums = [pa.array(c, k) for c, k in zip(zip(*(f[0] for f in found), strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                kept = [part.column(c).slice(begin, len(texts)) for c in ("line", "doc_id")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *sums, *_lists([f[1] for f in found])], names=["line", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", *LISTS]
                )
                begin += len(texts)

    fields = ", ".join(f"{c} array<int>" for c in LISTS)
    frame = given.mapInArrow(work, f"line bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, {fields}")
    return stored(frame, "aligned")


def _flat(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(name).flatten().to_numpy().astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(keys, return_inverse=True)
    # Whole numbers far below 2^53, so the sums in doubles are exact.
    return distinct, np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)


def pair_counts(texts: DataFrame, left: str = LEFT, right: str = RIGHT) -> DataFrame:
    """(a, b, n, same): how many links of the corpus hold each pair, from stored ``aligned`` rows."""
    paths = tokenizer_path(left), tokenizer_path(right)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = aligner(*paths)
        width = len(pair.b_bytes)
        vector = np.zeros(len(pair.a_bytes), dtype=np.int64)
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def batch(a: np.ndarray, b: np.ndarray, n: np.ndarray, same: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n), pa.array(np.full(len(a), same))], names=["a", "b", "n", "same"])

        for part in parts:
            if not part.num_rows:
                continue
            vector += np.bincount(_flat(part, "same"), weights=_flat(part, "same_n"), minlength=len(vector)).astype(np.int64)
            keys = np.concatenate([keys, _flat(part, "odd_a") * width + _flat(part, "odd_b")])
            keys, counts = _summed(keys, np.concatenate([counts, _flat(part, "odd_n")]))
            if len(keys) > HELD:
                yield batch(keys // width, keys % width, counts, False)
                keys, counts = keys[:0], counts[:0]
        yield batch(keys // width, keys % width, counts, False)
        seen = np.flatnonzero(vector)
        yield batch(seen, pair.identity[seen], vector[seen], True)

    partial = texts.select(*LISTS).mapInArrow(work, "a int, b int, n bigint, same boolean")
    return partial.groupBy("a", "b", "same").agg(F.sum("n").alias("n")).select("a", "b", "n", "same")


def alignment_digests(documents: DataFrame, id: str = "doc_id", text: str = "text", left: str = LEFT, right: str = RIGHT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row's whole text.

    A text that is null, empty, or whose joined A or B bytes differ from space and text has zeros and an empty
    digest.  Repeated rows and ids are rows of their own and all count; other columns are ignored; an empty table gives no rows.
    Pairs with equal highest counts are all best.
    """
    paths = tokenizer_path(left), tokenizer_path(right)
    texts = aligned(documents, id, text, left, right)
    pairs = stored(pair_counts(texts, left, right), "pairs")
    pair = aligner(*paths)
    width = len(pair.b_bytes)
    # One number per id of a vocabulary, and fewer than FREQUENT pairs.
    best = np.zeros(width, dtype=np.int64)
    for r in pairs.groupBy("b").agg(F.max("n").alias("n")).collect():
        best[r["b"]] = r["n"]
    vector = np.zeros(len(pair.a_bytes), dtype=np.int64)
    for r in pairs.where("same").select("a", "n").collect():
        vector[r["a"]] = r["n"]
    total = pairs.agg(F.sum("n").alias("n")).first()["n"] or 0
    common = sorted((r["a"] * width + r["b"], r["n"]) for r in pairs.where(~F.col("same") & (F.col("n") * FREQUENT > total)).select("a", "b", "n").collect())
    keys, counts = np.array([k for k, _ in common] + [np.iinfo(np.int64).max]), np.array([n for _, n in common] + [0])
    tables = texts.sparkSession.sparkContext.broadcast((vector, best, keys, counts))

    def known(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Irregular links with the place of each in the table of frequent pairs, and whether it is there."""
        _, _, keys_, _ = tables.value
        a, b, n = (_flat(part, c) for c in ("odd_a", "odd_b", "odd_n"))
        at = np.searchsorted(keys_, a * width + b)
        return a, b, n, at, keys_[at] == a * width + b

    def by_row(part: pa.RecordBatch, name: str, values: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(values)])
        offsets = part.column(name).offsets.to_numpy()
        offsets = offsets - offsets[0]
        return run[offsets[1:]] - run[offsets[:-1]]

    def looked_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector_, best_, _, counts_ = tables.value
        identity = aligner(*paths).identity
        for part in parts:
            if not part.num_rows:
                continue
            ids, n = _flat(part, "same"), _flat(part, "same_n")
            held = vector_[ids]
            n_best = by_row(part, "same", n * (held == best_[identity[ids]]))
            count_sum = by_row(part, "same", n * held)
            _, b, n, at, found = known(part)
            held = np.where(found, counts_[at], 0)
            n_best += by_row(part, "odd_a", n * (found & (held == best_[b])))
            count_sum += by_row(part, "odd_a", n * held)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("line", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")), pa.array(n_best), pa.array(count_sum)],
                names=["line", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum"],
            )

    def rare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, best_, _, _ = tables.value
        for part in parts:
            if not part.num_rows:
                continue
            a, b, n, _, found = known(part)
            offsets = part.column("odd_a").offsets.to_numpy()
            line = np.repeat(part.column("line").to_numpy(), np.diff(offsets))
            rest = ~found
            yield pa.RecordBatch.from_arrays(
                [pa.array(line[rest]), pa.array(a[rest], pa.int32()), pa.array(b[rest], pa.int32()), pa.array(n[rest]), pa.array(best_[b[rest]])],
                names=["line", "a", "b", "links", "best"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(looked_up, f"line bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    left_over = texts.select("line", "odd_a", "odd_b", "odd_n").mapInArrow(rare, "line bigint, a int, b int, links bigint, best bigint")
    counted = left_over.join(pairs.where(~F.col("same")).select("a", "b", "n"), ["a", "b"])
    more = counted.groupBy("line").agg(
        F.sum(F.when(F.col("n") == F.col("best"), F.col("links")).otherwise(0)).alias("more_best"),
        F.sum(F.col("n") * F.col("links")).alias("more_sum"),
    )
    return rows.join(more, "line", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
