"""Repeated lines or paragraphs, and repeated passages wherever they begin and end.

Units are normalised and hashed where the text is read; digests, not texts, are grouped over the
whole corpus.  The occurrence that ranks first stays, every other one is a span to cut, given by offsets
(code points) into the original text.

A passage is a run of ``PASSAGE`` words or more; line ends mean nothing to it.  Every window of
that many words has an anchor: the smallest hash of the shorter runs inside it.  Equal windows have
equal anchors, so only windows whose anchor comes twice in the corpus can repeat, and only these are hashed whole
and grouped.  No repeated window is missed.  Texts of the same words are compared as wholes first, and only
one of them goes through the windows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidepanel.llm.common import batches, marked_possible, picked, possible, stored

MIN_WORDS = 20
PASSAGE = 50
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD = re.compile(r"\S+")
#: A window is known by the number of its text and that of its first word, in one integer.
WORD_BITS = 30
UNITS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")}


def normalised(unit: str) -> str:
    """Case folded, white space runs one space, no white space at the ends."""
    return " ".join(unit.casefold().split())


def units(text: str, unit: str = "line") -> Iterator[tuple[int, int]]:
    """(start, end) of each unit; the separator after a unit belongs to neither."""
    start = 0
    for gap in UNITS[unit].finditer(text):
        yield start, gap.start()
        start = gap.end()
    yield start, len(text)


def unit_digests(documents: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, body, start, end, n_words, digest) of every unit with at least ``min_words`` words; body is a hash of the text."""
    given = _given(documents, id, text)
    kind = given.schema["doc_id"].dataType.simpleString()

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        for doc, body, value in _columns(part, "doc_id", "body", "text"):
            for start, end in units(value, unit) if value else ():
                plain = normalised(value[start:end])
                count = plain.count(" ") + 1 if plain else 0
                if count >= min_words:
                    yield doc, body, start, end, count, hashlib.blake2b(plain.encode(), digest_size=16).digest()

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            schema = pa.schema(
                [("doc_id", part.schema.field("doc_id").type), ("body", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("digest", pa.binary())]
            )
            yield from batches(rows(part), schema, size=1 << 14)

    return given.mapInArrow(work, f"doc_id {kind}, body bigint, start int, end int, n_words int, digest binary")


def _given(documents: DataFrame, id: str, text: str) -> DataFrame:
    given = picked(documents, doc_id=id, text=text).withColumn("text", F.col("text").cast("string"))
    return given.withColumn("body", F.xxhash64("text"))


def _columns(part: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(part.column(name).to_pylist() for name in names), strict=True)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def rolled(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash, mod 2**64, of every ``size`` neighbours; made from those of half the size."""
    if size == 1:
        return hashes
    half = size // 2
    short = rolled(hashes, half, base)
    count = len(hashes) - 2 * half + 1
    both = short[:count] * np.uint64(pow(base, half, 1 << 64)) + short[half : half + count]
    if size % 2:
        both = both[:-1] * np.uint64(base) + hashes[size - 1 :]
    return both


def anchors(hashes: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of half a passage, and the smallest of them in each window of a passage."""
    half = (passage + 1) // 2
    runs = mixed(rolled(hashes, half, BASES[0]))
    width, least, wide = passage - half + 1, runs, 1
    while wide < width:
        step = min(wide, width - wide)
        least = np.minimum(least[: len(least) - step], least[step:])
        wide += step
    return runs, least


def _anchor_counts(given: DataFrame, passage: int) -> DataFrame:
    """The anchors of each text and how often each run occurs in it; and a row with ``times`` 0 per text.

    That row has a digest of all words in (anchor, other), their number and the place from the first to the last.
    """
    kind = given.schema["doc_id"].dataType.simpleString()

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            schema = pa.schema(
                [("doc_id", part.schema.field("doc_id").type), ("body", pa.int64()), ("anchor", pa.int64()), ("times", pa.int32()),
                 ("other", pa.int64()), ("n_words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
            )
            for doc, body, value in _columns(part, "doc_id", "body", "text"):
                words = value.casefold().split() if value else ()
                if len(words) < passage:
                    continue
                hashes = word_hashes(words)
                runs, least = anchors(hashes, passage)
                chosen = np.unique(least)
                at = np.minimum(np.searchsorted(chosen, runs), len(chosen) - 1)
                times = np.bincount(at[chosen[at] == runs], minlength=len(chosen))
                whole = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), dtype=np.int64)
                count = len(chosen) + 1
                last = lambda x: pa.array([None] * (count - 1) + [int(x)], type=pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc] * count, type=schema.field("doc_id").type), pa.array(np.full(count, body)),
                        pa.array(np.append(chosen.view(np.int64), whole[0])), pa.array(np.append(times, 0).astype(np.int32)), last(whole[1]),
                        *(last(x).cast(pa.int32()) for x in (len(words), len(value) - len(value.lstrip()), len(value.rstrip()))),
                    ],
                    schema=schema,
                )

    fields = "body bigint, anchor bigint, times int, other bigint, n_words int, start int, end int"
    return given.select("doc_id", "body", "text").mapInArrow(work, f"doc_id {kind}, {fields}")


def _numbered(texts: DataFrame) -> DataFrame:
    """The rows with ``num``, their place in the order of doc_id (null last) and body, without gaps."""
    ordered = texts.orderBy(F.col("doc_id").isNull(), "doc_id", "body").withColumn("row", F.monotonically_increasing_id())
    ordered = stored(ordered, "ordered").withColumn("part", F.shiftright("row", 33).cast("int"))
    # One row per partition of the sort.
    sizes = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}
    before = [sum(n for part, n in sizes.items() if part < k) for k in range(max(sizes, default=0) + 1)]
    start = F.array(*(F.lit(n).cast("bigint") for n in before))[F.col("part")]
    return ordered.withColumn("num", start + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).drop("row", "part")


def _window_digests(marked: DataFrame, passage: int) -> DataFrame:
    """(at, high, low) of every window of ``passage`` words whose anchor is among ``anchors``.

    One more row per text, with ``high`` null, has its number in ``at`` and the places of all its words.
    """

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("at", pa.int64()), ("high", pa.int64()), ("low", pa.int32()), ("spots", pa.binary())])
        for part in parts:
            for row, (num, value) in enumerate(_columns(part, "num", "text")):
                found = list(WORD.finditer(value))
                hashes = word_hashes([m.group().casefold() for m in found])
                _, least = anchors(hashes, passage)
                wanted = part.column("anchors")[row].values.to_numpy(zero_copy_only=False).view(np.uint64)
                word = np.flatnonzero(np.isin(least, wanted))
                high = mixed(rolled(hashes, passage, BASES[0])[word]).view(np.int64)
                low = (rolled(mixed(hashes), passage, BASES[1])[word] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                edges = np.fromiter((x for m in found for x in m.span()), dtype=np.int32, count=2 * len(found))
                spots = zlib.compress(np.diff(edges, prepend=np.int32(0)).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((num, None, None, spots), schema, strict=True)], schema=schema)
                for k in range(0, len(word), 1 << 14):
                    here = slice(k, k + (1 << 14))
                    at = (num << WORD_BITS) + word[here].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(high[here]), pa.array(low[here]), pa.nulls(len(at), pa.binary())], schema=schema)

    return marked.select("num", "text", "anchors").mapInArrow(work, "at bigint, high bigint, low int, spots binary")


@lru_cache(maxsize=64)
def _edges(spots: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(spots), dtype=np.int32))


@F.pandas_udf(IntegerType())
def _edge(spots: pd.Series, place: pd.Series) -> pd.Series:
    """The start (even places) or end (odd ones) of a word."""
    return pd.Series([int(_edges(bytes(s))[k]) for s, k in zip(spots, place, strict=True)], dtype="int32")


def repeated_passages(documents: DataFrame, id: str = "doc_id", text: str = "text", passage: int = PASSAGE) -> DataFrame:
    """One row per run of repeated windows: doc_id, body, start, end, n_words, kept_doc_id, kept_start, copies.

    A window of ``passage`` words (case folded, any white space between them) stays where it
    ranks first: by doc_id (null last), then text, then place.  Its other occurrences are removed,
    but not those that overlap the first in the same text.  Neighbouring windows whose first occurrences are
    neighbours too are one row; rows of different origin can overlap, and the words they cover together go.
    copies is the smallest number of occurrences of a window of the row, counted over different texts;
    for a text that repeats another as a whole it is the number of those texts.
    """
    given = _given(documents, id, text)
    found = stored(_anchor_counts(given, passage), "anchors")
    texts = _numbered(found.where("times = 0").dropDuplicates(["doc_id", "body"]))
    same = texts.groupBy("anchor", "other").agg(F.min("num").alias("kept"), F.count("*").alias("copies"))
    texts = stored(texts.join(same, ["anchor", "other"]).select("doc_id", "body", "num", "n_words", "start", "end", "kept", "copies"), "texts")
    leads = texts.where("num = kept")
    first = leads.select("kept", F.col("doc_id").alias("kept_doc_id"), F.col("start").alias("kept_start"))
    columns = ["doc_id", "body", "start", "end", "n_words", "kept_doc_id", "kept_start", "copies"]
    whole = texts.where("num <> kept").join(first, "kept").select(columns)

    named = leads.select(F.col("doc_id").alias("lead_id"), F.col("body").alias("lead_body"), "num")
    own = F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("body") == F.col("lead_body"))
    owned = stored(found.where("times > 0").join(named, own).select("num", "anchor", "times"), "owned")
    twice = owned.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor")
    wanted = owned.join(twice, "anchor").groupBy("num").agg(F.collect_set("anchor").alias("anchors")).join(named, "num")
    wanted = stored(wanted, "wanted")
    # Texts without such a window are not moved.
    asked = possible(given, "body", wanted.select("lead_body"))
    read = stored(_window_digests(asked.join(wanted, own), passage), "windows")
    windows = read.where("high IS NOT NULL").select("at", "high", "low")
    spots = read.where("high IS NULL").select(F.col("at").alias("num"), "spots").dropDuplicates(["num"])
    repeated = windows.groupBy("high", "low").agg(F.min("at").alias("kept_at"), F.count("*").alias("copies")).where("copies > 1")
    again = windows.join(repeated, ["high", "low"]).where("at <> kept_at").select("at", "kept_at", "copies")
    number = lambda name: F.shiftright(name, WORD_BITS)
    again = again.withColumn("num", number("at")).where((number("kept_at") != F.col("num")) | (F.col("at") >= F.col("kept_at") + passage))
    # The windows of one text come together: they are bounded by the text.  Repeated rows count once.
    again = again.repartition("num").dropDuplicates(["num", "at"])
    along = Window.partitionBy("num").orderBy("at")
    follows = (F.col("at") == F.lag("at").over(along) + 1) & (F.col("kept_at") == F.lag("kept_at").over(along) + 1)
    runs = again.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("new").over(along))
    runs = runs.groupBy("num", "run").agg(
        F.min("at").alias("at"), F.min_by("kept_at", "at").alias("kept_at"), F.min("copies").alias("copies"),
        (F.count("*") + passage - 1).cast("int").alias("n_words"),
    )
    word = lambda name: F.col(name).bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")
    placed = runs.join(spots, "num").select(
        "num", "kept_at", "copies", "n_words", _edge("spots", 2 * word("at")).alias("start"),
        _edge("spots", 2 * (word("at") + F.col("n_words")) - 1).alias("end"),
    )
    kept = leads.select(F.col("num").alias("kept"), F.col("doc_id").alias("kept_doc_id"))
    placed = placed.withColumn("kept", number("kept_at")).join(spots.withColumnRenamed("num", "kept"), "kept")
    placed = placed.withColumn("kept_start", _edge("spots", 2 * word("kept_at"))).drop("spots").join(kept, "kept")
    return placed.join(leads.select("num", "doc_id", "body"), "num").select(columns).unionByName(whole)


def repeated_units(
    documents: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    unit: str = "line",
    min_words: int = MIN_WORDS,
    passage: int = PASSAGE,
) -> DataFrame:
    """One row per occurrence to remove: doc_id, start, end, n_words, kept_doc_id, kept_start, copies.

    Occurrences rank by doc_id (null last), then by start; the first stays and the others carry
    its place.  Units shorter than ``min_words`` words are common phrases and never removed;
    null and empty texts have no units.  Rows that repeat a doc_id and a text are one document
    to the ranking: the first occurrence stays in all of them.  An empty table gives no rows.

    Besides the units, passages of ``passage`` words or more go wherever they begin and end (see
    ``repeated_passages``; 0: none).  A passage and the units in it are rows of their own, so rows can
    overlap; together they cover what goes.

    First places and counts are partial aggregates, and only digests seen twice are joined
    back; where one passage fills a large part of the corpus Spark splits its key in that join.
    """
    return _repeats(documents, id, text, unit, min_words, passage).drop("body")


def _repeats(documents: DataFrame, id: str, text: str, unit: str, min_words: int, passage: int) -> DataFrame:
    found = stored(unit_digests(documents, id, text, unit, min_words), "units")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("kept_doc_id"), F.col("start").alias("kept_start"))
    first = found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = found.join(first.select("digest", "first.kept_doc_id", "first.kept_start", "copies"), "digest")
    same = F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("start") == F.col("kept_start"))
    whole = again.where(~same).select("doc_id", "body", "start", "end", "n_words", "kept_doc_id", "kept_start", "copies")
    return whole.unionByName(repeated_passages(documents, id, text, passage)) if passage else whole


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a cut takes the separator after its unit along, at the end the one before.

    Spans can overlap.  A cut that begins inside a line leaves the line end and takes one blank along.
    """
    out, at, begins = [], 0, True
    for start, end in sorted(spans):
        if end <= at:
            continue
        out.append(text[at:start])
        begins = start <= at and begins or text[max(start - 1, 0) : start] in ("", "\n")
        at = end
        if text[at : at + 1] == "\n":
            at += begins
        elif text[at : at + 1] in (" ", "\t"):
            at += 1
    out.append(text[at:])
    kept = "".join(out)
    return kept.rstrip("\n") if begins and at >= len(text) and not text.endswith("\n") else kept


def without_repeats(
    documents: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    unit: str = "line",
    min_words: int = MIN_WORDS,
    passage: int = PASSAGE,
) -> DataFrame:
    """All columns of the documents and ``removed_spans``, the text without the repeated units and passages.

    removed_spans: array of (start, end, kept_doc_id) in the original text, empty where nothing
    went.  Rows stay even if their whole text went; a null text stays null.  Columns keep their
    names and order, whatever they are called.  The spans of one document come together: their
    number is bounded by the document.
    """
    places = {name: k for k, name in enumerate(documents.columns)}
    frame = documents.toDF(*(f"c{k}" for k in places.values()))
    key, body = (f"c{places[name]}" for name in (id, text))
    repeats = _repeats(frame, key, body, unit, min_words, passage)
    spans = repeats.select("doc_id", "body", F.struct("start", "end", "kept_doc_id").alias("span")).distinct()
    spans = spans.groupBy("doc_id", "body").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    spans = stored(spans.select(F.col("doc_id").alias("span_id"), F.col("body").alias("span_body"), "spans"), "spans")
    own = F.col(key).eqNullSafe(F.col("span_id")) & (F.col("body") == F.col("span_body"))
    hashed = frame.withColumn("body", F.xxhash64(F.col(body).cast("string")))
    marked = marked_possible(hashed, "body", spans.select("span_body"))
    # Documents that surely keep their text are not moved.
    joined = marked.where("possible").join(spans, own, "left").drop("span_id", "span_body")
    removed = f"array<struct<start:int,end:int,kept_doc_id:{frame.schema[key].dataType.simpleString()}>>"
    joined = joined.unionByName(marked.where("NOT possible").withColumn("spans", F.lit(None).cast(removed)))

    # Only texts with something to cut travel to Python, and a filter above does not cut them twice.
    trim = F.pandas_udf(_trimmed, "string").asNondeterministic()
    marked = F.when(F.col("spans").isNotNull(), F.col(body))
    texts = F.coalesce(trim(marked, F.col("bounds")), F.col(body))
    bounds = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    joined = joined.withColumn("bounds", bounds).withColumn("bounds", F.coalesce("bounds", F.array().cast("array<struct<start:int,end:int>>")))
    return joined.select(
        *((texts if name == text else F.col(f"c{k}")).alias(name) for name, k in places.items()),
        F.coalesce(F.col("spans"), F.array().cast(removed)).alias("removed_spans"),
    )


def _trimmed(texts, bounds):  # noqa: ANN001, ANN202  pandas series in and out
    return texts.combine(
        bounds, lambda value, spans: value if value is None or not len(spans) else cut(value, [(s["start"], s["end"]) for s in spans])
    )
