"""Token counts by a two-tier lookup on the map side.

Tier one is a table of frequent words and their token counts, made from a bounded sample and
broadcast; tier two a cache in each worker, where words that neither holds are encoded once.
No word is ever shuffled.  Both tiers hold exact counts, so they decide the speed only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import batches, picked
from tidepanel.llm.wordbpe import Recent, tokenizer_path, word_ids

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
SAMPLE_DOCS = 4000
SAMPLE_WORDS = 20_000
FREQUENT = 50_000
LONGEST = 48


def frequent_words(texts: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, size: int = FREQUENT) -> tuple[bytes, bytes]:
    """At most ``size`` frequent words, newline-separated, and one byte with the token count of each.

    The words come from about ``sample_docs`` whole texts drawn from all rows; every task sends its
    ``SAMPLE_WORDS`` commonest words and their counts.  Words over ``LONGEST`` bytes stay out, so the table
    is under 2.5 MB whatever the corpus.
    """
    total = texts.count()
    if not total:
        return b"", b""
    drawn = texts.sample(min(1.0, sample_docs / total), seed=17)
    schema = pa.schema([("word", pa.string()), ("seen", pa.int64()), ("size", pa.int32())])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        seen: Counter = Counter()
        for part in parts:
            for text in part.column("text").to_pylist():
                seen.update(encoder.split(text))
        width = encoder.dtype.itemsize
        rows = (
            (word, count, len(encoder.words[word]) // width)
            for word, count in seen.most_common(SAMPLE_WORDS)
            if count > 1 and len(word.encode()) <= LONGEST
        )
        yield from batches((r for r in rows if r[2] < 256), schema)

    words = drawn.mapInArrow(work, "word string, seen bigint, size int").groupBy("word").agg(F.sum("seen").alias("seen"), F.first("size").alias("size"))
    rows = words.orderBy(F.desc("seen"), "word").limit(size).select("word", "size").collect()
    return "\n".join(r["word"] for r in rows).encode(), bytes(r["size"] for r in rows)


class TwoTier(dict):
    """word -> token count; the dict itself is tier one and does not grow."""

    def __init__(self, path: str, words: bytes, sizes: bytes):
        super().__init__(zip(words.decode().split("\n"), np.frombuffer(sizes, np.uint8).tolist(), strict=True) if sizes else ())
        self.encoder = word_ids(path)
        width = self.encoder.dtype.itemsize
        self.recent = Recent(lambda word: len(self.encoder.encoded(word)) // width)

    def __missing__(self, word: str) -> int:
        return self.recent[word]

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.encoder.split(text)))


_TABLES: dict[tuple, TwoTier] = {}


def two_tier(path: str, frequent: Broadcast) -> TwoTier:
    """One table per worker process and broadcast."""
    key = (path, hash(frequent.value))
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = TwoTier(path, *frequent.value)
    return _TABLES[key]


def token_counts(
    documents: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    limit: int = LIMIT,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text.

    Null and empty texts have no bytes and no tokens.  Rows are counted one by one: repeated rows and ids
    stay as they are, an empty table gives no rows, other columns are ignored.
    """
    path = tokenizer_path(tokenizer)
    given = picked(documents, doc_id=id, text=text)
    given = given.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    frequent = given.sparkSession.sparkContext.broadcast(frequent_words(given.select("text"), path))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = two_tier(path, frequent)
        for part in parts:
            counts = pa.array([table.count(value) for value in part.column("text").to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), counts], names=["doc_id", "n_bytes", "n_tokens"])

    kind = given.schema["doc_id"].dataType.simpleString()
    measured = given.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    counted = measured.mapInArrow(work, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
