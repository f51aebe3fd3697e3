"""Token ids in seekable files of independent Zstandard frames.

A file holds one frame per document, then a directory frame with the document ids, then the seek
table in a skippable frame: compressed size, plain size and checksum (the low half of XXH64) of every frame,
and a footer with their number.  A reader takes footer, table and directory from the end and
decompresses the frames of the documents it is asked for, no others.  Plain Zstandard readers
can read the file from front to back.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import batches, picked, shared_folder, stored
from tidepanel.llm.files import new_name, opened
from tidepanel.llm.wordbpe import tokenizer_path, word_ids

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
LEVEL = 3
DIRECTORY = struct.Struct("<4sBBIQ")  # mark, version, bytes per id, zero, documents
MARK = b"TIDX"


class FrameWriter:
    """Appends documents to one file."""

    def __init__(self, sink, width: int, level: int = LEVEL):  # noqa: ANN001
        self.sink = sink
        self.width = width
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=False).compress
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []

    def _frame(self, data: bytes) -> None:
        packed = self.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._frame(ids)
        self.ids.append(doc_id)

    def close(self) -> None:
        present = np.array([i is not None for i in self.ids], dtype=np.uint8)
        values = np.array([i or 0 for i in self.ids], dtype="<i8")
        head = DIRECTORY.pack(MARK, 1, self.width, 0, len(self.ids))
        self._frame(head + np.packbits(present).tobytes() + values.tobytes())
        table = np.array(self.frames, dtype="<u4").tobytes()
        footer = struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)


class FrameReader:
    """Reads chosen documents of one file (an object with read, seek and tell)."""

    def __init__(self, source):  # noqa: ANN001
        self.source = source
        end = source.seek(0, 2) or source.tell()
        source.seek(end - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        source.seek(end - 9 - 12 * count - 8)
        skippable, size = struct.unpack("<II", source.read(8))
        if skippable != SKIPPABLE_MAGIC or size != 12 * count + 9:
            raise ValueError("broken seek table")
        table = np.frombuffer(source.read(12 * count), dtype="<u4").reshape(-1, 3)
        self.sizes, self.plain, self.checks = table[:, 0], table[:, 1], table[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes.astype(np.int64))])
        self.decompress = zstandard.ZstdDecompressor().decompress
        directory = self.frame(count - 1)
        mark, version, self.width, _, documents = DIRECTORY.unpack_from(directory)
        if mark != MARK or version != 1:
            raise ValueError("no directory of documents")
        flags_size = (documents + 7) // 8
        present = np.unpackbits(np.frombuffer(directory, np.uint8, flags_size, DIRECTORY.size), count=documents)
        values = np.frombuffer(directory, "<i8", documents, DIRECTORY.size + flags_size)
        self.ids = [int(v) if p else None for v, p in zip(values, present, strict=True)]
        self.counts = self.plain[:-1].astype(np.int64) // self.width

    def frame(self, place: int) -> bytes:
        self.source.seek(int(self.starts[place]))
        data = self.decompress(self.source.read(int(self.sizes[place])), max_output_size=int(self.plain[place]))
        if len(data) != self.plain[place] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checks[place]:
            raise ValueError(f"frame {place} does not match its checksum")
        return data

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, ids), for all or only the wanted ids."""
        before = np.concatenate([[0], np.cumsum(self.counts)])
        chosen = None if wanted is None else set(wanted)
        for place, doc_id in enumerate(self.ids):
            if chosen is None or doc_id in chosen:
                yield doc_id, int(before[place]), np.frombuffer(self.frame(place), f"<u{self.width}")


def write_token_files(
    documents: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    level: int = LEVEL,
) -> DataFrame:
    """Writes the files and returns one row for each: part, file, docs, n_tokens, bytes, start.

    Files in the order of ``part`` hold the documents in ascending id (null first; rows of one
    id in the order of their text hash); ``start`` counts the ids of all files before.  Each document's
    ids end with ``end_id``.  Null and empty texts have that id alone.  An empty table writes no file.

    One range shuffle of the texts orders them; they are encoded behind it, so that sampling the
    ranges reads ids only, and each task writes its range as it streams by.
    """
    path = tokenizer_path(tokenizer)
    folder = shared_folder(documents.sparkSession, "tokens")
    given = picked(documents, doc_id=id, text=text)
    given = given.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = given.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64())])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        width = encoder.dtype.itemsize if end_id < 1 << 16 else 4
        end = end_id.to_bytes(width, "little")
        system, base = opened(folder)
        name, writer, sink, tokens = "", None, None, 0
        part_no = TaskContext.get().partitionId()
        for part in parts:
            for doc, value in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if writer is None:
                    system.create_dir(base, recursive=True)
                    name = new_name(f"{base}/tokens-{part_no:06d}", ".zst")
                    sink = system.open_output_stream(name, compression=None)
                    writer = FrameWriter(sink, width, level)
                ids = encoder.text(value)
                if width != encoder.dtype.itemsize:
                    ids = np.frombuffer(ids, encoder.dtype).astype("<u4").tobytes()
                writer.add(doc, ids + end)
                tokens += len(ids) // width + 1
        if writer is not None:
            writer.close()
            size = sink.tell()
            sink.close()
            yield from batches([(part_no, f"{folder}/{name.rpartition('/')[2]}", len(writer.ids), tokens, size)], schema)

    files = stored(ordered.mapInArrow(work, "part int, file string, docs bigint, n_tokens bigint, bytes bigint"), "token-index")
    # One row per file: the running sum over all files is small.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint"))


def read_token_files(files: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in the files; ``ids`` as 32-bit little-endian bytes.

    With ``wanted`` only those documents' frames are decompressed.
    """
    return _read(files, wanted, digest=False)


def read_token_digests(files: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): like ``read_token_files``, the ids reduced to their checksum."""
    return _read(files, wanted, digest=True)


def _read(files: DataFrame, wanted: list[int] | None, digest: bool) -> DataFrame:
    value = ("ids_crc32", "bigint", pa.int64()) if digest else ("ids", "binary", pa.binary())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (value[0], value[2])])

    def rows(file: str, start: int) -> Iterator[tuple]:
        system, path = opened(file)
        with system.open_input_file(path) as source:
            for doc, before, ids in FrameReader(source).documents(wanted):
                plain = ids.astype("<u4").tobytes()
                yield doc, start + before, len(ids), zlib.crc32(plain) if digest else plain

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file, start in zip(part.column("file").to_pylist(), part.column("start").to_pylist(), strict=True):
                yield from batches(rows(file, start), schema)

    # The rows are tiny, the files are not: one task per file, not one per megabyte of rows.
    count = max(1, files.count())
    spread = files.select("file", "start").repartitionByRange(count, "start")
    return spread.mapInArrow(work, f"doc_id bigint, start bigint, n_tokens bigint, {value[0]} {value[1]}")
