"""WARC archives, each record compressed on its own with a dictionary of the archive's records.

Every file begins with a skippable frame that holds a Zstandard dictionary made from records of
that file; every record after it is one frame.  A record can be read alone, by offset and length, and
still profits from what the records have in common.  Payloads archived before are revisit records
that refer to the response.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import batches, picked, shared_folder, stored, utf8
from tidepanel.llm.files import new_name, opened

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
RAW_DICTIONARY = b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "2000-01-01T00:00:00Z"  # records of a table have no capture time
LEVEL = 6
DICTIONARY_BYTES = 64 << 10
TRAIN_BYTES = 4 << 20
TRAIN_RECORDS = 8
SPACE = 0x7769_6465_7061  # upper 48 bits of the record ids


def record_id(page_id: int | None, unnamed: int = 0) -> str:
    """A version 8 UUID that carries the page id, or for a page without one a number of its own."""
    low = unnamed if page_id is None else page_id & (1 << 64) - 1
    named = page_id is not None
    top = low >> 62 | named << 2
    value = SPACE << 80 | 8 << 76 | top << 64 | 2 << 62 | low & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(record: str) -> int | None:
    """The page id a record id carries."""
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    top = value >> 64 & 0xFFF
    if not top & 4:
        return None
    low = (top & 3) << 62 | value & (1 << 62) - 1
    return low - (1 << 64) if low >> 63 else low


def base32_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, unnamed: int = 0) -> bytes:
    """One record: a response with its payload, or a revisit with the response's HTTP head only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    # Line breaks and other controls cannot stand in a header line.
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, unnamed)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if target else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Date: {DATE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields, HTTP header fields and payload of a record; names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length does not match its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = {n.lower(): v.strip() for n, _, v in (line.partition(":") for line in http.decode().split("\r\n")[1:])}
    return fields, http_fields, payload


def dictionary_of(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on the samples, or where they are too few or too unlike for that, one of their beginnings."""
    total = sum(map(len, samples))
    size = min(size, max(1024, total // 8))
    if len(samples) >= TRAIN_RECORDS:
        try:
            return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass  # the library refuses samples that have too little in common
    share = max(8, size // len(samples))
    return b"".join(sample[:share] for sample in samples)


class ArchiveWriter:
    """Writes records to one file; the first ``TRAIN_BYTES`` of them wait until the dictionary is made."""

    def __init__(self, sink, train_bytes: int = TRAIN_BYTES):  # noqa: ANN001
        self.sink = sink
        self.train_bytes = train_bytes
        self.waiting: list[bytes] = []
        self.load = 0
        self.compress = None
        self.at = 0

    def _begin(self) -> None:
        dictionary = dictionary_of(self.waiting)
        # The dictionary itself travels compressed.
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        self.sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.at = 8 + len(packed)
        shared = zstandard.ZstdCompressionDict(dictionary)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True, write_content_size=True).compress

    def _write(self, record: bytes) -> tuple[int, int]:
        frame = self.compress(record)
        self.sink.write(frame)
        place = (self.at, len(frame))
        self.at += len(frame)
        return place

    def add(self, record: bytes) -> list[tuple[int, int]]:
        """Offsets and lengths of the records written by this call, in the order they were added."""
        if self.compress is not None:
            return [self._write(record)]
        self.waiting.append(record)
        self.load += len(record)
        return self.flush() if self.load >= self.train_bytes else []

    def flush(self) -> list[tuple[int, int]]:
        if self.compress is None and self.waiting:
            self._begin()
        places = [self._write(r) for r in self.waiting]
        self.waiting = []
        return places


def archive_dictionary(source) -> tuple[zstandard.ZstdCompressionDict | None, int]:  # noqa: ANN001
    """The dictionary at the head of a file and where its records begin."""
    source.seek(0)
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != DICTIONARY_MAGIC:
        return None, 0
    size = struct.unpack("<II", head)[1]
    data = source.read(size)
    if not data.startswith(RAW_DICTIONARY):
        data = zstandard.ZstdDecompressor().decompress(data)
    return zstandard.ZstdCompressionDict(data), 8 + size


def read_record(source, offset: int, length: int, dictionary: zstandard.ZstdCompressionDict | None) -> bytes:  # noqa: ANN001
    """One record by its place in the file."""
    source.seek(offset)
    return zstandard.ZstdDecompressor(dict_data=dictionary).decompress(source.read(length))


def read_records(source) -> Iterator[bytes]:  # noqa: ANN001
    """All records of a file, one frame after the other."""
    dictionary, start = archive_dictionary(source)
    source.seek(start)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = b""
    while True:
        frame = decompressor.decompressobj()
        out = []
        while not frame.eof:
            data = rest or source.read(1 << 20)
            rest = b""
            if not data:
                if out:
                    raise ValueError("the last record is cut off")
                return
            out.append(frame.decompress(data))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def write_archives(
    pages: DataFrame,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_payload: int = 0,
) -> DataFrame:
    """Writes one record per row and returns its place: page_id, file, offset, length, record_type.

    Of records with equal payloads of at least ``min_payload`` bytes the one with the largest
    page id is the response and the others revisit it; smaller payloads are all responses.  A
    null payload is empty.  Rows that repeat the largest id and its payload are responses too,
    and rows without an id are always responses that nothing refers to.  An empty table writes
    no file.

    Payloads meet their response by SHA-1: the largest id per digest is a partial aggregate over digests
    alone, and the pages join only digests seen twice.  A file is what one task holds;
    its rows are the index, and files of attempts that failed are in no index.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    given = picked(pages, page_id=id, url=url, html=html)
    given = given.select(F.col("page_id").cast("bigint"), F.col("url").cast("string").alias("url"), utf8(F.col("html")).alias("payload"))
    hashed = given.withColumn("sha", F.unhex(F.sha1("payload")))
    large = F.col("page_id").isNotNull() & (F.octet_length("payload") >= min_payload)
    keepers = hashed.where(large).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    keepers = keepers.where("copies > 1").select(F.col("sha").alias("kept_sha"), "keeper")
    joined = hashed.join(keepers, (F.col("sha") == F.col("kept_sha")) & large, "left")
    refers = F.when(F.col("page_id") < F.col("keeper"), F.col("keeper"))
    records = joined.select("page_id", "url", "payload", "sha", refers.alias("refers_to"))
    schema = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        system, base = opened(folder)
        task = TaskContext.get().partitionId()
        writer, sink, name = None, None, ""
        waiting: list[tuple] = []
        for number, row in enumerate(chain.from_iterable(_tuples(part) for part in parts)):
            page, address, payload, sha, refers_to = row
            if writer is None:
                system.create_dir(base, recursive=True)
                name = new_name(f"pages-{task:06d}", ".warc.zst")
                sink = system.open_output_stream(f"{base}/{name}", compression=None)
                writer = ArchiveWriter(sink)
            waiting.append((page, "response" if refers_to is None else "revisit"))
            places = writer.add(warc_record(page, address, payload, base32_digest(sha), refers_to, task << 40 | number))
            yield from _indexed(waiting, places, f"{folder}/{name}")
        if writer is not None:
            yield from _indexed(waiting, writer.flush(), f"{folder}/{name}")
            sink.close()

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(parts), schema)

    fields = "page_id bigint, file string, offset bigint, length bigint, record_type string"
    return stored(records.mapInArrow(work, fields), "warc-index")


def _tuples(part: pa.RecordBatch) -> Iterator[tuple]:
    columns = [part.column(c) for c in ("page_id", "url", "payload", "sha", "refers_to")]
    return zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), columns[3].to_pylist(), columns[4].to_pylist(), strict=True)


def _indexed(waiting: list[tuple], places: list[tuple[int, int]], file: str) -> Iterator[tuple]:
    """Index rows of the records that have just been written; they leave the list."""
    for (page, kind), (offset, length) in zip(waiting[: len(places)], places, strict=True):
        yield page, file, offset, length, kind
    del waiting[: len(places)]


def read_archives(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and the payload) of every record in the files.

    A response's payload is hashed again and must match the record's digest.  A revisit states
    digest and length of the payload it refers to.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("payload", pa.binary())] * with_payload)

    def rows(file: str) -> Iterator[tuple]:
        system, path = opened(file)
        with system.open_input_file(path) as source:
            for data in read_records(source):
                head, http, payload = parse_record(data)
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                revisit = head["warc-type"] == "revisit"
                size = int(http["content-length"])
                if not revisit and (len(payload) != size or base32_digest(hashlib.sha1(payload).digest()) != digest):
                    raise ValueError(f"{file}: a payload does not match its digest")
                refers_to = page_of(head["warc-refers-to"]) if revisit else None
                row = (page_of(head["warc-record-id"]), head.get("warc-target-uri"), size, digest, head["warc-type"], refers_to)
                yield (*row, payload) if with_payload else row

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file in part.column("file").to_pylist():
                yield from batches(rows(file), schema)

    files = index.groupBy("file").agg(F.sum("length").alias("bytes"))
    # The rows are tiny, the files are not: one task per file, not one per megabyte of rows.
    count = max(1, files.count())
    spread = files.select("file").repartitionByRange(count, "file")
    names = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return spread.mapInArrow(work, names + (", payload binary" if with_payload else ""))
