from __future__ import annotations

import base64
import hashlib
import io
import struct

import pytest
import zstandard

from tidepanel.llm import files, warc
from tidepanel.llm.common import shared_folder

ROWS = [
    (1, "http://a/1", "<p>same é</p>", "x"), (7, "http://a/7", "<p>same é</p>", "x"), (3, None, "<p>same é</p>", "x"), (2, "http://b", None, "x"),
    (9, "http://c\r\nX: y z", "", "x"), (-4, "é", "own" * 40_000, "x"), (None, "u", "<p>same é</p>", "x"), (5, "u", "two\r\n\r\nparts\r\n\r\n", "x"),
    (5, "u", "two\r\n\r\nparts\r\n\r\n", "x"), (4, "u", "two\r\n\r\nparts\r\n\r\n", "x"), (2**62 + 5, "u", "big", "x"), (-(2**63), "u", "low", "x"),
]


def expected(rows, least=0):
    """Record type and reference by looking at all rows of a payload."""
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        peers = [p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None]
        keeper = max(peers, default=None)
        revisit = page is not None and len(data) >= least and page != keeper
        out.append((page, len(data), digest, "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string").repartition(3)


@pytest.mark.parametrize("least", [0, 14])
def test_archives_come_back(spark, least):
    index = warc.write_archives(pages(spark), min_payload=least)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = warc.read_archives(index, with_payload=True).collect()
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == expected(ROWS, least)
    payloads = {(r["page_id"], bytes(r["payload"]).decode()) for r in got if r["record_type"] == "response"}
    assert (-4, "own" * 40_000) in payloads and (2**62 + 5, "big") in payloads and (2, "") in payloads or least == 0
    assert {r["url"] for r in got if r["page_id"] == 9} == {"http://c%0D%0AX:%20y%20z"}
    assert index.groupBy("page_id").count().count() == 11


def test_empty_table_writes_nothing(spark):
    index = warc.write_archives(pages(spark).limit(0))
    assert index.count() == 0 and warc.read_archives(index).count() == 0


def test_single_records_are_read_by_their_place(spark):
    html = [f"<html><head><title>{k}</title></head><body><nav>menu of the site</nav><p>{k * 37}</p></body></html>" for k in range(300)]
    rows = [(k, f"http://h/{k}", h, "x") for k, h in enumerate(html)]
    index = warc.write_archives(pages(spark, rows).coalesce(1)).collect()
    for row in index[::29]:
        system, path = warc.opened(row["file"])
        with system.open_input_file(path) as source:
            dictionary, _ = warc.archive_dictionary(source)
            assert dictionary is not None
            fields, http, payload = warc.parse_record(warc.read_record(source, row["offset"], row["length"], dictionary))
        assert payload.decode() == html[row["page_id"]]
        assert warc.page_of(fields["warc-record-id"]) == row["page_id"]


def archive(records, train_bytes=1 << 20):
    sink = io.BytesIO()
    writer = warc.ArchiveWriter(sink, train_bytes)
    places = [p for r in records for p in writer.add(r)] + writer.flush()
    return sink.getvalue(), places


def records(count):
    return [
        warc.warc_record(k, f"http://h/{k}", f"<html><body><ul><li>menu</li></ul><p>{k ** 3} words</p></body></html>".encode(), "X", None)
        for k in range(count)
    ]


def test_a_leading_skippable_frame_holds_the_dictionary_and_records_stand_alone():
    data, places = archive(records(400), train_bytes=20_000)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    assert dictionary.dict_id()
    assert places[0][0] == 8 + size and len(places) == 400
    offset, length = places[123]
    assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(data[offset : offset + length]) == records(400)[123]
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(data[offset : offset + length])
    alone = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records(400))
    assert sum(n for _, n in places) < 0.6 * alone
    assert list(warc.read_records(io.BytesIO(data))) == records(400)


@pytest.mark.parametrize("count", [1, 3, 8])
def test_a_file_of_few_records_has_a_dictionary_too(count):
    given = records(count)
    data, places = archive(given)
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_MAGIC and places[0][0] == 8 + size
    source = io.BytesIO(data)
    assert list(warc.read_records(source)) == given
    dictionary, start = warc.archive_dictionary(source)
    assert start == 8 + size
    assert warc.read_record(source, *places[-1], dictionary) == given[-1]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_records(io.BytesIO(data[:-5])))


def test_records_that_training_refuses_and_one_long_record():
    alike = [b"x" * 2000] * 20
    long = [bytes(range(256)) * 20_000]
    for given in (alike, long, [b"short"]):
        data, _ = archive(given)
        assert data.startswith(struct.pack("<I", warc.DICTIONARY_MAGIC))
        assert list(warc.read_records(io.BytesIO(data))) == given
    assert archive([]) == (b"", [])


@pytest.mark.parametrize(
    ("uri", "known"),
    [
        ("s3a://bucket/a b/c", "s3://bucket/a b/c"), ("s3n://bucket/c", "s3://bucket/c"), ("file:/x/y", "file:///x/y"), ("file:///x/y", "file:///x/y"),
        ("wasbs://box@store.blob.core.windows.net/p/q", "abfss://box@store.dfs.core.windows.net/p/q"), ("hdfs://name:9/x", "hdfs://name:9/x"),
    ],
)
def test_stores_have_the_names_the_file_systems_know(uri, known):
    assert files.store_uri(uri) == known


def test_a_path_without_a_scheme_is_refused():
    with pytest.raises(ValueError, match="no file system"):
        files.opened("/x/y")


def test_shared_folders_state_their_file_system(spark):
    assert "://" in files.store_uri(shared_folder(spark, "t"))


@pytest.mark.parametrize("page", [0, 1, -1, 2**63 - 1, -(2**63), 2**62])
def test_record_ids_carry_the_page(page):
    assert warc.page_of(warc.record_id(page)) == page
    assert warc.page_of(warc.record_id(None, 77)) is None
    assert warc.record_id(None, 77) != warc.record_id(None, 78)
