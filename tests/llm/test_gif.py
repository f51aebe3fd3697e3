from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepanel.llm import gif


def plain_decode(stream: bytes, size: int, pixels: int) -> list[int]:
    """Code by code, with a table of strings."""
    clear, end = 1 << size, (1 << size) + 1
    bits = int.from_bytes(stream, "little")
    at, width = 0, size + 1
    table: list[bytes] = []
    out = bytearray()
    last = b""
    while at + width <= 8 * len(stream) and len(out) < pixels:
        code = bits >> at & (1 << width) - 1
        at += width
        if code == end:
            break
        if code == clear:
            table, width, last = [bytes([k]) for k in range(clear)] + [b"", b""], size + 1, b""
            continue
        if not table:
            table = [bytes([k]) for k in range(clear)] + [b"", b""]
        entry = table[code] if code < len(table) else last + last[:1]
        if last and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        out += entry
        last = entry
    return list(out[:pixels]) + [0] * (pixels - len(out))


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=600), st.integers(1, 60))
def test_codes_come_back(data, times):
    data = data * times
    stream = gif.lzw_encode(data)
    assert plain_decode(stream, 8, len(data)) == list(data)
    assert gif.lzw_decode(stream, 8, len(data)).tobytes() == data


@pytest.mark.parametrize("kind", ["random", "zeros", "text"])
def test_long_streams_with_full_tables(kind):
    rng = np.random.default_rng(5)
    data = {
        "random": rng.integers(0, 256, 60_000).astype(np.uint8).tobytes(),
        "zeros": bytes(60_000),
        "text": b" ".join(rng.choice([b"the", b"of", b"anread", b"thst"], 15_000)),
    }[kind]
    stream = gif.lzw_encode(data)
    assert gif.lzw_decode(stream, 8, len(data)).tobytes() == data
    assert gif.lzw_decode(stream[: len(stream) // 2], 8, len(data)).tolist() == plain_decode(stream[: len(stream) // 2], 8, len(data))


def never_clearing(data: bytes, size: int) -> bytes:
    """A writer that keeps a full table for the rest of the stream."""
    clear, end = 1 << size, (1 << size) + 1
    table = {bytes([k]): k for k in range(clear)}
    codes, new, current = [(clear, size + 1)], end + 1, b""
    seen = 0

    def width() -> int:
        return min(12, max(size + 1, (end + 1 + max(0, seen - 1)).bit_length()))

    for value in data:
        longer = current + bytes([value])
        if longer in table:
            current = longer
            continue
        codes.append((table[current], width()))
        seen += 1
        if new < 4096:
            table[longer] = new
            new += 1
        current = bytes([value])
    codes.append((table[current], width()))
    seen += 1
    codes.append((end, width()))
    bits, at = 0, 0
    for code, w in codes:
        bits |= code << at
        at += w
    return bits.to_bytes(at + 7 >> 3, "little")


@pytest.mark.parametrize("size", [2, 4, 8])
def test_other_writers(size):
    rng = np.random.default_rng(size)
    data = rng.integers(0, 1 << size, 40_000).astype(np.uint8).tobytes()
    assert gif.lzw_decode(never_clearing(data, size), size, len(data)).tobytes() == data


def test_payload_comes_back_over_several_frames():
    payload = np.random.default_rng(1).integers(0, 256, 192 * 600).astype(np.uint8).tobytes()
    width, height, frames = gif.read_gif(gif.gif_from_bytes(payload))
    assert (width, height, [f.height for f in frames]) == (192, 256, [256, 256, 88])
    assert b"".join(f.indices.tobytes() for f in frames) == payload
    counted = sum(gif.histogram(c) for c in gif.composed(width, height, frames))
    assert counted.sum() == len(payload)
    colours = gif.palette()[np.frombuffer(payload, np.uint8)] >> 6
    assert counted.tolist() == np.bincount(colours @ np.array([16, 4, 1], np.uint8), minlength=64).tolist()


def picture(left, top, width, height, indices, disposal, transparent=None, delay=5, interlaced=False, colours=None):
    control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
    flags = 0x40 * interlaced | (0x80 | 1 if colours else 0)
    head = struct.pack("<BHHHHB", 0x2C, left, top, width, height, flags)
    return control + head + bytes(colours or b"") + b"\x08" + gif._blocks(gif.lzw_encode(bytes(indices)))


def animation(width, height, *pictures):
    colours = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    comment = b"\x21\xfe\x03abc\x00"
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, 0, 0) + colours + comment + b"".join(pictures) + b";"


def test_disposal_transparency_interlace_and_local_colours():
    data = animation(
        2, 2,
        picture(0, 0, 2, 2, [1, 1, 1, 1], 1),
        picture(0, 0, 2, 1, [2, 3], 3, transparent=3),  # second pixel stays red, then all comes back
        picture(1, 1, 1, 1, [3], 2),  # cleared after it was shown
        picture(1, 0, 5, 5, [2] * 25, 0),  # reaches over the edge
        picture(0, 0, 1, 2, [0, 1], 0, colours=[9, 9, 9, 200, 100, 0, 0, 0, 0, 0, 0, 0], interlaced=True),
    )
    width, height, frames = gif.read_gif(data)
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    shown = [[tuple(int(v) for v in p) for p in c.reshape(-1, 4)] for c in gif.composed(width, height, frames)]
    assert shown[0] == [red] * 4
    assert shown[1] == [green, red, red, red]
    assert shown[2] == [red, red, red, blue]
    assert shown[3] == [red, green, red, green]
    assert shown[4] == [(9, 9, 9, 255), green, (200, 100, 0, 255), green]
    assert none not in shown[3]
    rows = gif._rows_in_order(np.arange(10), True)
    assert rows.tolist() == [0, 5, 3, 6, 2, 7, 4, 8, 1, 9]


def test_columns_with_nulls_broken_media_and_clashing_names(spark):
    texts = [(1, None, "a"), (2, "", None), (3, "é" * 100, "b"), (3, "é" * 100, "b"), (None, "word " * 30_000, "c")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string, media string")
    got = gif.text_media_features(frame).collect()
    assert len(got) == 5
    for row in got:
        text = next(t for d, t, _ in texts if d == row["doc_id"]) or ""
        data = text.encode()
        padded = data + b" " * (-len(data) % 192 if data else 192)
        assert row["n_bytes"] == len(data)
        assert row["payload_bytes"] == len(padded)
        assert row["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(padded[-16:])
    assert len({tuple(r) for r in got if r["doc_id"] == 3}) == 1
    assert gif.text_media_features(frame.limit(0)).count() == 0
    media = spark.createDataFrame(
        [(1, bytearray(animation(2, 2, picture(0, 0, 2, 2, [1, 1, 2, 2], 1), picture(0, 0, 1, 1, [3], 1)))), (2, None), (3, bytearray(b"no"))],
        "doc_id bigint, media binary",
    )
    rows = gif.media_frames(media, with_pixels=True).orderBy("frame").collect()
    assert [(r["doc_id"], r["frame"], r["start_ms"], r["delay_ms"], sum(r["histogram"]), len(r["pixels"])) for r in rows] == [
        (1, 0, 0, 50, 4, 16), (1, 1, 50, 50, 4, 16),
    ]
