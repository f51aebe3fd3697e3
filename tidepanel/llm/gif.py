"""GIF columns: bytes to GIF and back, timed frames and colour histograms.

The decoder reads whole LZW code streams with array operations.  Between two clear codes the width
of the n-th code depends on n alone, so all codes of such a segment are taken out at
once; a code's string is a stretch of the output before it, so lengths and bytes follow by
chasing references in a few rounds instead of code by code.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import batches, picked, stored, utf8

WIDTH = 192
ROWS = 256
DELAY = 10  # hundredths of a second
PAD = 192
BINS = 64
FULL = 4096


def palette() -> np.ndarray:
    """256 different colours: three bits of red, three of green, two of blue."""
    index = np.arange(256)
    return np.stack([(index >> 5) * 36, (index >> 2 & 7) * 36, (index & 3) * 85], axis=1).astype(np.uint8)


def code_widths(size: int, count: int) -> np.ndarray:
    """Bits of the n-th code after a clear code, for a minimum code size."""
    known = (1 << size) + 2 + np.maximum(np.arange(count) - 1, 0)
    return np.minimum(np.floor(np.log2(known)).astype(np.int64) + 1, 12)


# ---- writing ----------------------------------------------------------------------------


def lzw_encode(pixels: bytes, size: int = 8) -> bytes:
    """The code stream of 8-bit pixels: a clear code first, again whenever the table is full, an end code."""
    clear, end = 1 << size, (1 << size) + 1
    segments: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    new = end + 1
    known = table.get
    current = -1
    for value in pixels:
        if current < 0:
            current = value
            continue
        key = current << 8 | value
        longer = known(key)
        if longer is not None:
            current = longer
            continue
        codes.append(current)
        current = value
        table[key] = new
        new += 1
        if new == FULL:
            codes.append(clear)
            segments.append(codes)
            codes, new = [], end + 1
            table = {}
            known = table.get
    if current >= 0:
        codes.append(current)
    segments.append([*codes, end])
    values = np.concatenate([[clear], *segments]).astype(np.int64)
    # The first clear code has the width of a first code, each segment counts anew.
    width = code_widths(size, FULL)
    bits = np.concatenate([width[:1], *(width[: len(s)] for s in segments)])
    return _join_bits(values, bits)


def _join_bits(values: np.ndarray, bits: np.ndarray) -> bytes:
    ends = np.cumsum(bits)
    place = ends - bits
    spread = values << (place & 7)
    size = int(ends[-1] + 7 >> 3)
    out = np.zeros(size + 3)
    for byte in range(3):
        out += np.bincount((place >> 3) + byte, spread >> 8 * byte & 255, size + 3)
    return out[:size].astype(np.uint8).tobytes()


def _blocks(data: bytes) -> bytes:
    whole = len(data) // 255
    body = np.empty((whole, 256), dtype=np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def gif_from_bytes(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """An animation whose colour indices are the payload, row by row and frame by frame.

    The payload must fill whole rows.  Each frame is cleared before the next, so what is shown
    at any time is one stretch of the payload.
    """
    if not payload or len(payload) % width:
        raise ValueError(f"the payload must be a positive multiple of {width} bytes")
    height = min(rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette().tobytes()]
    for start in range(0, len(payload), width * rows):
        pixels = payload[start : start + width * rows]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 2 << 2, delay, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(pixels) // width, 0))
        out.append(b"\x08" + _blocks(lzw_encode(pixels)))
    return b"".join([*out, b"\x3b"])


# ---- reading ----------------------------------------------------------------------------


def _codes(data: np.ndarray, start: int, bits: np.ndarray, ends: np.ndarray, total: int) -> np.ndarray:
    """As many codes as fit between bit ``start`` and bit ``total``, with the given widths."""
    count = int(np.searchsorted(ends, total - start, side="right"))
    place = start + ends[:count] - bits[:count]
    byte = place >> 3
    raw = data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16
    return raw >> (place & 7) & (1 << bits[:count]) - 1


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The pixels of one segment's codes; stops before a code that cannot exist yet."""
    first = clear + 2
    refers = codes >= first
    target = np.where(refers, codes - first, 0)
    known = np.minimum(np.arange(len(codes)), FULL - first)  # entries defined before each code, the one in the making included
    wrong = np.flatnonzero(refers & (target >= known) | (codes == clear) | (codes == clear + 1))
    if len(wrong):
        codes, refers, target = codes[: wrong[0]], refers[: wrong[0]], target[: wrong[0]]
    if not len(codes):
        return np.zeros(0, dtype=np.uint8)
    # A reference is one longer than the code it extends: count the steps of the chain.
    length = np.ones(len(codes), dtype=np.int64)
    chain = np.where(refers, target, -1)
    going = chain >= 0
    jump = np.where(going, chain, np.arange(len(codes)))
    steps = going.astype(np.int64)
    while True:
        more = steps[jump]
        if not more.any():
            break
        steps, jump = steps + more, jump[jump]
    length += steps
    ends = np.cumsum(length)
    starts = ends - length
    total = int(ends[-1])
    # Every output byte of a reference copies an earlier byte; chase copies back to a literal.
    source = np.arange(total)
    shift = np.where(refers, starts - starts[target], 0)
    source -= np.repeat(shift, length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    literal = np.zeros(total, dtype=np.uint8)
    literal[starts[~refers]] = codes[~refers]
    return literal[source]


def lzw_decode(stream: bytes, size: int, pixels: int) -> np.ndarray:
    """Colour indices of a code stream; a stream that ends early is filled with zeros."""
    clear = 1 << size
    data = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8)
    total = 8 * len(stream)
    bits = code_widths(size, FULL)
    out: list[np.ndarray] = []
    have, place = 0, 0
    while have < pixels and place + size + 1 <= total:
        widths = bits
        while True:
            ends = np.cumsum(widths)
            codes = _codes(data, place, widths, ends, total)
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
            # A full table may go on at twelve bits for as long as the writer likes.
            if len(stops) or len(codes) < len(widths):
                break
            widths = np.concatenate([widths, np.full(len(widths), 12)])
        stop = int(stops[0]) if len(stops) else len(codes)
        if stop:
            out.append(_expand(codes[:stop], clear))
            have += len(out[-1])
        if not len(stops) or codes[stop] == clear + 1:
            break
        place += int(ends[stop])
    found = np.concatenate([*out, np.zeros(max(0, pixels - have), dtype=np.uint8)]) if out else np.zeros(pixels, np.uint8)
    return found[:pixels]


@dataclass
class Frame:
    """One picture of the stream: its place, time, rule for what follows and colour indices."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    colours: np.ndarray
    indices: np.ndarray


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(data) and data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def _rows_in_order(indices: np.ndarray, interlaced: bool) -> np.ndarray:
    if not interlaced:
        return indices
    height = len(indices)
    order = [*range(0, height, 8), *range(4, height, 8), *range(2, height, 4), *range(1, height, 2)]
    out = np.empty_like(indices)
    out[order] = indices
    return out


def read_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames.  What is cut off in the middle counts as far as it goes."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at = 13

    def colours(flags_: int, at_: int) -> tuple[np.ndarray, int]:
        count = 2 << (flags_ & 7)
        table = np.zeros((256, 3), dtype=np.uint8)
        got = np.frombuffer(data[at_ : at_ + 3 * count], np.uint8)
        table[: len(got) // 3] = got[: len(got) // 3 * 3].reshape(-1, 3)
        return table, at_ + 3 * count

    shared = np.zeros((256, 3), dtype=np.uint8)
    if flags & 0x80:
        shared, at = colours(flags, at)
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            block, after = _read_blocks(data, at + 2)
            if data[at + 1 : at + 2] == b"\xf9" and len(block) >= 4:
                packed, wait, clear_index = struct.unpack_from("<BHB", block)
                delay, disposal, transparent = 10 * wait, packed >> 2 & 7, clear_index if packed & 1 else None
            at = after
        elif data[at] == 0x2C and at + 11 <= len(data):
            left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
            table, at = colours(own, at + 10) if own & 0x80 else (shared, at + 10)
            size = data[at] if at < len(data) else 8
            stream, at = _read_blocks(data, at + 1)
            indices = lzw_decode(stream, min(max(size, 1), 8), w * h).reshape(h, w)
            frames.append(Frame(left, top, w, h, delay, disposal, transparent, table, _rows_in_order(indices, bool(own & 0x40))))
            delay, disposal, transparent = 0, 0, None
        else:
            break
    return width, height, frames


def composed(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The canvas (height, width, RGBA) as each frame shows it.

    Transparent pixels leave the canvas as it is; parts of a frame outside it are not seen.
    After a frame the canvas stays (0, 1), its area is cleared (2) or what was there before comes back (3).
    """
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    for frame in frames:
        before = canvas.copy() if frame.disposal == 3 else None
        area = canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width]
        indices = frame.indices[: area.shape[0], : area.shape[1]]
        drawn = np.concatenate([frame.colours[indices], np.full((*indices.shape, 1), 255, np.uint8)], axis=2)
        if frame.transparent is None:
            area[:] = drawn
        else:
            seen = indices != frame.transparent
            area[seen] = drawn[seen]
        yield canvas
        if frame.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Visible pixels by colour: four steps each of red, green and blue, 64 counts."""
    step = canvas[..., :3] >> 6
    bins = (step[..., 0].astype(np.int64) << 4 | step[..., 1] << 2 | step[..., 2])[canvas[..., 3] > 0]
    return np.bincount(bins, minlength=BINS)


# ---- columns ----------------------------------------------------------------------------


def text_media(documents: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, media: the whole text's UTF-8 bytes as a GIF, padded with spaces to full rows.

    Null and empty texts are one row of spaces.  Repeated rows and ids stay as they are.
    """
    given = picked(documents, doc_id=id, text=text)
    given = given.select("doc_id", utf8(F.col("text")).alias("text"))

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        for doc, value in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
            data = value.as_buffer().to_pybytes()
            yield doc, len(data), gif_from_bytes(data + b" " * (-len(data) % width if data else width), width)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            schema = pa.schema([("doc_id", part.schema.field("doc_id").type), ("n_bytes", pa.int64()), ("media", pa.binary())])
            yield from batches(rows(part), schema)

    return given.mapInArrow(work, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def media_frames(media: DataFrame, id: str = "doc_id", column: str = "media", with_pixels: bool = False) -> DataFrame:
    """One row per frame: doc_id, frame, start_ms, delay_ms, left, top, width, height, histogram (and RGBA pixels).

    ``histogram`` counts the visible pixels of the composed canvas in 64 colours.  Null media and
    media that are no GIF have no rows.
    """
    given = picked(media, doc_id=id, media=column)

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        for doc, value in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist(), strict=True):
            try:
                width, height, frames = read_gif(value or b"")
            except ValueError:
                continue
            start = 0
            for number, (frame, canvas) in enumerate(zip(frames, composed(width, height, frames), strict=True)):
                row = (doc, number, start, frame.delay_ms, frame.left, frame.top, frame.width, frame.height, histogram(canvas).tolist())
                yield (*row, canvas.tobytes()) if with_pixels else row
                start += frame.delay_ms

    names = ["frame", "start_ms", "delay_ms", "left", "top", "width", "height"]

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fields = [("doc_id", part.schema.field("doc_id").type), *((n, pa.int64()) for n in names), ("histogram", pa.list_(pa.int64()))]
            yield from batches(rows(part), pa.schema(fields + [("pixels", pa.binary())] * with_pixels), size=512)

    kind = given.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{n} bigint' for n in names)}, histogram array<bigint>"
    return given.mapInArrow(work, schema + (", pixels binary" if with_pixels else ""))


def media_digests(media: DataFrame) -> DataFrame:
    """What the stored GIFs hold: payload and media sizes and digests, and a feature of the frames.

    The payload is the colour indices of all frames in a row.  feature: frames, duration and the
    colours seen over all frames (bin:count, empty bins left out).
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        columns = (part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))
        for doc, count, value in zip(*columns, strict=True):
            width, height, frames = read_gif(value)
            payload = b"".join(f.indices.tobytes() for f in frames)
            colours = sum((histogram(canvas) for canvas in composed(width, height, frames)), np.zeros(BINS, np.int64))
            shown = ",".join(f"{k}:{colours[k]}" for k in np.flatnonzero(colours))
            yield (
                doc, count, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(value),
                hashlib.sha256(value).hexdigest(), f"{len(frames)} frames,{sum(f.delay_ms for f in frames)} ms,{shown}",
            )

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            text, number = pa.string(), pa.int64()
            kinds = [part.schema.field("doc_id").type, number, number, text, number, number, text, text]
            yield from batches(rows(part), pa.schema(list(zip(names, kinds, strict=True))))

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(work, schema)


def text_media_features(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts stored as GIFs in the shared folder, then read back and described, one row per document.

    An empty table gives no rows; other columns are ignored; equal texts have equal values.
    """
    return media_digests(stored(text_media(documents, id, text), "media"))
