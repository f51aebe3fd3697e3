from __future__ import annotations

import io
import random
import zlib

import numpy as np
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

from tidepanel.llm import packing, pieces, tokencount, tokenfile, wordbpe

WORD = wordbpe.tokenizer_path(tokenfile.TOKENIZER)
PIECE = wordbpe.tokenizer_path(pieces.MODEL)
LETTERS = [*"abETHorn  ,.\n\t1é中ß梦☃😀▁İıΣσς;!?'’\x0b\x1c\x85\xa0̸́=２Ⅷŉﬁｱ\r\x00Ⱥ"]
PARTS = [*LETTERS, "  ", "the", "ing", "<s>", "<0x0A>", "; \r", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "'S", "...", ".,", "?."]


def texts(count: int, longest: int = 14, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, longest))) for _ in range(count)]


def frame(spark, values):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(values)], "doc_id bigint, text string, n_tokens string")


SPECIAL = [None, "", " ", "word " * 3000, "same text.", "same text.", "Ünïcödé <|endoftext|> 中文 😀", "a" * 300]


def test_words_give_the_ids_of_the_library():
    library = Tokenizer.from_file(WORD)
    ours = wordbpe.WordIds(WORD, limit=50)  # a small cache: both generations turn over
    for text in texts(6000) + [t or "" for t in SPECIAL]:
        assert np.frombuffer(ours.text(text), ours.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_files_that_look_across_words_are_refused():
    with pytest.raises(ValueError):
        wordbpe.WordIds(wordbpe.tokenizer_path("byte_bpe_50k.json"))


def test_pieces_are_those_of_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    ours = pieces.PieceModel(PIECE, limit=50)
    for text in texts(6000) + [" " * k for k in range(40)] + [t or "" for t in SPECIAL]:
        ids = memoryview(ours.encode(text)).cast("i").tolist()
        assert ids == library.encode(text), text
        assert ours.decode(ids) == library.decode(ids)
    rng = random.Random(4)
    for _ in range(4000):
        ids = [rng.choice([rng.randint(0, 258), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 6))]
        assert ours.decode(ids) == library.decode(ids), ids


def test_piece_columns(spark):
    import hashlib

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r["doc_id"]: r for r in pieces.round_trip_digests(frame(spark, SPECIAL)).collect()}
    for k, text in enumerate(SPECIAL):
        ids = library.encode(text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == want
    back = pieces.decoded(pieces.encoded(frame(spark, SPECIAL))).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {k: t or "" for k, t in enumerate(SPECIAL)}
    assert pieces.round_trip_digests(frame(spark, SPECIAL).limit(0)).count() == 0


def test_counts(spark):
    library = Tokenizer.from_file(WORD)
    values = SPECIAL + texts(200, 60)
    got = {r["doc_id"]: r for r in tokencount.token_counts(frame(spark, values)).collect()}
    for k, text in enumerate(values):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((text or "").encode()), n, n > 2048)
    assert tokencount.token_counts(frame(spark, values).limit(0)).count() == 0


def test_null_and_repeated_ids_keep_their_rows(spark):
    """Pieces and counts are made row by row: no row is lost, merged or given another row's values."""
    rows = [(None, "no id", "x"), (None, None, "x"), (7, "same text.", "x"), (7, "same text.", "x"), (7, "other text", "x"), (8, None, "x")]
    given = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    piece, word = sentencepiece.SentencePieceProcessor(model_file=PIECE), Tokenizer.from_file(WORD)

    def ordered(values):
        return sorted(values, key=repr)

    counted = tokencount.token_counts(given).select("doc_id", "n_bytes", "n_tokens").collect()
    assert ordered(map(tuple, counted)) == ordered(
        (doc, len((text or "").encode()), len(word.encode(text or "", add_special_tokens=False).ids)) for doc, text, _ in rows
    )
    ids = pieces.encoded(given).collect()
    assert ordered((r["doc_id"], r["ids"]) for r in ids) == ordered((doc, piece.encode(text or "")) for doc, text, _ in rows)
    digests = pieces.round_trip_digests(given).collect()
    assert ordered((r["doc_id"], r["n_tokens"]) for r in digests) == ordered((doc, len(piece.encode(text or ""))) for doc, text, _ in rows)


def test_tier_one_does_not_decide_the_counts(spark):
    table = tokencount.TwoTier(WORD, b"the\nof", bytes([1, 1]))
    assert table.count("the of harbour, the") == len(Tokenizer.from_file(WORD).encode("the of harbour, the").ids)
    assert len(table) == 2
    found = tokencount.frequent_words(frame(spark, ["the cat the cat", "the dog"]).select("text"), WORD)
    assert b"the" in found[0].split(b"\n")


def test_token_files(spark):
    library = Tokenizer.from_file(WORD)
    values = SPECIAL + texts(100, 40)
    rows = [(len(values) - k, t, "x") for k, t in enumerate(values)] + [(None, "no id", "x"), (3, "again", "x")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, start string").repartition(7)
    files = tokenfile.write_token_files(documents)
    got = tokenfile.read_token_digests(files).collect()
    assert len(got) == len(rows)
    at = 0
    for row in sorted(got, key=lambda r: r["start"]):
        assert row["start"] == at
        at += row["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    want = sorted((d or -1, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t, _ in rows)
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in got) == want
    some = tokenfile.read_token_files(files, wanted=[5, 9]).collect()
    assert {r["doc_id"] for r in some} == {5, 9} and all(len(r["ids"]) == 4 * r["n_tokens"] for r in some)
    assert tokenfile.read_token_digests(tokenfile.write_token_files(documents.limit(0))).count() == 0


class Watched(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.taken = 0

    def read(self, size=-1):
        out = super().read(size)
        self.taken += len(out)
        return out


def test_readers_take_only_the_frames_they_need_and_check_them():
    sink = io.BytesIO()
    writer = tokenfile.FrameWriter(sink, 2)
    rng = np.random.default_rng(0)
    data = {k: rng.integers(0, 60000, 5000).astype("<u2") for k in range(50)}
    for k, ids in data.items():
        writer.add(k, ids.tobytes())
    writer.close()
    blob = sink.getvalue()
    source = Watched(blob)
    reader = tokenfile.FrameReader(source)
    head = source.taken
    ((doc, before, ids),) = reader.documents([17])
    assert (doc, before) == (17, 17 * 5000) and (ids == data[17]).all()
    assert source.taken - head < len(blob) / 25
    # Plain readers see the frames in a row; the seek table is skipped.
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(blob), read_across_frames=True).read()
    assert plain.startswith(b"".join(d.tobytes() for d in data.values()))
    # A seek table whose checksum of frame 3 says otherwise.
    entry = len(blob) - 9 - 12 * 51 + 12 * 3 + 8
    broken = bytearray(blob)
    broken[entry] ^= 1
    with pytest.raises(ValueError, match="frame 3"):
        list(tokenfile.FrameReader(io.BytesIO(bytes(broken))).documents([3]))
    with pytest.raises(ValueError):
        tokenfile.FrameReader(io.BytesIO(blob + b"\0"))


def test_fullest_is_the_best_subset_sum():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        rest = rng.randint(0, 60)
        sums = {0}
        for length, copies in counts.items():
            sums = {s + length * c for s in sums for c in range(copies + 1)}
        best = max(s for s in sums if s <= rest)
        chosen = packing.fullest(rest, counts)
        assert sum(n * c for n, c in chosen.items()) == best
        assert all(c <= counts[n] for n, c in chosen.items())


def test_plan_uses_everything_once_and_is_close_to_the_bound():
    rng = random.Random(7)
    counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, 4097), 600)}
    steps = packing.plan(counts)
    used: dict = {}
    for bin_, times in steps:
        assert sum(n * c for n, c in bin_.items()) <= 4096
        for n, c in bin_.items():
            used[n] = used.get(n, 0) + c * times
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    assert sum(t for _, t in steps) <= -(-total // 4096) * 1.02 + 1
    assert packing.plan({}) == []


def test_packing(spark):
    library = Tokenizer.from_file(WORD)
    values = SPECIAL + ["word " * 4095, "word " * 4096, "word " * 9000] + texts(300, 60) + ["same"] * 500
    documents = frame(spark, values).repartition(5)
    rows = packing.packed(documents, with_ids=True).collect()
    joined: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == len(joined.setdefault(r["doc_id"], [])) and r["length"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(r["ids"])
        assert r["piece"] * 4096 == r["start"]
        joined[r["doc_id"]] += ids
    assert joined == {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(values)}
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(map(len, joined.values()))
    assert len(bins) <= -(-total // 4096) + 1
    assert packing.packed(documents.limit(0)).count() == 0
