from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidepanel.llm import alignment, wordbpe

LEFT = wordbpe.tokenizer_path(alignment.LEFT)
RIGHT = wordbpe.tokenizer_path(alignment.RIGHT)
LETTERS = [*"abETHorn  ,.\n\t1é中ß梦☃😀İΣς;!?'’\x0b\x85\xa0̸́=２ﬁ\r\x00"]
PARTS = [*LETTERS, "  ", "the", "ing", "<s>", "<0x0A>", "<|endoftext|>", "don't", "'S", "▁", "over ", "number ", "12", "schön"]


def texts(count: int, seed: int = 1, longest: int = 16) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, longest))) for _ in range(count)]


def brute(values):
    """Every column by the two libraries and a search over all pairs of tokens."""
    left = Tokenizer.from_file(LEFT)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    letters = {c: b for b, c in wordbpe.byte_letters().items()}

    def spans(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    rows, links = [], []
    for value in values:
        data = b" " + (value or "").encode()
        a = left.encode(" " + (value or ""), add_special_tokens=False).ids if value else []
        b = right.encode(value) if value else []
        a_bytes = [bytes(letters[c] for c in left.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(right.id_to_piece(i)[3:-1], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not a or b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        a_spans, b_spans = spans(a_bytes), spans(b_bytes)
        ends = sorted({e for _, e in a_spans} & {e for _, e in b_spans})
        parts = []
        for low, high in zip([0, *ends], ends, strict=False):
            inside = lambda ids, at: ",".join(str(i) for i, (s, e) in zip(ids, at, strict=True) if s >= low and e <= high)  # noqa: E731, B023
            parts.append(inside(a, a_spans) + "|" + inside(b, b_spans))
        links.append([(i, j) for i, (_, e) in zip(a, a_spans, strict=True) for j, (_, f) in zip(b, b_spans, strict=True) if e == f])
        rows.append((len(a), len(b), len(ends), hashlib.sha256(";".join(parts).encode()).hexdigest()))
    counts = Counter(link for found in links for link in found)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    sums = [(len(f), sum(counts[p] == best[p[1]] for p in f), sum(counts[p] for p in f)) for f in links]
    return [(r[0], r[1], r[2], *s, r[3]) for r, s in zip(rows, sums, strict=True)], counts


SPECIAL = [None, "", " ", "same text.", "same text.", "Ünïcödé <|endoftext|> 中文 😀", "a" * 300, "word " * 3000, "the number of the number"]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 3])
def test_columns_are_those_of_the_libraries(spark, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)  # with 3, nearly all pairs go through the join
    monkeypatch.setattr(alignment, "CHUNK", 500)
    values = texts(400) + SPECIAL
    ids = [None if k % 50 == 0 else k // 2 for k in range(len(values))]
    frame = spark.createDataFrame([(d, t, "x") for d, t in zip(ids, values, strict=True)], "doc_id bigint, text string, line string").repartition(6)
    found = alignment.alignment_digests(frame).collect()
    want, _ = brute(values)
    assert Counter(tuple(r) for r in found) == Counter((d, *w) for d, w in zip(ids, want, strict=True))
    assert alignment.alignment_digests(frame.limit(0)).count() == 0


def test_pair_counts_and_groups(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 20)  # tasks pass sums on early
    values = texts(150, seed=2) + SPECIAL
    frame = spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string").repartition(3)
    want, counts = brute(values)
    found = alignment.pair_counts(alignment.aligned(frame)).collect()
    assert Counter({(r["a"], r["b"]): r["n"] for r in found}) == counts
    assert len(found) == len(counts)
    groups: dict = {}
    for r in alignment.token_groups(frame).orderBy("doc_id", "place").collect():
        groups.setdefault(r["doc_id"], []).append(r)
    for k, w in enumerate(want):
        listed = ";".join(",".join(map(str, r["a"])) + "|" + ",".join(map(str, r["b"])) for r in groups.get(k, []))
        assert (hashlib.sha256(listed.encode()).hexdigest() if listed else "") == w[-1]
        if listed:
            assert groups[k][0]["start"] == 0 and groups[k][-1]["stop"] == len(values[k].encode()) + 1


def test_the_left_tokens_are_those_of_the_file_for_all_characters():
    library = Tokenizer.from_file(LEFT)
    library.encode_special_tokens = True
    pair = alignment.Aligner(LEFT, RIGHT)
    for c in [*range(0x3000), *range(0xD7A0, 0xD800), *range(0xE000, 0x11000, 7), *range(0x1F000, 0x1FA00, 3)]:
        text = f" a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}.{chr(c)}\n{chr(c)} "
        assert pair.left.encode_ordinary(text) == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_identity_map_has_the_same_bytes():
    pair = alignment.Aligner(LEFT, RIGHT)
    mapped = [(a, b) for a, b in enumerate(pair.identity.tolist()) if b >= 0]
    assert len(mapped) > 10_000
    assert all(pair.a_bytes[a] == pair.b_bytes[b] for a, b in mapped)


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError):
        alignment.byte_level_ranks(wordbpe.tokenizer_path("word_bpe_49k.json"))
