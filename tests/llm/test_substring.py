from __future__ import annotations

import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import substring

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def plain_repeats(rows: list[tuple], min_words: int, unit: str = "line") -> set:
    """Occurrences to remove by looking at every unit in rank order."""
    seen = defaultdict(set)
    for doc, text in rows:
        at = 0
        for line in (text or "").split("\n" if unit == "line" else "\n\n"):
            plain = " ".join(line.casefold().split())
            if plain and len(plain.split(" ")) >= min_words:
                seen[plain].add((doc is None, doc if doc is not None else 0, at, at + len(line)))
            at += len(line) + (1 if unit == "line" else 2)
    out = set()
    for places in seen.values():
        first, *others = sorted(places)
        out |= {(None if gone else doc, start, end, None if first[0] else first[1], first[2]) for gone, doc, start, end in others}
    return out


ROWS = [
    (5, f"head\n{LONG}\ntail words"), (2, f"{LONG.upper()}\nother"), (9, f"  {LONG.replace(' ', '   ')} \n{LONG}"), (9, None),
    (7, ""), (None, f"x\n{LONG}"), (11, f"é{LONG}\né{LONG}\n"), (12, "short\nshort"), (13, LONG), (13, LONG), (14, f"a\n\n{LONG}\n\nb"),
]


@pytest.mark.parametrize("min_words", [1, 20])
def test_all_but_the_first_occurrence(spark, min_words):
    frame = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id bigint, text string, start string")
    got = substring.repeated_units(frame, min_words=min_words).select("doc_id", "start", "end", "kept_doc_id", "kept_start")
    assert {tuple(r) for r in got.collect()} == plain_repeats(ROWS, min_words)
    assert substring.repeated_units(frame.limit(0)).count() == 0


def test_paragraphs(spark):
    rows = [(1, "a b\nc\n\nd e f"), (2, "d e  F\n\nnew one"), (3, "a\nb c\n\nx")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substring.repeated_units(frame, unit="paragraph", min_words=3).collect()
    assert {(r["doc_id"], r["start"], r["end"], r["kept_doc_id"], r["kept_start"]) for r in got} == {(2, 0, 6, 1, 7), (3, 0, 5, 1, 0)}


@pytest.mark.parametrize(
    "text,spans,want",
    [
        ("a\nb\nc", [(2, 3)], "a\nc"), ("a\nb\nc", [(0, 1)], "b\nc"), ("a\nb\nc", [(4, 5)], "a\nb"), ("a\nb\nc", [(0, 1), (2, 3), (4, 5)], ""),
        ("a\nb\n", [(2, 3)], "a\n"), ("a", [(0, 1)], ""), ("a\nb\nc", [(2, 3), (4, 5)], "a"), ("a\n\nb", [], "a\n\nb"),
    ],
)
def test_cut(text, spans, want):
    assert substring.cut(text, spans) == want


def test_texts_without_repeats_keep_columns_and_offsets(spark):
    frame = spark.createDataFrame([(r[1], "x", r[0]) for r in ROWS], "text string, spans string, doc_id bigint")
    out = substring.without_repeats(frame, min_words=20)
    assert out.columns == ["text", "spans", "doc_id", "removed_spans"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["text"] == ROWS[1][1] and by_id[2]["removed_spans"] == []
    assert by_id[5]["text"] == "head\ntail words"
    assert [(s["start"], s["end"], s["kept_doc_id"]) for s in by_id[5]["removed_spans"]] == [(5, 5 + len(LONG), 2)]
    assert by_id[None]["text"] == "x"
    assert [r["text"] for r in rows if r["doc_id"] == 13] == ["", ""]
    assert {r["text"] for r in rows if r["doc_id"] == 9} == {None, ""} or {r["text"] for r in rows if r["doc_id"] == 9} == {None, ""}


def test_stage_drops_what_is_left_without_words(spark):
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in ROWS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.substring_dedup(spark, frame, "")
    assert out.columns == frame.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert 13 not in rows and 7 in rows
    assert rows[5]["n_chars"] == len(rows[5]["text"])
    assert out.where(F.col("text").contains(LONG)).count() == 1  # the accented variant of document 11


def plain_passages(rows: list[tuple], size: int) -> dict[tuple, set[int]]:
    """Places of the words to remove in each text, by looking at every window of ``size`` words in rank order."""
    seen = defaultdict(list)
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        words = (text or "").casefold().split()
        for k in range(len(words) - size + 1):
            seen[tuple(words[k : k + size])].append((doc, text, k))
    gone = defaultdict(set)
    for (doc, text, first), *others in seen.values():
        for d, t, k in others:
            if (d, t) != (doc, text) or k >= first + size:
                gone[d, t] |= set(range(k, k + size))
    return dict(gone)


def words_in(text: str, spans: list[tuple[int, int]]) -> set[int]:
    return {k for k, m in enumerate(re.finditer(r"\S+", text)) if any(s <= m.start() and m.end() <= e for s, e in spans)}


def passage_rows() -> list[tuple]:
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choices([f"w{k}" for k in range(900)], k=n))
    inside, wrapped, early = make(70), make(60).split(), make(50)
    rows = [(k, f"{make(30)} {inside} {make(25)}\n{make(40)}") for k in range(4)]  # from mid-line to mid-line
    rows += [(10 + k, f"{make(9)}\n" + "\n".join(" ".join(wrapped[i : i + 5 + k]) for i in range(0, 60, 5 + k))) for k in range(3)]  # short lines
    rows += [(20, f"{make(5)} {early.upper()}"), (21, f"{early}  {make(3)}"), (22, " ".join(early.split()[:49]) + f" {make(9)}")]
    rows += [(30, "again " * 400), (31, make(55)), (31, make(55)), (None, f"{make(3)} {inside}"), (None, f"é{make(8)}\n{inside}"), (40, None), (41, "")]
    rows += [(50 + k, f"{inside[:200]} {make(20)} {' '.join(wrapped)}") for k in range(3)] + [(60, f"{inside} {make(4)} {inside}")] * 2
    return rows


def test_passages_go_wherever_they_begin_and_end(spark):
    rows = passage_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = plain_passages(rows, 50)
    out = [(r["doc_id"], r["text"], r["removed_spans"]) for r in substring.without_repeats(frame, min_words=10**6).collect()]
    assert len(out) == len(rows)
    by_id = {d: t for d, t in rows}
    spans = defaultdict(list)
    for r in substring.repeated_units(frame, min_words=10**6).where("doc_id IS NOT NULL AND doc_id <> 31").collect():
        text, first = by_id[r["doc_id"]], by_id[r["kept_doc_id"]][r["kept_start"] :]
        words = text[r["start"] : r["end"]].casefold().split()
        assert len(words) == r["n_words"] >= 50 and first.casefold().split()[: len(words)] == words and r["copies"] > 1
        spans[r["doc_id"], text].append((r["start"], r["end"]))
    got = {key: words_in(key[1], found) for key, found in spans.items()}
    assert got == {key: gone for key, gone in want.items() if key[0] is not None and key[0] != 31}
    left = lambda key: [w for k, w in enumerate((key[1] or "").split()) if k not in want.get(key, ())]
    assert sorted(((d, (t or "").split()) for d, t, _ in out), key=str) == sorted(((r[0], left(r)) for r in rows), key=str)
    assert substring.repeated_passages(frame.limit(0)).count() == 0


@pytest.mark.parametrize("size", [50, 51, 7])
def test_every_repeated_window_has_its_anchor_chosen_twice(size):
    words = " ".join(t for _, t in passage_rows() if t).split()
    runs, least = substring.anchors(substring.word_hashes(words), size)
    assert len(least) == len(words) - size + 1
    half = (size + 1) // 2
    assert all(least[k] == min(runs[k : k + size - half + 1]) for k in range(len(least)))


@pytest.mark.parametrize(
    "text,spans,want",
    [
        ("a b c d", [(2, 5)], "a d"), ("a b\nc d", [(2, 3)], "a \nc d"), ("a b\nc d", [(2, 5)], "a d"), ("a b c", [(2, 5)], "a "),
        ("a b\nc", [(0, 1), (2, 3)], "c"), ("a b c d", [(0, 3), (2, 5)], "d"), ("a b c d", [(0, 7), (2, 3)], ""),
    ],
)
def test_cut_inside_lines(text, spans, want):
    assert substring.cut(text, spans) == want


def test_stage_removes_a_passage_inside_lines(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"one two {passage} three"), (2, f"four {passage} five\nsix")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.substring_dedup(spark, frame, "").collect()} == {1: rows[0][1], 2: "four five\nsix"}


def test_only_texts_with_a_repeated_window_are_moved(spark, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, " ".join(f"w{k}_{j}" for j in range(80))) for k in range(200)] + [(300, f"a {passage}"), (301, f"b c {passage} d")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    moved = {"possible": [], "marked_possible": []}
    for name, seen in moved.items():
        real = getattr(substring, name)
        monkeypatch.setattr(substring, name, lambda *args, real=real, seen=seen: seen.append(real(*args)) or seen[-1])
    out = {r["doc_id"]: r["text"] for r in substring.without_repeats(frame).collect()}
    assert out == dict(rows) | {301: "b c d"}
    (asked,), (marked,) = moved.values()
    assert asked.count() == 2 and marked.count() == len(rows) and marked.where("possible").count() == 1
