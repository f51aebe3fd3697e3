from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
import zlib
from tokenizers import Tokenizer

from tidepanel.llm import wordbpe
from tidepanel.llm.common import batches, picked, possible
from tests.llm.test_quality import plain_measures
from tests.llm.test_similar import classes
from tests.llm.test_substring import plain_repeats
from tidepanel.llm.substring import cut


def corpus() -> list[tuple]:
    rng = random.Random(11)
    words = [f"w{k}" for k in range(500)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    shared = make(60)
    texts = [make(rng.randint(60, 400)) for _ in range(60)]
    texts += [t for t in texts[:10] for _ in range(3)]  # exact copies
    texts += [t + " end" for t in texts[10:20]]  # near copies
    texts += [t.replace(t.split()[30], "changed", 1).replace(t.split()[45], "too", 1) for t in texts[20:30]]
    texts += [f"{make(80)}\n{shared}\n{make(90)}" for _ in range(12)]  # one passage in many
    texts += ["too short", "a b c " * 60, None, "", shared, "word " * 9000]
    rng.shuffle(texts)
    return [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_pipeline(rows: list[tuple]) -> dict[int, str]:
    """The texts that reach packing, by plain loops."""
    kept = []
    for row in rows:
        n_words, _, _, _, repeated = plain_measures(row[1])
        if n_words >= 50 and 100 * repeated <= 50 * n_words:
            kept.append(row)
    kept = [r for r, least in zip(kept, classes([(r[0], r[1]) for r in kept]), strict=True) if least == r[0]]
    spans: dict = {}
    for doc, start, end, _, _ in plain_repeats([(r[0], r[1]) for r in kept], 20):
        spans.setdefault(doc, []).append((start, end))
    texts = {r[0]: cut(r[1], spans.get(r[0], [])) for r in kept}
    return {d: t for d, t in texts.items() if t.split()}


def test_stages_against_plain_python(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_pipeline(rows)
    assert 60 < len(want) < len(rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.stored(out, name)
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    library = Tokenizer.from_file(wordbpe.tokenizer_path("word_bpe_49k.json"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = {
        (d, k // 4096): zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())
        for d, t in want.items()
        for ids in [[*library.encode(t, add_special_tokens=False).ids, 1]]
        for k in range(0, len(ids), 4096)
    }
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packed} == pieces


def test_clashing_columns_nulls_and_repeated_ids_pass_every_stage(spark):
    good = " ".join(f"v{k}" for k in range(80))
    other = " ".join(f"u{k}" for k in range(80))
    extra = ["kept", "bits", "component_id", "removed_spans", "span_id", "c0", "rows", "host", "spans"]
    rows = [(good, 3, None), (good, 3, "s"), (good, 1, "s"), (other, None, "s"), (other, None, None), (None, 9, "s")]
    frame = spark.createDataFrame([(*r, "en", 1, *extra) for r in rows], "text string, doc_id bigint, source string, lang string, n_chars int, " + ", ".join(f"{c} string" for c in extra))
    docs = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == frame.columns
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) == [(1, good), (None, other)]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted((r["doc_id"] for r in packed), key=str) == [1, None]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), "").count() == 0


def test_columns_are_found_by_exact_name_first(spark):
    frame = spark.createDataFrame([(1, 2, "a")], "DOC_ID int, doc_id int, Text string")
    assert picked(frame, id="doc_id", text="text").collect() == [(2, "a")]
    with pytest.raises(ValueError):
        picked(frame, id="missing")


def test_batches_are_cut_by_rows_and_weight():
    import pyarrow as pa

    schema = pa.schema([("a", pa.int64()), ("b", pa.binary())])
    assert [b.num_rows for b in batches(((k, b"x" * 10) for k in range(10)), schema, size=4)] == [4, 4, 2]
    assert [b.num_rows for b in batches(((k, b"x" * 10) for k in range(5)), schema, weight=25)] == [3, 2]
    assert list(batches([], schema)) == []


@pytest.mark.parametrize("words", [1, 2, 1 << 18])
def test_no_wanted_key_is_lost_in_a_bitmap(spark, words):
    keys = [0, 1, -1, 63, 64, 127, -(2**63), 2**63 - 1, 5 << 40]
    frame = spark.createDataFrame([(k, n) for n, k in enumerate([*keys, *keys, *range(1000, 1100)])] + [(None, 999)], "key bigint, n int")
    wanted = spark.createDataFrame([(k,) for k in [*keys, keys[0]]], "w bigint")
    left = [r["n"] for r in possible(frame, "key", wanted, words).collect()]
    assert len(left) == len(set(left)) and set(range(18)) <= set(left) and 999 not in left
    assert possible(frame, "key", wanted.limit(0), words).count() == 0
    if words > 2:
        assert len(left) == 18


def test_documents_that_surely_stay_are_not_moved(spark, monkeypatch):
    make = lambda k: " ".join(f"x{k}_{j}" for j in range(60))
    rows = [(k, make(k)) for k in range(80)] + [(100, make(3)), (101, make(101)), (101, make(102)), (None, make(5)), (None, make(103))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen, real = [], corpus_pipeline.marked_possible
    monkeypatch.setattr(corpus_pipeline, "marked_possible", lambda *args: seen.append(real(*args)) or seen[-1])
    out = [r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, frame, "").collect()]
    assert sorted(d for d in out if d is not None) == [*range(80), 101] and None in out
    assert seen[0].count() == len(rows) and seen[0].where("possible").count() < 8
