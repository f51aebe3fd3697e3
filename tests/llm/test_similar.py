from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tidepanel.llm import similar


def shingles(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def classes(rows: list[tuple]) -> dict:
    """Smallest id per row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) >= 0.8 * union:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least: dict = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return [least.get(find(k)) for k in range(len(rows))]


def group(seed: int, words: int, copies: int, edits: int) -> list[str]:
    """A text and copies of it with some words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(text))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, node string").repartition(6)


def test_classes_are_those_of_all_pairs(spark):
    texts = [t for seed in range(12) for t in group(seed, random.Random(seed).choice([12, 60, 300]), 14, 4)]
    texts += group(99, 150, 120, 4)
    texts += ["one", "One", "two words", "", " \n", "lonely " + " ".join(f"l{k}" for k in range(80))]
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    rows += [(None, None), (rows[3][0], rows[3][1]), (None, texts[0].upper()), (10_000, " ".join(f"z{k}" for k in range(40_000)))]
    want = classes(rows)
    found: dict = {}
    for r in similar.similar_documents(frame(spark, rows)).collect():
        found.setdefault(r["doc_id"], []).append(r["component_id"])
    assert sum(map(len, found.values())) == len(rows)
    pairs = [(d, w) for (d, _), w in zip(rows, want, strict=True) if d is not None and w != d]
    caught = sum(w in found[d] for d, w in pairs)
    assert len(pairs) > 150 and caught >= 0.95 * len(pairs)
    # No document joins a class it does not belong to.
    class_of = {d: w for (d, _), w in zip(rows, want, strict=True) if d is not None}
    assert all(class_of[c] == class_of[d] for d, cs in found.items() if d is not None for c in cs)


def test_pairs_at_the_similarity_are_found_in_many_texts(spark):
    """Recall over pairs of 0.8 to 0.9 among 3,000 unrelated texts."""
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(80))) for k in range(3000)]
    for k in range(0, 600, 2):
        text = rows[k][1].split()
        text[rng.randrange(5, 75)] = "other"
        if rng.random() < 0.5:
            text[-1 - rng.randrange(4)] = "last"
        rows[k + 1] = (k + 1, " ".join(text))
    near = [k for k in range(0, 600, 2) if len(shingles(rows[k][1]) & shingles(rows[k + 1][1])) >= 0.8 * len(shingles(rows[k][1]) | shingles(rows[k + 1][1]))]
    found = {r["doc_id"]: r for r in similar.similar_documents(frame(spark, rows)).collect()}
    assert len(near) > 250 and sum(found[k + 1]["component_id"] == k for k in near) >= 0.95 * len(near)
    assert all(r["component_id"] == d and r["n_links"] == 0 for d, r in found.items() if d >= 600)


def test_an_empty_table_has_no_classes(spark):
    assert similar.similar_documents(frame(spark, [(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_forest_has_the_least_length(seed):
    rng = np.random.default_rng(seed)
    size, count = 40, 200
    left, right, length = rng.integers(0, size, count), rng.integers(0, size, count), rng.integers(0, 9, count)
    got = similar.closest_forest(size, left, right, length)
    parent = list(range(size))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    total = edges = 0
    for k in np.argsort(length, kind="stable"):
        a, b = find(left[k]), find(right[k])
        if a != b:
            parent[a] = b
            total, edges = total + length[k], edges + 1
    assert len(got) == edges and length[got].sum() == total


@pytest.mark.parametrize("held,part", [(similar.HELD, similar.PART), (50, 1024), (50, 16)])
def test_a_crowded_subtrie_cut_in_parts_keeps_its_classes(spark, monkeypatch, held, part):
    rows = list(enumerate(group(7, 120, 90, 6)))
    monkeypatch.setattr(similar, "HELD", held)
    monkeypatch.setattr(similar.candidate_links, "__defaults__", (*similar.candidate_links.__defaults__[:-1], part))
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(frame(spark, rows)).collect()}
    want = classes(rows)
    joined = [k for k, w in enumerate(want) if w != k]
    assert len(joined) > 40 and sum(found[k] == want[k] for k in joined) >= 0.95 * len(joined)


def _cells(prints):
    columns = {"node": list(range(len(prints)))} | {f"p{k}": [p[k] for p in prints] for k in range(similar.WORDS)}
    return pa.table(columns | {c: [0] * len(prints) for c in ("trie", "root", "x", "y", "side")})


def test_texts_that_share_a_word_of_their_print_meet():
    """Equal first words, others apart by a few bits: every pair is near."""
    masks = similar.trie_masks()
    table_ = _cells([(5, 1 << k, 0, 0) for k in range(12)] + [(4, 0, 0, 0)])
    found = set()
    for _, mine, _, pairs in similar._near_pairs(table_, [0, *masks[1:]], similar.BUDGET, similar.WIDE_BUDGET):
        for left, right, _ in pairs:
            found |= {tuple(sorted(p)) for p in zip(mine[left].tolist(), mine[right].tolist(), strict=True)}
    assert found == {(i, j) for i in range(13) for j in range(i + 1, 13)}


def test_cells_with_pairs_left_over_are_named_and_checked():
    """Twelve near prints, more pairs than the forests hold; only the last two texts are alike and of two classes."""
    masks = [0, *similar.trie_masks()[1:]]
    table_ = _cells([(5, 1 << k, 0, 0) for k in range(12)])
    rows = [r for b in similar._forests(table_, masks, similar.BUDGET, similar.WIDE_BUDGET) for r in b.to_pylist()]
    assert sum(r["a"] is None for r in rows) == 1 and sum(r["a"] is not None for r in rows) < 66
    classed = table_.append_column("class", pa.array(range(12)))
    opened = pa.Table.from_batches(similar._open(classed, masks, similar.BUDGET, similar.WIDE_BUDGET))
    assert opened.num_rows == 12
    sets = pa.array([[k * 10] for k in range(11)] + [[100]], pa.list_(pa.int64()))
    links = [tuple(r.values()) for b in similar._checked(classed.append_column("shingles", sets), masks, similar.BUDGET, similar.WIDE_BUDGET, 0.8) for r in b.to_pylist()]
    assert links == [(10, 11)]
