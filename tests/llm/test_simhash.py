from __future__ import annotations

import numpy as np
import pytest
import xxhash

from tidepanel.llm import simhash
from tidepanel.llm.components import connected


def plain_fingerprint(text: str | None, shingle: int = 4) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for white in "\t\n\v\f\r":
        lowered = lowered.replace(white, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    pieces = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values: list[tuple], budget: int) -> dict:
    """Smallest id by fingerprint class, by comparing all pairs."""
    parent = list(range(len(values)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(values)):
        for j in range(i):
            if (values[i][1] ^ values[j][1]).bit_count() <= budget:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least: dict = {}
    for k, (doc, _) in enumerate(values):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return [(doc, f"{bits:016x}", least.get(find(k))) for k, (doc, bits) in enumerate(values)]


@pytest.mark.parametrize(
    "text", [None, "", " \n\t", "one", "One TWO three", "Ünïcode ÄÖ a b c d", "x " * 5000, "a\x1cb c\x85d e f g h i"]
)
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def near(seed: int, count: int, flips: int) -> list[int]:
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 1 << 63))
    out = {base}
    while len(out) < count:
        value = base
        for b in rng.choice(64, flips, replace=False):
            value ^= 1 << int(b)
        out.add(value)
    return sorted(out)


@pytest.mark.parametrize("budget,blocks,part", [(4, 6, 1024), (4, 5, 7), (2, 3, 5), (0, 1, 4), (4, 7, 64)])
def test_links_give_the_same_classes_as_all_pairs(spark, budget, blocks, part):
    rng = np.random.default_rng(budget + part)
    values = near(1, 60, 3) + near(2, 40, 6) + [0, 1, (1 << 64) - 1] + [int(v) for v in rng.integers(0, 1 << 63, 80)]
    values = sorted(set(values))
    signed = [(simhash._signed(v),) for v in values]
    links = simhash.linked(spark.createDataFrame(signed, "bits bigint"), budget, blocks, part)
    roots = {r["node"] % (1 << 64): r["root"] for r in connected(links, "a", "b").collect()}
    want = classes([(k, v) for k, v in enumerate(values)], budget)
    groups: dict = {}
    for k, v in enumerate(values):
        groups.setdefault(roots.get(v, ("own", v)), set()).add(k)
    expected: dict = {}
    for k, _, c in want:
        expected.setdefault(c, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_documents_with_nulls_ties_and_clashing_columns(spark):
    words = " ".join(f"w{k}" for k in range(400))
    rows = [
        (7, words, "x"), (3, words, "x"), (3, words, None), (9, words.replace("w17 ", "v17 "), "x"), (1, None, "x"),
        (4, "", "x"), (None, words.upper(), "x"), (5, "alone here now", "x"), (None, "other words than any", None),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string").withColumnRenamed(
        "fingerprint", "bits"
    )
    got = {tuple(r) for r in simhash.near_duplicates(frame).collect()}
    want = set(classes([(d, plain_fingerprint(t)) for d, t, _ in rows], 4))
    assert got == want
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_a_long_chain_is_one_component(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 2000), (2000, 1000), (5, 5)]
    found = connected(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5), "a", "b").collect()
    assert {r["node"]: r["root"] for r in found} == {**{k: 0 for k in range(201)}, 1000: 1000, 2000: 1000}
