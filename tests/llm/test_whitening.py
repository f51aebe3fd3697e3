from __future__ import annotations

import math

import numpy as np
import pytest

from tidepanel.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>, x string"


def brute(vectors: np.ndarray, count: int = 8):
    x = np.floor(1024 * vectors).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    moved = [[n * int(c) - int(s) for c, s in zip(row, sums, strict=True)] for row in x]
    centred = np.array(moved, dtype=float) / n
    # From the rows, not from their products: those would lose half of the digits.
    left, values, _ = np.linalg.svd(centred, full_matrices=False)
    return n, [sum(m * m for m in row) for row in moved], left[:, :count] * np.sqrt(n), values[:count] ** 2 / np.square(values).sum()


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("rows,size,rank", [(300, 12, 12), (80, 30, 30), (400, 20, 3), (9, 20, 20)])
def test_components_are_those_of_the_covariance(spark, rows, size, rank):
    rng = np.random.default_rng(rows)
    vectors = rng.normal(size=(rows, rank)) @ (rng.normal(size=(rank, size)) * np.linspace(1, 4, size)) + 7
    found = whitening.whitened_components(frame(spark, [(k, v.tolist(), "") for k, v in enumerate(vectors)])).collect()
    n, deviations, white, shares = brute(vectors)
    width = min(8, size, rows - 1)
    assert len(found) == rows * width
    signs = {}
    for r in found:
        want = white[r["vec_id"], r["component"] - 1]
        if abs(want) > 0.5:
            signs.setdefault(r["component"], math.copysign(1, want * r["whitened"]))
    for r in found:
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviations[r["vec_id"]]
        assert r["whitened"] * signs[r["component"]] == pytest.approx(white[r["vec_id"], k], abs=1e-8)
        assert r["explained"] == pytest.approx(shares[k], rel=1e-10)
        assert r["identity_error"] < 1e-9


def test_bad_vectors_go_and_repeated_rows_stay(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 3)).tolist()
    rows = [(k, v, "a") for k, v in enumerate(good)]
    rows += [(1, good[1], "b"), (None, good[2], None), (50, None, ""), (51, [1.0, None, 2.0], "")]
    rows += [(52, [float("nan"), 0.0, 1.0], ""), (53, [1.0, float("inf"), 0.0], ""), (54, [1e300, 0.0, 0.0], ""), (55, [], "")]
    given = frame(spark, rows).withColumnRenamed("x", "deviation")
    found = whitening.whitened_components(given).collect()
    n, deviations, white, _ = brute(np.array([*good, good[1], good[2]]), 3)
    assert n == 42 and len(found) == 3 * n
    assert sorted(r["deviation"] for r in found if r["component"] == 2) == sorted(deviations)
    assert {r["vec_id"] for r in found} == {None, *range(40)}
    assert sorted(abs(r["whitened"]) for r in found if r["component"] == 1) == pytest.approx(sorted(abs(white[:, 0])), abs=1e-9)


def test_empty_and_constant_tables_have_no_component(spark):
    given = frame(spark, [(1, [1.0, 2.0], ""), (2, [1.0, 2.0], ""), (3, None, "")])
    rows, fit = whitening.whitened(given)
    assert fit.count == 2 and len(fit.values) == 0
    assert sorted((r["vec_id"], r["deviation"], r["whitened"]) for r in rows.collect()) == [(1, 0, []), (2, 0, [])]
    assert whitening.whitened_components(given).count() == 0
    empty = whitening.whitened_components(given.limit(0))
    assert empty.count() == 0
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(1, [float(1 << 30), 0.0], ""), (2, [0.0, 1.0], ""), (3, [0.0, 2.0], "")]
    found = whitening.whitened_components(frame(spark, rows)).where("component = 1").collect()
    assert {r["vec_id"]: r["deviation"] for r in found}[1] is None


def test_vectors_of_another_length_than_most_go(spark):
    rows = [(1, [1.0, 2.0], ""), (2, [1.0], ""), (3, [4.0, 2.5], ""), (4, [0.0, 1.0, 2.0], "")]
    found = whitening.whitened_components(frame(spark, rows)).collect()
    assert {(r["vec_id"], r["n"]) for r in found} == {(1, 2), (3, 2)}
