"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows form a tall matrix X that no machine holds.  Starting from one direction, the
method takes turns: u = X v on the rows, then v = X'u on the dimensions, and each new vector is
made orthogonal to all earlier ones.  In these bases X is a small upper bidiagonal matrix
whose singular value decomposition gives the components of X.

Passes.  Every left vector is a combination of rows, u = X w, so instead of keeping a value of
each u beside each row the driver keeps w, a vector as long as a dimension.  One pass over the rows
computes r = X z and X'r together; the inner products of r with all earlier left vectors are
w'(X'r), so full reorthogonalisation on both sides takes no pass of its own.  A task returns
partial sums, as many as there are dimensions.

Steps end when the wanted components have converged or all dimensions are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import picked, stored

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
SEED = 13
#: Residual of a component, relative to its distance from the next singular value, at which it counts as found.
TOLERANCE = 1e-11
#: A new direction shorter than this part of the largest singular value is rounding.
CLOSED = 1e-14
#: Singular values below this part of the largest are zero.
RANK = 1e-9


@dataclass(frozen=True)
class Whitening:
    """Fitted values: ``basis`` has a unit component per row, ``values`` its variance."""

    count: int
    sums: np.ndarray
    basis: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    steps: int


def whole_numbers(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors as longs, floor(1024 c) + 100000 per entry c.

    Rows go whose vector is null, empty, or holds an entry that is null, not finite, or too large for a long.
    """
    given = picked(embeddings, vec_id=id, vector=vector)
    good = F.forall("vector", lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << 40), F.lit(False)))
    kept = given.where(F.coalesce(good, F.lit(False)) & (F.size("vector") > 0))
    return kept.select(
        "vec_id", F.transform("vector", lambda c: F.floor(SCALE * c.cast("double")).cast("bigint") + SHIFT).alias("x")
    )


def one_length(vectors: DataFrame) -> DataFrame:
    """Only vectors of the length most rows have; of lengths equally frequent, the larger."""
    most = vectors.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return vectors if most is None else vectors.where(F.size("x") == most["size"])


def _rows(part: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as the rows of an array."""
    column = part.column("x")
    return column.flatten().to_numpy().reshape(len(column), -1)


def _summed(vectors: DataFrame, kind: type, term) -> np.ndarray:  # noqa: ANN001
    """Sum over all rows of ``term(rows as an array)``, a flat array, as a distributed aggregate."""
    number = pa.int64() if kind is int else pa.float64()

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            if part.num_rows:
                found = term(_rows(part))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total, number)], names=["place", "value"])

    partial = vectors.select("x").mapInArrow(work, f"place bigint, value {'bigint' if kind is int else 'double'}")
    rows = partial.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    return np.array([r["value"] for r in rows], dtype=np.int64 if kind is int else np.float64)


def _centred(rows: np.ndarray, count: int, sums: np.ndarray) -> np.ndarray:
    """Rows minus the mean; the difference is exact before the one division."""
    return (count * rows - sums) / count


def _orthogonal(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """The vector without its parts along the basis; the second turn removes what rounding left."""
    for _ in range(2):
        if basis:
            held = np.array(basis)
            vector = vector - held.T @ (held @ vector)
    return vector


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, seed: int = SEED) -> Whitening | None:
    """Components of stored ``x`` vectors; None without a row.

    At most ``components`` of them, fewer if the vectors span fewer dimensions.
    """
    counted = _summed(vectors, int, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]))
    if not len(counted):
        return None
    count, sums = int(counted[0]), counted[1:]
    size = len(sums)

    def turn(z: np.ndarray) -> tuple[np.ndarray, float]:
        def term(x: np.ndarray) -> np.ndarray:
            c = _centred(x, count, sums)
            r = c @ z
            return np.concatenate([c.T @ r, [r @ r]])

        found = _summed(vectors, float, term)
        return found[:-1], float(found[-1])

    rng = np.random.default_rng(seed)

    def fresh(basis: list[np.ndarray]) -> np.ndarray:
        v = _orthogonal(rng.standard_normal(size), basis)
        return v / np.linalg.norm(v)

    right: list[np.ndarray] = []  # v
    left: list[np.ndarray] = []  # w, with u = X w
    back: list[np.ndarray] = []  # X'u
    alphas: list[float] = []
    betas: list[float] = []
    v, beta = fresh(right), 0.0
    while True:
        right.append(v)
        z = v - beta * left[-1] if beta else v
        y, square = turn(z)
        if left:
            # Parts of r = X z along earlier u; the same combination leaves z and X'r.
            w_all, p_all = np.array(left), np.array(back)
            parts = w_all @ y
            z, y = z - w_all.T @ parts, y - p_all.T @ parts
            square -= float(parts @ parts)
        alpha = float(np.sqrt(max(square, 0.0)))
        if alpha <= RANK * max([alpha, *alphas, *betas]) or not np.isfinite(alpha):
            alpha = 0.0
        w, p = (z / alpha, y / alpha) if alpha else (np.zeros(size), np.zeros(size))
        left.append(w)
        back.append(p)
        alphas.append(alpha)
        if len(right) == size:
            beta = 0.0
            break
        rest = _orthogonal(p - alpha * v, right)
        beta = float(np.linalg.norm(rest))
        if beta <= CLOSED * max(alphas):
            # The span is closed; what it lacks is looked for from a new direction.
            v, beta = fresh(right), 0.0
        else:
            v = rest / beta
            u_small, values, _ = np.linalg.svd(_bidiagonal(alphas, betas))
            wanted = min(components, size)
            if len(alphas) > wanted:
                apart = values[:wanted] - values[1 : wanted + 1]
                gaps = np.minimum(apart, np.concatenate([[np.inf], apart[:-1]]))
                if (beta * np.abs(u_small[-1, :wanted]) <= TOLERANCE * gaps).all():
                    break
        betas.append(beta)
    _, values, turned = np.linalg.svd(_bidiagonal(alphas, betas[: len(alphas) - 1]))
    kept = values[:components] > RANK * values[0] if values[0] else np.zeros(min(components, size), bool)
    basis = (turned[: len(kept)] @ np.array(right))[kept]
    variances = values[: len(kept)][kept] ** 2 / count
    found = len(variances)

    def check(x: np.ndarray) -> np.ndarray:
        c = _centred(x, count, sums)
        white = c @ basis.T / np.sqrt(variances)
        return np.concatenate([(white.T @ white).ravel(), [np.square(c).sum()]])

    sums_of_products = _summed(vectors, float, check)
    covariance = sums_of_products[:-1].reshape(found, found) / count
    error = float(np.abs(covariance - np.eye(found)).max()) if found else 0.0
    return Whitening(count, sums, basis, variances, float(sums_of_products[-1]) / count, error, len(alphas))


def _bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)


def whitened(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(vec_id, deviation, whitened) and the fit: one array of whitened values per kept row.

    ``deviation`` is the exact sum over dimensions of (n x - S)^2, null where it exceeds a long.
    Rows are kept one by one: null or repeated ids and equal vectors stay as they are and all count in the
    fit; other columns are ignored.  Bad vectors go, see ``whole_numbers``, and so do those of another length than
    most rows have.  An empty table gives no rows
    and no fit; vectors that are all equal have no component and an empty array.
    """
    given = whole_numbers(embeddings, id, vector)
    kind = given.schema["vec_id"].dataType.simpleString()
    vectors = one_length(stored(given, "vectors"))
    fit = fit_whitening(vectors, components)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            rows = _rows(part)
            moved = fit.count * rows - fit.sums
            rough = np.square(moved.astype(np.float64)).sum(axis=1)
            exact = pa.array(np.square(moved).sum(axis=1), mask=rough > 9.2e18)
            values = moved / fit.count @ fit.basis.T / np.sqrt(fit.values)
            width = values.shape[1]
            offsets = pa.array(np.arange(0, len(rows) * width + 1, width) if width else np.zeros(len(rows) + 1), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), exact, lists], names=["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(work, f"vec_id {kind}, deviation bigint, whitened array<double>"), fit


def whitened_components(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per kept vector and component, with the figures of the fit; see ``whitened``."""
    rows, fit = whitened(embeddings, id, vector, components)
    spread = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = [] if fit is None else [float(v / fit.trace) for v in fit.values]
    return spread.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(0 if fit is None else fit.count).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*[F.lit(s) for s in shares]).cast("array<double>"), F.col("place")).alias("explained"),
        F.lit(0.0 if fit is None else fit.identity_error).alias("identity_error"),
    )
