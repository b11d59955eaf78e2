"""Embedding whitening by shifted CholeskyQR.

The fit list is every distinct quantised vector once: x = floor(64 c) + 1,000,000 per entry. Its centred rows A are never
gathered; they are orthogonalised in passes over the stored list:

1. one pass counts the vectors and sums each dimension, in integers;
2. a pass solves each centred row against the triangular factors found so far and sums the Gram matrix of the solved rows;
   the driver adds a shift to the first Gram matrix, so that its Cholesky factor exists however ill-conditioned A is, and
   factorises it. Two further passes without a shift at least; more while the rows are not orthonormal;
3. the product of the factors is R of A = QR, and its singular value decomposition gives the components: R = U S W', so the
   covariance has eigenvectors W and eigenvalues S^2/n;
4. a last pass measures the covariance of the whitened fit list against the identity.

Rows are centred as (n x - S) / n from the exact integer n x - S. A pass sends d x d sums per task through a sum by entry, so
the driver gets d^2 numbers (d: dimensions) whatever the number of vectors. Equal vectors collapse before the shuffle, so a
vector that a third of all rows hold costs one row a task.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are vectors whose
length is not the most frequent one (of several the longest). Null and repeated ids keep a row each; repeated vectors weigh
once in the fit. Components without variance (singular value within rounding of 0) do not exist: a table with one distinct
vector has none, and an empty table gives an empty result. Entries beyond 2^52 / 64, and squares that leave 64 bits, are an
error. Further columns pass through; a column ``whitening`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.stored import store

SCALE, OFFSET = 64, 1_000_000  # x = floor(SCALE * c) + OFFSET
ORTHONORMAL = 1e-12            # largest departure of a Gram matrix from the identity that ends the passes
LEAST_PASSES, MOST_PASSES = 3, 8  # one shifted and two plain ones; only rank-deficient lists need more
UNIT = 2.0 ** -53


@dataclass(frozen=True)
class Whitening:
    """``components``: one unit eigenvector per row, by falling eigenvalue; ``trace``: of the whole covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = float("nan")


def remaining(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector takes part."""
    whole = embeddings.filter(F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(
        F.col(column), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    common = whole.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    return whole.filter(F.size(column) == (common.d if common else 0))


def quantised(column: Column) -> Column:
    """The vector in whole numbers."""
    scaled = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE))
    exact = F.forall(scaled, lambda x: F.abs(x) < 2**52)
    return F.when(exact, F.transform(scaled, lambda x: x + OFFSET)).otherwise(
        F.raise_error(F.lit("an entry is too large for exact whole numbers")))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.int64)


def _solve(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular factor, column by column."""
    solved = np.empty_like(rows)
    for j in range(rows.shape[1]):
        solved[:, j] = (rows[:, j] - solved[:, :j] @ factor[:j, j]) / factor[j, j]
    return solved


def _total(fit: DataFrame, of_rows: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum of ``of_rows`` (flat array) over all batches of the list, entry by entry."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in parts:
            if len(part):
                found = of_rows(_matrix(part["x"]))
                total = found if total is None else total + found
        if total is not None:
            yield pd.DataFrame({"entry": np.arange(len(total), dtype=np.int32), "value": total})

    summed = fit.mapInPandas(partial, f"entry int, value {kind}").groupBy("entry").agg(F.sum("value").alias("value"))
    return np.array([r.value for r in sorted(summed.collect(), key=lambda r: r.entry)])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular R with R'R = gram + shift, the shift raised until the factor exists."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(100 * shift, UNIT * np.trace(gram) / len(gram))


def orthogonalise(fit: DataFrame, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R and the Gram matrix of Q, where the centred list is QR and Q is orthonormal on the list's column space."""
    d = len(sums)
    factors: list[np.ndarray] = []

    def gram_of(x: np.ndarray) -> np.ndarray:
        rows = _centred(x, n, sums)
        for factor in factors:
            rows = _solve(rows, factor)
        return (rows.T @ rows).ravel()

    while True:
        gram = _total(fit, gram_of, "double").reshape(d, d)
        known = np.linalg.eigvalsh(gram)
        kept = known[known > 0.5]  # the others are directions in which the list does not vary
        orthonormal = len(factors) >= LEAST_PASSES and np.abs(kept - 1).max(initial=0) < ORTHONORMAL * d
        if orthonormal or known[-1] <= 0 or len(factors) >= MOST_PASSES:
            break
        deficient = known[0] <= 1e-6 * known[-1]
        factors.append(_factor(gram, 11 * d * (d + 1) * UNIT * known[-1] if not factors or deficient else 0.0))
    product = np.eye(d)
    for factor in factors:
        product = factor @ product
    return product, gram


def fit_whitening(embeddings: DataFrame, components: int = 16, column: str = "embedding") -> Whitening:
    """Components of the distinct quantised vectors of ``embeddings`` and how far whitening by them is from the identity."""
    fit = store(remaining(embeddings, column).select(quantised(F.col(column)).alias("x")).distinct(), "whitening-fit")
    n = fit.count()
    if not n:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    sums = _total(fit, lambda x: x.sum(0), "bigint").astype(np.int64)
    product, gram = orthogonalise(fit, n, sums)
    spread, across = np.linalg.eigh(gram)
    root = (across * np.sqrt(np.maximum(spread, 0))) @ across.T  # the identity, but for directions without variance
    _, singular, rows = np.linalg.svd(root @ product)
    varies = singular > 16 * len(sums) * UNIT * singular[0] if singular[0] > 0 else np.zeros(len(singular), bool)
    largest = rows[np.arange(len(rows)), np.abs(rows).argmax(1)]
    rows = rows * np.sign(largest)[:, None]
    eigenvalues = singular**2 / n
    keep = np.flatnonzero(varies)[:components]
    model = Whitening(n, sums, rows[keep], eigenvalues[keep], float(eigenvalues.sum()))
    if not len(keep):
        return model

    def moments(x: np.ndarray) -> np.ndarray:
        white = _white(x, model)
        return np.concatenate([white.sum(0), (white.T @ white).ravel()])

    found, k = _total(fit, moments, "double") / n, len(keep)
    covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    return Whitening(n, sums, model.components, model.eigenvalues, model.trace, float(np.abs(covariance - np.eye(k)).max()))


def _white(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _centred(x, model.n, model.sums) @ model.components.T / np.sqrt(model.eigenvalues)


def whiten(embeddings: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """The remaining rows with ``whitening``: deviation (sum of the squares of n x - S, exact) and values (the whitened
    coordinates, in the order of the components)."""

    @F.pandas_udf("deviation bigint, values array<double>")
    def coordinates(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"deviation": [], "values": []})
        x = _matrix(vectors)
        apart = model.n * x - model.sums
        if (apart.astype(float) ** 2).sum(1).max() >= 2.0**63:
            raise OverflowError("a sum of squared deviations leaves 64 bits")
        return pd.DataFrame({"deviation": (apart * apart).sum(1), "values": list(_white(x, model))})

    rows = remaining(embeddings, column)
    return rows.withColumn("whitening", coordinates(quantised(F.col(column))))
