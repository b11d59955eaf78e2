from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import whitening
from shelfwatch.llm.queries import queries

from .conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>"


def numpy_whitening(vectors, most=16):
    """n, deviations, eigenvalues, shares and whitened coordinates from the singular vectors of all centred rows."""
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums) / n
    _, singular, rows = np.linalg.svd(centred, full_matrices=False)
    values, across = singular**2 / n, rows.T
    k = min(most, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    white = ((n * x - sums) / n) @ across[:, :k] / np.sqrt(values[:k])
    return n, ((n * x - sums) ** 2).sum(1), values[:k], values[:k] / values.sum(), white


def compare(rows, vectors, tolerance=1e-9):
    n, deviations, values, shares, white = numpy_whitening(vectors)
    model = whitening.fit_whitening(rows)
    assert (model.n, len(model.eigenvalues)) == (n, len(values))
    np.testing.assert_allclose(model.eigenvalues, values, rtol=1e-9)
    np.testing.assert_allclose(model.eigenvalues / model.trace, shares, rtol=1e-9)
    assert model.identity_error < 1e-9
    found = sorted(whitening.whiten(rows, model).collect(), key=lambda r: r.vec_id)
    assert [r.whitening.deviation for r in found] == deviations.tolist()
    got = np.array([r["whitening"]["values"] for r in found])
    signs = np.sign((got * white).sum(0))
    np.testing.assert_allclose(got * signs, white, atol=tolerance)
    return found


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], SCHEMA)


def test_query_equals_the_eigenvectors(spark, small):
    embeddings = small("embeddings").orderBy("vec_id").collect()
    n, deviations, _, shares, white = numpy_whitening([r.embedding for r in embeddings])
    rows = queries()["op12_whitening"](spark, SMALL).collect()
    assert len(rows) == 16 * len(embeddings)
    at = {r.vec_id: i for i, r in enumerate(embeddings)}
    got = np.zeros(white.shape)
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviations[at[r.vec_id]] and r.identity_error < 1e-4
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
    np.testing.assert_allclose(got * np.sign((got * white).sum(0)), white, atol=1e-8)


def test_repeated_vectors_weigh_once(spark):
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(40, 5))
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 200, 0)])
    compare(frame(spark, vectors), vectors)


def test_widely_spread_scales(spark):
    """Condition 10^8 of the covariance: one pass of Cholesky alone would lose half of the digits."""
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(300, 6)) * 10.0 ** np.array([4, 3, 2, 1, 0.5, 0]) @ np.linalg.qr(draw.normal(size=(6, 6)))[0]
    compare(frame(spark, vectors), vectors, 1e-6)


def test_directions_without_variance_are_left_out(spark):
    draw = np.random.default_rng(3)
    flat = np.round(draw.normal(size=(60, 3)) * 64) / 64
    vectors = np.column_stack([flat, flat[:, 0], np.full(60, 0.5), flat[:, 1] + flat[:, 2]])
    found = compare(frame(spark, vectors), vectors, 1e-7)
    assert {len(r["whitening"]["values"]) for r in found} == {3}


def test_rows_that_are_dropped(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]),
            (None, [0.25, 0.75]), (1, [2.0, 1.0]), (8, [-0.001, 0.0])]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"whitening": F.lit(1), "x": F.lit(2), "entry": F.lit(3)})
    found = whitening.whiten(table, whitening.fit_whitening(table)).collect()
    assert sorted(str(r.vec_id) for r in found) == ["1", "1", "8", "None"]
    assert all(r.x == 2 and r.entry == 3 for r in found)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    """Empty tables, and one distinct vector: there is no component."""
    table = spark.createDataFrame(rows, SCHEMA)
    model = whitening.fit_whitening(table)
    assert len(model.eigenvalues) == 0
    found = whitening.whiten(table, model).collect()
    assert len(found) == sum(v is not None for _, v in rows)
    assert all(list(r["whitening"]["values"]) == [] and r.whitening.deviation == 0 for r in found)


def test_entries_beyond_exact_whole_numbers_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        whitening.fit_whitening(frame(spark, [[1e30, 0.0], [0.0, 1.0]]))
