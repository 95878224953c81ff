"""Quality filters, normalisation and principal components against numpy."""

import numpy as np
import pytest

from cellweave.operators.ingest import normalised, principal_components, quality_filtered

LONG = "gene string, cell_id string, value double"


def frame(spark, matrix):
    """genes x cells -> long rows of non-zero values."""
    rows = [(f"g{i:03d}", f"c{j:03d}", float(v)) for (i, j), v in np.ndenumerate(matrix) if v]
    return spark.createDataFrame(rows, LONG).repartition(3)


def test_filters_and_normalisation(spark):
    x = np.random.default_rng(1).poisson(0.6, (30, 25)).astype(float)
    x[3], x[:, 4] = 0, 0
    x[5, :2] = 9
    x[5, 2:] = 0
    genes = (x >= 1).sum(axis=1) >= 3
    kept = x[genes]
    cells = (kept >= 1).sum(axis=0) >= 8
    assert 0 < cells.sum() < 25 and 0 < genes.sum() < 30
    want = {(f"g{i:03d}", f"c{j:03d}"): x[i, j] for i in np.flatnonzero(genes) for j in np.flatnonzero(cells) if x[i, j]}
    found = quality_filtered(frame(spark, x), min_genes=8)
    assert {(r.gene, r.cell_id): r.value for r in found.collect()} == want
    y = x[np.ix_(genes, cells)]
    y = np.log2(1 + 6000 * y / y.sum(axis=0))
    ids = [(f"g{i:03d}", f"c{j:03d}") for i in np.flatnonzero(genes) for j in np.flatnonzero(cells)]
    flat = dict(zip(ids, y.ravel()))
    assert all(flat[r.gene, r.cell_id] == pytest.approx(r.value) for r in normalised(found).collect())


@pytest.mark.parametrize("side", [4, 64])
def test_components_against_svd(spark, side):
    rng = np.random.default_rng(2)
    axes = np.linalg.qr(rng.normal(size=(21, 3)))[0]
    x = axes @ (rng.normal(size=(3, 60)) * np.array([[9.0], [6.0], [4.0]])) + rng.normal(size=(21, 60)) * 0.1 + rng.normal(size=(21, 1))
    x[np.abs(x) < 0.3] = 0
    x[:, 7] = 0  # a cell without values
    cells = spark.createDataFrame([(f"c{j:03d}",) for j in range(60)], "cell_id string")
    found = principal_components(frame(spark, x), cells, k=3, side=side)
    centered = x - x.mean(axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(centered, full_matrices=False)
    assert found.shares == pytest.approx((s**2 / (s**2).sum())[:3].tolist(), rel=1e-6)
    assert found.variance == pytest.approx((s**2).sum() / 59)
    got = np.zeros((21, 3))
    for r in found.loadings.collect():
        got[int(r.gene[1:]), r.pc - 1] = r.value
    assert np.abs(np.abs(np.sum(got * u[:, :3], axis=0)) - 1).max() < 1e-6
    assert np.abs((axes.T @ got) ** 2).sum() > 2.95  # the planted axes
    scores = np.zeros((3, 60))
    for r in found.scores.collect():
        scores[r.pc - 1, int(r.cell_id[1:])] = r.value
    assert np.abs(scores - got.T @ centered).max() < 1e-6


def test_components_without_variance(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    assert principal_components(spark.createDataFrame([], LONG), cells).shares == []
    assert principal_components(spark.createDataFrame([("g", "a", 1.0), ("g", "b", 1.0)], LONG), cells).shares == []
