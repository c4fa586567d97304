"""Robust covariance: a planted cluster, exact moments, flat and tiny tables."""

import numpy as np
import pandas as pd
import pytest

from tidewatch.operators import robust


def _rows(spark, x):
    return spark.createDataFrame(pd.DataFrame({"x": [list(map(float, r)) for r in x]}), "x array<double>").repartition(3).cache()


def _square(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, robust.inverse(cov)[0], x - mean)


def test_chi_square():
    # Known values: medians and 97.5 % points.
    for df, share, want in ((1, 0.5, 0.454936), (2, 0.5, 1.386294), (5, 0.5, 4.351460), (1, 0.975, 5.023886), (11, 0.975, 21.920049)):
        assert robust.chi2_quantile(share, df) == pytest.approx(want, abs=1e-5)


def test_planted_cluster(spark):
    """30 % of entities in a cluster: moments over all rows, and two steps from
    them, take it for normal; least determinant leaves it out."""
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(4, 4))
    x = np.concatenate([rng.normal(size=(700, 4)) @ mix, rng.normal(8, 0.5, size=(300, 4)) @ mix])
    mean, cov, p = robust.least_determinant(_rows(spark, x), starts=20)
    d = _square(x, mean, cov)
    assert p == 4 and d[700:].min() > np.quantile(d[:700], 0.99)
    m, c = x.mean(axis=0), np.cov(x, rowvar=False)
    for _ in range(2):
        near = np.argsort(_square(x, m, c))[:502]
        m, c = x[near].mean(axis=0), np.cov(x[near], rowvar=False)
    plain = _square(x, m, c)
    assert plain[700:].min() < np.quantile(plain[:700], 0.99)
    # On the normal part, reweighted moments are close to the true ones.
    assert np.allclose(cov, mix.T @ mix, atol=0.25 * np.abs(mix.T @ mix).max()) and np.abs(mean).max() < 0.4


def test_moments_are_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1000, 1, (200, 3))
    means, inverses = np.array([[1000.0] * 3, [1001.0] * 3]), np.array([np.eye(3), np.eye(3) * 2])
    got = robust._moments(_rows(spark, x), means, inverses, [3.0, 5.0])
    for c, limit in enumerate((3.0, 5.0)):
        near = x[robust._squared(x, means, inverses)[:, c] <= limit]
        assert got[2][c] == len(near) > 5
        assert np.allclose(got[0][c], near.mean(axis=0)) and np.allclose(got[1][c], np.cov(near, rowvar=False, bias=True))


def test_flat_and_tiny(spark):
    rng = np.random.default_rng(6)
    flat = np.column_stack([rng.normal(size=80), np.zeros(80), rng.normal(size=80)])
    mean, cov, _ = robust.least_determinant(_rows(spark, flat), starts=5)
    assert np.isfinite(_square(flat, mean, cov)).all() and abs(cov[1]).max() == 0
    mean, cov, _ = robust.least_determinant(_rows(spark, np.ones((40, 3))), starts=3)
    assert np.isfinite(cov).all() and mean == pytest.approx(np.ones(3))
    assert robust.least_determinant(_rows(spark, flat[:3]), starts=2) is None
    assert robust.least_determinant(_rows(spark, flat[:3]).limit(0), starts=2) is None
