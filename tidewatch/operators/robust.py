"""Location and scatter that a large share of odd entities can't bend.

The half of all entities whose covariance has the least determinant is sought
from many small random subsets. All candidates take their concentration steps
together: one pass over the entities gives the distance of each to every
candidate and the bound of each candidate's nearest half, a second one the moments
of those halves. The best few go on until they stand still. The winner is scaled
to be consistent for normal data and taken again over all entities near it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entities of which the first subsets are drawn, by hash. All entities take part in
#: every step after that.
DRAWN = 4096
#: Eigenvalues below this count as this: entities may lie in a plane.
LEAST = 1e-12


def chi2_share(x: float, df: int) -> float:
    """The share of a chi-square distribution below x, by its power series."""
    if x <= 0:
        return 0.0
    a, z = df / 2, x / 2
    term = total = 1 / a
    for k in range(1, 10_000):
        term *= z / (a + k)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(share: float, df: int) -> float:
    low, high = 0.0, 10.0 * df + 100
    for _ in range(200):
        low, high = ((low + high) / 2, high) if chi2_share((low + high) / 2, df) < share else (low, (low + high) / 2)
    return (low + high) / 2


def inverse(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """The (pseudo-)inverse and the logarithm of the determinant."""
    values, vectors = np.linalg.eigh(cov)
    fine = values > max(LEAST, 1e-10 * values.max(initial=0))
    return (vectors[:, fine] / values[fine]) @ vectors[:, fine].T, float(np.log(values.clip(LEAST)).sum())


def _squared(x: np.ndarray, means: np.ndarray, inverses: np.ndarray) -> np.ndarray:
    """(rows, candidates): squared distances under each candidate."""
    return np.stack([np.einsum("ij,jk,ik->i", x - m, i, x - m) for m, i in zip(means, inverses, strict=True)], axis=1)


def _bounds(rows: DataFrame, means: np.ndarray, inverses: np.ndarray, share: float) -> list[float]:
    """For each candidate the distance within which a share of all rows lies (to
    one in 10,000 rows)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"d": list(_squared(np.stack(f["x"]), means, inverses))})

    found = rows.mapInPandas(run, "d array<double>")
    return list(found.agg(*(F.percentile_approx(F.col("d")[i], share, 10_000) for i in range(len(means)))).first())


def _moments(rows: DataFrame, means: np.ndarray, inverses: np.ndarray, bounds: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, covariances and numbers of the rows within each candidate's bound."""
    p, limit = means.shape[1], np.array(bounds)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(means), 1 + p + p * p))
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f["x"])
            near = _squared(x, means, inverses) <= limit
            for c in range(len(means)):
                # Around the candidate's own mean, where sums stay small.
                part = x[near[:, c]] - means[c]
                sums[c] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        yield pd.DataFrame({"c": range(len(means)), "sums": list(sums)})

    parts = rows.mapInPandas(run, "c int, sums array<double>").select("c", F.posexplode("sums").alias("i", "v"))
    total = np.zeros((len(means), 1 + p + p * p))
    for r in parts.groupBy("c", "i").agg(F.sum("v").alias("v")).collect():  # candidates * (1 + p + p^2)
        total[r["c"], r["i"]] = r["v"]
    n = total[:, 0].clip(1)
    shift = total[:, 1 : 1 + p] / n[:, None]
    cov = total[:, 1 + p :].reshape(-1, p, p) / n[:, None, None] - shift[:, :, None] * shift[:, None, :]
    return means + shift, cov, total[:, 0]


def least_determinant(rows: DataFrame, starts: int = 30, first: int = 2, kept: int = 8, most: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int] | None:
    """(mean, covariance, dimensions) over the stored ``rows(x array<double>)``,
    reweighted; None where they are too few to have a covariance."""
    drawn = np.array([r["x"] for r in rows.orderBy(F.xxhash64("x")).limit(DRAWN).collect()], float)
    n = rows.count()
    p = drawn.shape[1] if len(drawn) else 0
    if n <= p + 1:
        return None
    rng = np.random.default_rng(seed)
    means, inverses = [], []
    for _ in range(starts):
        order, size = rng.permutation(len(drawn)), p + 1
        # A subset that lies in a plane grows until it does not, or is all.
        while size < len(drawn) and np.linalg.matrix_rank(np.cov(drawn[order[:size]], rowvar=False)) < p:
            size = min(len(drawn), 2 * size)
        some = drawn[order[:size]]
        means.append(some.mean(axis=0))
        inverses.append(inverse(np.cov(some, rowvar=False))[0])
    means, inverses = np.array(means), np.array(inverses)
    half = (n + p + 1) // 2 / n
    logs = np.full(len(means), np.inf)
    for step in range(most):
        means, cov, _ = _moments(rows, means, inverses, _bounds(rows, means, inverses, half))
        found = [inverse(c) for c in cov]
        new = np.array([log for _, log in found])
        still = bool((np.abs(new - logs) <= 1e-9 * (1 + np.abs(new))).all())
        logs, inverses = new, np.array([i for i, _ in found])
        if step + 1 == first:
            best = np.argsort(logs, kind="stable")[:kept]
            means, inverses, logs, cov = means[best], inverses[best], logs[best], cov[best]
        elif step >= first and still:
            break
    best = int(np.argmin(logs))
    mean, scatter = means[best], cov[best]
    own = (mean[None], inverse(scatter)[0][None])
    # The median of distances is what normal data have, ...
    scale = _bounds(rows, *own, 0.5)[0] / chi2_quantile(0.5, p)
    if not scale > 0:
        return mean, scatter, p
    # ... and all entities that normal data may have count again.
    means, cov, n_near = _moments(rows, own[0], own[1] / scale, [chi2_quantile(0.975, p)])
    return (means[0], cov[0] * n_near[0] / max(n_near[0] - 1, 1), p) if n_near[0] > p + 1 else (mean, scatter * scale, p)
