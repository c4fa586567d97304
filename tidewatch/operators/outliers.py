"""Feature-space outlier operators.

Moments, histograms and projections are Catalyst aggregates over all entities.
Density models measure every entity against all others by a pivot index. Models that are fitted take a bounded sample (``SAMPLE``
entities) and are applied to every entity by ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.lineage import cut
from tidewatch.functions.scaling import EPS, scoremin
from tidewatch.operators import density, robust
from tidewatch.operators.features import FEATURES, feature_matrix

#: Rows that a fit may see; taken by a hash of the entity, so stable.
SAMPLE = 4096


def _sample(matrix: DataFrame, size: int = SAMPLE) -> np.ndarray:
    rows = matrix.orderBy(F.xxhash64("entity_id"), "entity_id").limit(size).select(*FEATURES)
    return rows.toPandas().to_numpy(float)


def _apply_raw(matrix: DataFrame, raw: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(entity_id, raw) with ``raw`` over feature rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"entity_id": f["entity_id"], "raw": raw(f[FEATURES].to_numpy(float))})

    kind = matrix.schema["entity_id"].dataType.simpleString()
    return matrix.mapInPandas(run, f"entity_id {kind}, raw double")


def _apply(matrix: DataFrame, raw: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Scores from ``raw`` over feature rows."""
    return scoremin(_apply_raw(matrix, raw), "raw")


def _nothing(matrix: DataFrame) -> DataFrame:
    return matrix.select("entity_id", F.lit(0.0).alias("score")).limit(0)


def _path_constant(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _forest(x: np.ndarray, trees: int, depth: int, oblique: bool, seed: int) -> list[list[tuple]]:
    """Isolation trees as node lists (direction, offset, left, right, size)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        nodes: list[tuple] = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append((None, 0.0, -1, -1, len(rows)))
            spread = x[rows].max(axis=0) - x[rows].min(axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
            if level >= depth or len(rows) <= 1 or spread.max() <= 0:
                return at
            if oblique:
                way = rng.normal(size=x.shape[1])
            else:
                way = np.zeros(x.shape[1])
                way[rng.choice(np.flatnonzero(spread > 0))] = 1.0
            z = x[rows] @ way
            cut = rng.uniform(z.min(), z.max())
            left, right = rows[z < cut], rows[z >= cut]
            if not len(left) or not len(right):
                return at
            nodes[at] = (way, cut, grow(left, level + 1), grow(right, level + 1), len(rows))
            return at

        grow(rng.choice(len(x), min(256, len(x)), replace=False), 0)
        out.append(nodes)
    return out


def _depths(forest: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for nodes in forest:
        stack = [(0, np.arange(len(x)), 0)]
        while stack:
            at, rows, level = stack.pop()
            way, cut, left, right, size = nodes[at]
            if way is None:
                total[rows] += level + _path_constant(size)
                continue
            low = x[rows] @ way < cut
            stack += [(left, rows[low], level + 1), (right, rows[~low], level + 1)]
    return total / len(forest)


def _isolation(events: DataFrame, trees: int, depth: int, oblique: bool, seed: int) -> DataFrame:
    matrix = feature_matrix(events)
    x = _sample(matrix)
    if len(x) < 5:
        return _nothing(matrix)
    forest, c = _forest(x, trees, depth, oblique, seed), _path_constant(min(256, len(x)))
    return _apply(matrix, lambda rows: 2.0 ** (-_depths(forest, rows) / c))


def isolation_forest(events: DataFrame, trees: int = 400, seed: int = 0) -> DataFrame:
    """Isolation forest over axis-parallel cuts; five entities at least."""
    return _isolation(events, trees, 8, False, seed)


def extended_isolation_forest(events: DataFrame, trees: int = 200, depth: int = 14, seed: int = 0) -> DataFrame:
    """Isolation by random hyperplanes; every tree scores every entity."""
    return _isolation(events, trees, depth, True, seed)


def local_outlier_factor(events: DataFrame, neighbours: int = 20, **sizes: int) -> DataFrame:
    """Local density against that of the nearest neighbours among all entities;
    ``sizes`` are those of the index."""
    matrix = feature_matrix(events)
    index = density.build(matrix, FEATURES, neighbours + 1, **sizes)
    if index is None:
        return _nothing(matrix)
    near = cut(density.nearest(index, neighbours))
    reach = near.where(F.size("ids") > 0).select(F.col("entity_id").alias("id"), F.array_max("dists").alias("reach"))
    pairs = near.select("entity_id", F.explode(F.arrays_zip("ids", "dists")).alias("x")).select("entity_id", F.col("x.ids").alias("id"), F.col("x.dists").alias("d"))
    far = pairs.join(reach, "id").groupBy("entity_id").agg((1 / (F.avg(F.greatest("d", "reach")) + 1e-10)).alias("density"))
    far = cut(far)
    around = pairs.join(far.select(F.col("entity_id").alias("id"), F.col("density").alias("other")), "id").groupBy("entity_id").agg(F.avg("other").alias("other"))
    return scoremin(far.join(around, "entity_id").select("entity_id", (F.col("other") / F.col("density")).alias("raw")), "raw")


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and covariance over all rows, in one pass."""
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    got = rows.agg(
        F.count("*"), *(F.avg(c) for c in FEATURES), *(F.covar_samp(FEATURES[i], FEATURES[j]) for i, j in pairs)
    ).first()
    n, mean = got[0], np.array([v or 0.0 for v in got[1 : 1 + len(FEATURES)]])
    cov = np.zeros((len(FEATURES), len(FEATURES)))
    for (i, j), v in zip(pairs, got[1 + len(FEATURES) :], strict=True):
        cov[i, j] = cov[j, i] = v or 0.0
    return mean, cov, n


def _form(mean: np.ndarray, matrix: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """(x - mean)' M (x - mean) of feature rows."""
    return lambda rows: np.einsum("ij,jk,ik->i", rows - mean, matrix, rows - mean)


def mahalanobis(events: DataFrame, starts: int = 30) -> DataFrame:
    """Squared distance under the covariance of least determinant."""
    matrix = feature_matrix(events)
    rows = cut(matrix.select(F.array(*FEATURES).alias("x")))
    found = robust.least_determinant(rows, starts)
    if found is None:
        return _nothing(matrix)
    mean, cov, _ = found
    return _apply(matrix, _form(mean, robust.inverse(cov)[0]))


def pca_error(events: DataFrame, components: int = 4) -> DataFrame:
    """Squared distance from the span of the leading components."""
    matrix = feature_matrix(events)
    mean, cov, n = _moments(matrix)
    if n < 5:
        return _nothing(matrix)
    _, vectors = np.linalg.eigh(cov)
    rest = vectors[:, : len(FEATURES) - components]
    return _apply(matrix, _form(mean, rest @ rest.T))


def max_zscore(events: DataFrame) -> DataFrame:
    """The largest standardised feature, either way."""
    return largest_deviation(feature_matrix(events))


def largest_deviation(matrix: DataFrame) -> DataFrame:
    """``max_zscore`` of a matrix that is made already."""
    return scoremin(matrix.select("entity_id", F.greatest(*(F.abs(F.col(c)) for c in FEATURES)).alias("raw")), "raw")


def hbos(events: DataFrame, bins: int = 10) -> DataFrame:
    """Sum over features of -ln of the share of an equal-width bin."""
    matrix = feature_matrix(events)
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).alias("x")) for i, c in enumerate(FEATURES)))).alias("p")
    long = matrix.select("entity_id", pairs).select("entity_id", "p.f", "p.x")
    edge = long.groupBy("f").agg((F.min("x") - EPS).alias("lo"), (F.max("x") + EPS).alias("hi"), F.count("*").alias("n"))
    placed = long.join(F.broadcast(edge), "f").withColumn("b", F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    share = placed.groupBy("f", "b").agg(F.count("*").alias("k"), F.first("n").alias("m"))
    cost = share.select("f", "b", (-F.log(F.greatest(F.col("k") / F.col("m"), F.lit(EPS)))).alias("c"))
    return scoremin(placed.join(F.broadcast(cost), ["f", "b"]).groupBy("entity_id").agg(F.sum("c").alias("raw")), "raw")


def kernel_density(events: DataFrame, **sizes: int) -> DataFrame:
    """-log of a Gaussian kernel density over all entities, Scott's bandwidth; 16
    entities at least. ``sizes`` are those of the index."""
    matrix = cut(feature_matrix(events))
    n = matrix.count()
    if n < 16:
        return _nothing(matrix)
    index = density.build(matrix, FEATURES, 1, **sizes)
    found = density.kernel_sums(index, float(n ** (-1.0 / (len(FEATURES) + 4))))
    return scoremin(index.members.join(found, "pid").select("entity_id", (-F.log(F.col("total") / n)).alias("raw")), "raw")


def one_class_svm(events: DataFrame, nu: float = 0.05, width: int = 256, seed: int = 0) -> DataFrame:
    """One-class SVM on random Fourier features of an RBF kernel, by averaged
    subgradient steps: stands for the exact solver. Twelve entities at least."""
    matrix = feature_matrix(events)
    x = _sample(matrix)
    if len(x) < 12:
        return _nothing(matrix)
    rng = np.random.default_rng(seed)
    gamma = 1.0 / (x.shape[1] * max(x.var(), EPS))
    way, shift = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], width)), rng.uniform(0, 2 * np.pi, width)
    lift = lambda rows: np.sqrt(2.0 / width) * np.cos(rows @ way + shift)
    z = lift(x)
    w, rho = z.mean(axis=0), 0.0
    for step in range(1, 301):
        rho = np.quantile(z @ w, nu)
        inside = z @ w < rho
        w = w - (1.0 / (step + 10)) * (w - z[inside].mean(axis=0) if inside.any() else w)
    return _apply(matrix, lambda rows: rho - lift(rows) @ w)


def autoencoder(events: DataFrame, hidden: tuple[int, int] = (16, 8), steps: int = 600, seed: int = 0) -> DataFrame:
    """Reconstruction error of a small tanh network; 16 entities at least."""
    matrix = feature_matrix(events)
    x = _sample(matrix)
    if len(x) < 16:
        return _nothing(matrix)
    rng = np.random.default_rng(seed)
    sizes = [x.shape[1], hidden[0], hidden[1], hidden[0], x.shape[1]]
    w = [rng.normal(0, 1 / np.sqrt(a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]

    def forward(rows: np.ndarray) -> list[np.ndarray]:
        acts = [rows]
        for i, a in enumerate(w):
            y = acts[-1] @ a
            acts.append(np.tanh(y) if i < len(w) - 1 else y)
        return acts

    for step in range(1, steps + 1):
        rows = x[rng.integers(0, len(x), min(128, len(x)))]
        acts = forward(rows)
        d = 2 * (acts[-1] - rows) / len(rows)
        for i in reversed(range(len(w))):
            g = acts[i].T @ d
            d = (d @ w[i].T) * (1 - acts[i] ** 2) if i else d
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.001 * (g * g - v[i])
            w[i] = w[i] - 0.005 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return _apply(matrix, lambda rows: ((forward(rows)[-1] - rows) ** 2).mean(axis=1))


def gaussian_mixture(events: DataFrame, seed: int = 0) -> DataFrame:
    """-log likelihood under a mixture fitted by ``pyspark.ml``; 20 at least."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    matrix = feature_matrix(events)
    n = matrix.count()
    if n < 20:
        return _nothing(matrix)
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(matrix)
    model = GaussianMixture(k=min(5, max(2, n // 30)), seed=seed, maxIter=30).fit(data)
    parts = []
    for weight, g in zip(model.weights, model.gaussians, strict=True):
        cov = g.cov.toArray() + 1e-6 * np.eye(len(FEATURES))
        parts.append((np.log(max(weight, 1e-300)) - 0.5 * np.linalg.slogdet(2 * np.pi * cov)[1], g.mean.toArray(), np.linalg.inv(cov)))

    def raw(rows: np.ndarray) -> np.ndarray:
        logs = np.stack([c - 0.5 * np.einsum("ij,jk,ik->i", rows - mu, inv, rows - mu) for c, mu, inv in parts])
        top = logs.max(axis=0)
        return -(top + np.log(np.exp(logs - top).sum(axis=0)))

    return _apply(matrix, raw)
