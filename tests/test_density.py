"""The pivot index against brute force over all entities."""

import numpy as np
import pandas as pd
import pytest

from tidewatch.operators import density

NAMES = ["a", "b", "c", "d"]


def _points(n, seed, copies=0):
    """Clusters of unlike spread, scattered points, and a large group of copies."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (n // 5, 4)) for c, s in ((0, 0.3), (6, 0.05), (-7, 1.0), ([0, 9, 0, 9], 0.2))] + [rng.uniform(-20, 20, (n - 4 * (n // 5), 4))])
    x[: n // 20] = x[0]
    x[-3:] = x[-4] + [0.5, 0, 0, 0]
    return np.concatenate([x, np.repeat(x[:1] + 3, copies, axis=0)])


def _matrix(spark, x):
    return spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(entity_id=np.arange(len(x)) * 7 % (10 * len(x)))).repartition(4)


@pytest.mark.parametrize("sizes", [{"cells": 25, "points": 8}, {}])
def test_nearest(spark, sizes):
    x, k = _points(600, 3, 200), 6
    ids = np.arange(len(x)) * 7 % (10 * len(x))
    d = density.distances(x, x)
    index = density.build(_matrix(spark, x), NAMES, k + 1, **sizes)
    got = {r["entity_id"]: r for r in density.nearest(index, k).collect()}
    assert len(got) == len(x)
    for i, e in enumerate(ids.tolist()):
        want = sorted((a, b) for a, b in zip(d[i].tolist(), ids.tolist(), strict=True) if b != e)[:k]
        assert [(a, b) for a, b in zip(got[e]["dists"], got[e]["ids"], strict=True)] == want


@pytest.mark.parametrize("sizes", [{"cells": 30, "points": 8}, {}])
def test_kernel_sums(spark, sizes):
    x = _points(600, 4, 100)
    index = density.build(_matrix(spark, x), NAMES, 1, **sizes)
    rows = index.members.join(density.kernel_sums(index, 0.6), "pid").collect()
    want = np.exp(-(density.distances(x, x) ** 2) / (2 * 0.36)).sum(axis=1)
    assert {r["entity_id"]: r["total"] for r in rows} == pytest.approx(dict(zip((np.arange(len(x)) * 7).tolist(), want, strict=True)), rel=1e-10)


def test_blocks_are_sent_by_groups(spark, monkeypatch):
    """However many pairs of blocks meet, a block is sent once for each group."""
    x = _points(600, 5)
    index = density.build(_matrix(spark, x), NAMES, 7, cells=40, points=8)
    monkeypatch.setattr(density, "LEAST_GROUPS", 3)
    n = len(index.sizes)
    told = density._each_pair(
        index, lambda a: np.arange(n), index.blocks.select("block"),
        lambda mine, others: [{"a": mine["block"], "b": o["block"], "sent": len(others)} for o in others], "a long, b long, sent long",
    ).toPandas()
    assert len(told) == n * n == len(told.drop_duplicates(["a", "b"])) and n > 30
    assert told["sent"].min() >= n // 3 and len(told.drop_duplicates(["a", "sent"])) <= 3 * n


def test_few_entities(spark):
    none = _matrix(spark, np.zeros((1, 4))).limit(0)
    assert density.build(none, NAMES, 3) is None
    two = density.build(_matrix(spark, np.array([[0.0] * 4, [0, 0, 3, 4]])), NAMES, 21)
    assert sorted((r["entity_id"], list(r["ids"]), list(r["dists"])) for r in density.nearest(two, 20).collect()) == [(0, [7], [5.0]), (7, [0], [5.0])]


def test_most_pairs_are_skipped(spark):
    """100,000 clustered entities: the bounds leave under a tenth of the pairs."""
    rng = np.random.default_rng(8)
    x = (rng.uniform(-10, 10, (40, 4))[rng.integers(0, 40, 100_000)] + rng.normal(0, 0.4, (100_000, 4))).astype(float)
    index = density.build(_matrix(spark, x), NAMES, 1)
    width = len(x) ** (-1 / 8)
    reach = np.full(len(index.sizes), width * np.sqrt(2 * np.log(len(x) / 1e-12)))
    assert index.sizes.sum() == len(x) and index.share(reach) < 0.1
