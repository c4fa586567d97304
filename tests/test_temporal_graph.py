"""The temporal graph model: gradients, messages, errors, a planted clique."""

import datetime
import itertools
import random

import numpy as np
import pytest

from tidewatch.operators import temporal_graph as tg

SCHEMA = "event_id long, entity_id long, source string, event_type string, timestamp timestamp_ntz, amount double, counterparty_id long, direction string"


def test_gradients():
    rng = np.random.default_rng(2)
    model, z = tg.Layers.new(tg.Fit(hidden=5)), rng.normal(size=(7, 3, tg.WIDTH))
    a, b, y = rng.integers(0, 7, 20), rng.integers(0, 7, 20), rng.integers(0, 2, 20).astype(float)
    _, g1, g2, gb = model.gradients(z, a, b, y)
    for w, g in ((model.w1, g1), (model.w2, g2)):
        for at in np.argwhere(np.abs(g) >= np.sort(np.abs(g).ravel())[-4]):
            at, old = tuple(at), w[tuple(at)]
            up, down = (model.gradients(z, a, b, y)[0] for w[at] in (old + 1e-6, old - 1e-6))
            w[at] = old
            assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-4)
    model.bias += 1e-6
    up = model.gradients(z, a, b, y)[0]
    model.bias -= 2e-6
    assert (up - model.gradients(z, a, b, y)[0]) / 2e-6 == pytest.approx(gb, rel=1e-4)


def _events(seed=1):
    """Two groups that keep to themselves, and late a clique across them."""
    rng, rows = random.Random(seed), []
    start = datetime.datetime(2025, 1, 1)
    for _ in range(900):
        u = rng.randrange(40)
        v = rng.choice([x for x in range(40) if x // 20 == u // 20 and x != u])
        rows.append((u, v, rng.uniform(0, 100)))
    clique = [3, 11, 25, 33]
    for u, v in itertools.permutations(clique, 2):
        if u // 20 != v // 20:
            rows.append((u, v, 99.0))
    return [(i, u, "bank", "transaction", start + datetime.timedelta(days=d), 100.0 + u % 20 + 900 * (u // 20), v, "debit") for i, (u, v, d) in enumerate(rows)]


def test_messages_against_matrices(spark):
    events = spark.createDataFrame(_events(), SCHEMA)
    edges = tg.timed_edges(events, 4)
    nodes = tg.node_features(events, edges)
    x = {r["node"]: np.array(r["x"]) for r in nodes.collect()}
    ids = sorted(x)
    feats = np.array([x[i] for i in ids])
    assert np.allclose(feats.mean(axis=0), 0, atol=1e-9)
    a = np.zeros((4, len(ids), len(ids)))
    for r in edges.collect():
        a[r["t"], ids.index(r["u"]), ids.index(r["v"])] = r["p"]
    assert set(np.round(a.sum(axis=2).ravel(), 9)) <= {0.0, 1.0}
    for r in tg.states(edges, nodes).collect():
        i = ids.index(r["node"])
        want = []
        for t in range(4):
            if a[t, i].sum():
                full = a[t] + np.eye(len(ids))
                want.append(np.concatenate([feats[i], (full @ feats)[i], (full @ full @ feats)[i]]))
        got = sorted(map(tuple, r["z"]))
        assert np.allclose(got, sorted(map(tuple, want)))


def test_planted_late_clique_and_scores(spark):
    events = spark.createDataFrame(_events(), SCHEMA)
    fit = tg.Fit(buckets=4, refs=100)
    vectors, edges, bias = tg.embedded(events, fit)
    surprise = {(r["u"], r["v"]): r["surprise"] for r in tg.edge_surprise(vectors, edges, bias).collect()}
    across = [s for (u, v), s in surprise.items() if u // 20 != v // 20]
    within = [s for (u, v), s in surprise.items() if u // 20 == v // 20]
    assert len(across) == 8 and min(across) > np.quantile(within, 0.95)
    got = {r["entity_id"]: r["score"] for r in tg.network_tgn(events, fit).collect()}
    e = {r["node"]: np.array(r["e"]) for r in vectors.collect()}
    raw = {}
    for u in e:
        p = {v: 1 / (1 + np.exp(-(e[u] @ e[v] + bias))) for v in e}
        raw[u] = np.mean([((1 if v == u or (u, v) in surprise else 0) - p[v]) ** 2 for v in e])
    low, high = min(raw.values()), max(raw.values())
    assert got == pytest.approx({u: ((r - low) / (high - low + 1e-9)) ** 2 for u, r in raw.items()}, abs=1e-6)


def test_too_little(spark):
    few = spark.createDataFrame(_events()[:10], SCHEMA)
    assert tg.network_tgn(few).count() == 0 and tg.network_tgn(few.limit(0)).count() == 0
