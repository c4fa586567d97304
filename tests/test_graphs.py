"""Ranks and communities against dense and brute-force versions."""

import itertools

import numpy as np
import pytest

from tidewatch.operators import graph
from tidewatch.operators.communities import modularity_communities

EDGES = "src long, dst long, w double"


def _value(edges, label):
    m = sum(w for _, _, w in edges)
    inner = sum(w for a, b, w in edges if label[a] == label[b]) / m
    out, into = {}, {}
    for a, b, w in edges:
        out[label[a]] = out.get(label[a], 0) + w
        into[label[b]] = into.get(label[b], 0) + w
    return inner - sum(out.get(c, 0) * into.get(c, 0) for c in out) / m**2


def _partitions(items):
    if not items:
        yield []
        return
    first, *rest = items
    for p in _partitions(rest):
        yield [[first], *p]
        for i in range(len(p)):
            yield [*p[:i], [first, *p[i]], *p[i + 1 :]]


SMALL = {
    "two cliques": [(a, b, 1.0) for g in ((0, 1, 2, 3), (4, 5, 6, 7)) for a, b in itertools.combinations(g, 2)] + [(3, 4, 1.0)],
    "weights": [(0, 1, 5.0), (1, 0, 5.0), (2, 3, 4.0), (3, 2, 1.0), (1, 2, 0.5), (4, 5, 3.0), (5, 4, 3.0), (0, 4, 0.2)],
    "self loops": [(0, 0, 2.0), (0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (3, 4, 1.0), (4, 5, 1.0), (5, 3, 1.0), (2, 3, 0.3), (6, 6, 1.0)],
}


@pytest.mark.parametrize("name", SMALL)
def test_communities_against_all_partitions(spark, name):
    edges = SMALL[name]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    best = max((_value(edges, {x: i for i, g in enumerate(p) for x in g}), sorted(map(sorted, p))) for p in _partitions(nodes))
    rows, values = modularity_communities(spark.createDataFrame(edges, EDGES))
    label = {r["node"]: r["label"] for r in rows.collect()}
    groups = sorted(sorted(x for x in label if label[x] == c) for c in set(label.values()))
    assert groups == best[1] and all(min(g) == label[g[0]] for g in groups)
    assert values[-1] == pytest.approx(best[0]) and values == sorted(values)


def test_planted_cliques(spark):
    """Twelve groups of 6 to 9 nodes, a hub that all meet, and noise between."""
    rng = np.random.default_rng(4)
    group, edges, node = {}, [], 0
    for g in range(12):
        mine = range(node, node + 6 + g % 4)
        node += len(mine)
        group.update(dict.fromkeys(mine, g))
        edges += [(a, b, 1.0) for a, b in itertools.permutations(mine, 2) if rng.random() < 0.8]
    edges += [(int(a), int(b), 1.0) for a, b in rng.integers(0, node, (40, 2)) if a != b]
    edges += [(a, 999, 0.3) for a in range(0, node, 3)]
    edges = list({(a, b): (a, b, w) for a, b, w in edges}.values())
    rows, values = modularity_communities(spark.createDataFrame(edges, EDGES))
    label = {r["node"]: r["label"] for r in rows.collect()}
    assert values == sorted(values) and values[-1] == pytest.approx(_value(edges, label))
    assert values[-1] >= _value(edges, group | {999: 0}) - 1e-9
    for g in range(12):
        assert len({label[x] for x in group if group[x] == g}) == 1


def test_communities_of_nothing(spark):
    rows, values = modularity_communities(spark.createDataFrame([], EDGES))
    assert rows.count() == 0 and values == []


def test_small_communities_are_scored(spark):
    rows = []
    for base, size in ((0, 9), (20, 8), (40, 7), (60, 3)):
        rows += [(a, b, "debit") for a, b in itertools.permutations(range(base, base + size), 2)]
    events = spark.createDataFrame(rows * 2, "entity_id long, counterparty_id long, direction string")
    got = {r["entity_id"]: r["score"] for r in graph.community_motif(events).collect()}
    # Sizes 9, 8, 7, 3: the median is 7.5.
    assert got == pytest.approx({**dict.fromkeys(range(40, 47), 0.5 / 7.5), **dict.fromkeys(range(60, 63), 4.5 / 7.5)})
    assert graph.community_motif(events.where("entity_id < 3 and counterparty_id < 3")).count() == 0


def _dense(edges, damping=0.85):
    """Ranks as the solution of the linear system."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    at, n = {x: i for i, x in enumerate(nodes)}, len(nodes)
    p = np.zeros((n, n))
    for a, b, w in edges:
        p[at[b], at[a]] += w
    total = p.sum(axis=0)
    p = np.where(total > 0, p / np.where(total > 0, total, 1), 1 / n)
    return dict(zip(nodes, np.linalg.solve(np.eye(n) - damping * p, np.full(n, (1 - damping) / n)), strict=True))


@pytest.mark.parametrize("kind", ["random", "cycle", "star", "closed"])
def test_pagerank_against_a_dense_solve(spark, kind):
    rng = np.random.default_rng(9)
    edges = {
        "random": [(int(a), int(b), float(1 + a % 3)) for a, b in rng.integers(0, 60, (150, 2))],
        "cycle": [(i, (i + 1) % 30, 1.0) for i in range(30)] + [(0, 15, 2.0)],
        "star": [(i, 0, 1.0) for i in range(1, 40)],
        "closed": [(0, 1, 1.0), (1, 0, 1.0), (2, 0, 1.0), (3, 2, 4.0)],
    }[kind]
    got = {r["node"]: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, EDGES), 1e-6).collect()}
    want = _dense(edges)
    assert sum(got.values()) == pytest.approx(1) and sum(abs(got[x] - want[x]) for x in want) <= 1e-6
