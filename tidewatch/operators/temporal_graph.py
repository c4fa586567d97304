"""Entities whose links a temporal graph model can't rebuild.

Messages pass along sparse edges within time buckets: two joins give every node,
for each bucket in which it acts, its own features, those around it and those two
steps away, a row of fixed width; no matrix of all nodes is made. Two layers shared
by all buckets turn such a row into a vector, vectors are averaged over buckets, and
the product of two nodes' vectors tells whether they are linked. Layers are fitted on
a bounded sample of linked and unlinked pairs and applied to all nodes and edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.lineage import cut
from tidewatch.functions.scaling import EPS, scoremin
from tidewatch.operators.features import build_features

#: Features of a node.
NODE = ["n_events", "fan_in", "fan_out", "amt_total", "amt_mean", "amt_std", "hour_entropy", "night_ratio"]
WIDTH = 3 * len(NODE)


@dataclass(frozen=True)
class Fit:
    """``pairs`` linked pairs at most, and as many unlinked, are fitted to; ``refs``
    nodes stand for all that a node is not linked to when it is scored."""

    buckets: int = 8
    hidden: int = 16
    pairs: int = 4096
    refs: int = 256
    epochs: int = 150
    rate: float = 0.01
    seed: int = 0


@dataclass
class Layers:
    w1: np.ndarray
    w2: np.ndarray
    bias: float = 0.0

    @classmethod
    def new(cls, fit: Fit) -> Layers:
        rng = np.random.default_rng(fit.seed)
        return cls(rng.normal(size=(WIDTH, fit.hidden)) / WIDTH**0.5, rng.normal(size=(fit.hidden, fit.hidden)) / fit.hidden**0.5)

    def vectors(self, z: np.ndarray) -> np.ndarray:
        """(nodes, hidden) of (nodes, buckets, WIDTH)."""
        return np.maximum(np.maximum(z @ self.w1, 0) @ self.w2, 0).mean(axis=1)

    def gradients(self, z: np.ndarray, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        """Cross-entropy of pairs (a, b) of the nodes, and its slopes."""
        first = np.maximum(z @ self.w1, 0)
        second = np.maximum(first @ self.w2, 0)
        e = second.mean(axis=1)
        logit = (e[a] * e[b]).sum(axis=1) + self.bias
        loss = float((np.logaddexp(0, logit) - linked * logit).mean())
        slope = (1 / (1 + np.exp(-logit)) - linked) / len(a)
        down = np.zeros_like(e)
        np.add.at(down, a, slope[:, None] * e[b])
        np.add.at(down, b, slope[:, None] * e[a])
        two = (down[:, None, :] / z.shape[1]) * (second > 0)
        one = (two @ self.w2.T) * (first > 0)
        return loss, np.einsum("ntf,nth->fh", z, one), np.einsum("ntf,nth->fh", first, two), float(slope.sum())


def train(z: np.ndarray, a: np.ndarray, b: np.ndarray, linked: np.ndarray, fit: Fit) -> Layers:
    """Layers after ``epochs`` full steps of Adam."""
    model = Layers.new(fit)
    moments = [[np.zeros_like(model.w1)] * 2, [np.zeros_like(model.w2)] * 2, [0.0, 0.0]]
    for step in range(1, fit.epochs + 1):
        slopes = model.gradients(z, a, b, linked)[1:]
        values = [model.w1, model.w2, model.bias]
        for i, g in enumerate(slopes):
            m, v = 0.9 * moments[i][0] + 0.1 * g, 0.999 * moments[i][1] + 0.001 * g**2
            moments[i] = [m, v]
            values[i] = values[i] - fit.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        model.w1, model.w2, model.bias = values[0], values[1], float(values[2])
    return model


def timed_edges(events: DataFrame, buckets: int) -> DataFrame:
    """(u, v, t, p): how much of what u does in bucket t is with v. Buckets hold
    alike many events (to one in 10,000); undated events are in the first."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', timestamp)")
    known = events.where("entity_id is not null and counterparty_id is not null").select(F.col("entity_id").alias("u"), F.col("counterparty_id").alias("v"), at.alias("at"))
    cuts = known.agg(F.percentile_approx("at", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    t = sum((F.coalesce(F.col("at") > F.lit(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    counts = known.groupBy("u", "v", t.alias("t")).agg(F.count("*").alias("n"))
    total = counts.groupBy("u", "t").agg(F.sum("n").alias("all"))
    return cut(counts.join(total, ["u", "t"]).select("u", "v", "t", (F.col("n") / F.col("all")).alias("p")))


def node_features(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, x): standardised features of all nodes; who never acts has zeros."""
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    own = build_features(events).select(F.col("entity_id").alias("node"), *NODE)
    rows = cut(nodes.join(own, "node", "left").na.fill(0.0))
    stats = rows.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in NODE)).first()
    scaled = [((F.col(c) - F.lit(stats[c]["m"] or 0.0)) / F.lit((stats[c]["s"] or 0.0) + EPS)).alias(c) for c in NODE]
    return cut(rows.select("node", F.array(*scaled).alias("x")))


def states(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, x, z): ``z`` has a row (own, one step, two steps) for each bucket in
    which the node acts, at most one a bucket."""
    d = range(len(NODE))
    summed = lambda c: F.array(*(F.sum(F.col("p") * F.col(c)[i]) for i in d))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    of = lambda name, x: nodes.select(F.col("node").alias(name), F.col("x").alias(x))
    near = edges.join(of("v", "xv"), "v").groupBy("u", "t").agg(summed("xv").alias("around"))
    one = cut(near.join(of("u", "x"), "u").select("u", "t", "x", plus("x", "around").alias("one")))
    # Who does not act in a bucket passes its own features on.
    there = edges.join(one.select(F.col("u").alias("v"), "t", F.col("one").alias("ov")), ["v", "t"], "left").join(of("v", "xv"), "v")
    far = there.select("u", "t", "p", F.coalesce("ov", "xv").alias("m")).groupBy("u", "t").agg(summed("m").alias("beyond"))
    rows = one.join(far, ["u", "t"]).select(F.col("u").alias("node"), F.concat("x", "one", plus("one", "beyond")).alias("z"))
    held = rows.groupBy("node").agg(F.collect_list("z").alias("z"))
    return cut(nodes.join(held, "node", "left").select("node", "x", F.coalesce("z", F.array().cast("array<array<double>>")).alias("z")))


def padded(x: list, z: list, buckets: int) -> np.ndarray:
    """(nodes, buckets, WIDTH): a bucket without acts is the node's own features."""
    out = np.repeat(np.tile(np.array(list(x), float).reshape(len(x), -1), (1, 3))[:, None, :], buckets, axis=1)
    for i, rows in enumerate(z):
        if len(rows):
            out[i, : len(rows)] = np.stack([np.asarray(r, float) for r in rows])
    return out


def _sample(edges: DataFrame, held: DataFrame, fit: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """States of a bounded set of nodes, and linked and unlinked pairs among them."""
    chosen = edges.select("u", "v").where("u <> v").distinct().orderBy(F.xxhash64("u", "v", F.lit(fit.seed)), "u", "v").limit(fit.pairs)
    pairs = [(r["u"], r["v"]) for r in chosen.collect()]
    ids = sorted({x for p in pairs for x in p})
    wanted = chosen.select(F.col("u").alias("node")).union(chosen.select("v")).distinct()
    rows = {r["node"]: r for r in held.join(F.broadcast(wanted), "node", "left_semi").collect()}
    at = {node: i for i, node in enumerate(ids)}
    rng, n = np.random.default_rng(fit.seed), len(ids)
    a, b = (np.array([at[p[k]] for p in pairs], int) for k in (0, 1))
    c, d = (rng.integers(0, n, len(pairs)) for _ in range(2)) if n else (a, b)
    # Of the drawn pairs those that the sample knows to be linked are left out.
    apart = ~np.isin(c * n + d, np.concatenate([a * n + b, b * n + a])) & (c != d)
    z = padded([rows[i]["x"] for i in ids], [rows[i]["z"] for i in ids], fit.buckets) if n else np.zeros((0, fit.buckets, WIDTH))
    return z, np.concatenate([a, c[apart]]), np.concatenate([b, d[apart]]), np.concatenate([np.ones(len(a)), np.zeros(apart.sum())])


def embedded(events: DataFrame, fit: Fit = Fit()) -> tuple[DataFrame, DataFrame, float] | None:
    """(node, e) of all nodes, the distinct edges (u, v), and the bias; None with
    fewer than eight nodes or twenty timed edges."""
    edges = timed_edges(events, fit.buckets)
    nodes = node_features(events, edges)
    if nodes.limit(8).count() < 8 or edges.limit(20).count() < 20:
        return None
    held = states(edges, nodes)
    model = train(*_sample(edges, held, fit), fit)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 1024):
                f = whole.iloc[at : at + 1024]
                yield pd.DataFrame({"node": f["node"], "e": list(model.vectors(padded(f["x"].tolist(), f["z"].tolist(), fit.buckets)))})

    kind = held.schema["node"].dataType.simpleString()
    return cut(held.mapInPandas(run, f"node {kind}, e array<double>")), cut(edges.select("u", "v").distinct()), model.bias


def _linked(a, b, bias: float):
    """The model's probability that two vectors are linked."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return 1 / (1 + F.exp(-(dot + F.lit(bias))))


def edge_surprise(vectors: DataFrame, edges: DataFrame, bias: float) -> DataFrame:
    """(u, v, surprise): squared distance of each edge's probability from one."""
    of = lambda node, e: vectors.select(F.col("node").alias(node), F.col("e").alias(e))
    met = edges.join(of("u", "eu"), "u").join(of("v", "ev"), "v")
    return met.select("u", "v", F.pow(1 - _linked(F.col("eu"), F.col("ev"), bias), 2).alias("surprise"))


def network_tgn(events: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """(entity_id, score) of all nodes, counterparties too: mean squared error over
    the node's row of the graph. Linked nodes, itself among them, are measured one
    by one; all others by ``fit.refs`` of them, which are all if there are no more."""
    found = embedded(events, fit)
    if found is None:
        return events.select("entity_id", F.lit(0.0).alias("score")).limit(0)
    vectors, edges, bias = found
    n = vectors.count()
    refs = cut(vectors.orderBy(F.xxhash64("node", F.lit(fit.seed)), "node").limit(fit.refs))
    own = edge_surprise(vectors, edges.where("u <> v"), bias).groupBy(F.col("u").alias("node")).agg(F.sum("surprise").alias("linked"), F.count("*").alias("deg"))
    table = refs.select(F.collect_list(F.struct("node", "e")).alias("refs"))
    known = edges.where("u <> v").join(F.broadcast(refs.select(F.col("node").alias("v"))), "v", "left_semi").groupBy(F.col("u").alias("node")).agg(F.collect_list("v").alias("known"))
    rows = vectors.join(own, "node", "left").join(known, "node", "left").join(F.broadcast(table))
    known_or_none = F.coalesce("known", F.array().cast(known.schema["known"].dataType))
    others = F.filter("refs", lambda r: (r["node"] != F.col("node")) & ~F.array_contains(known_or_none, r["node"]))
    rows = rows.withColumn("others", others).withColumn("known", known_or_none)
    far = F.aggregate("others", F.lit(0.0), lambda acc, r: acc + F.pow(_linked(r["e"], F.col("e"), bias), 2))
    mean = F.when(F.size("others") > 0, far / F.size("others")).otherwise(0.0)
    deg, own_error = F.coalesce("deg", F.lit(0)), F.pow(1 - _linked(F.col("e"), F.col("e"), bias), 2)
    raw = (own_error + F.coalesce("linked", F.lit(0.0)) + (n - 1 - deg) * mean) / n
    return scoremin(rows.select(F.col("node").alias("entity_id"), raw.alias("raw")), "raw")
