"""Neighbours and kernel sums over all entities by a pivot index.

Entities with equal features are one point. Points go to the nearest of at most
``CELLS`` centres, and a crowded cell is split, so that there are at most some
thousand blocks. For each block the least and greatest distance to each of up to
``PIVOTS`` pivots is kept; by the triangle inequality two blocks are at least as
far apart as these ranges are for any pivot. Pairs of blocks that this bound
excludes are skipped. Tasks take two groups of blocks each and measure the pairs
left between them; rows too far from the whole other block are skipped too.
The driver sees centres and ranges alone, whose number is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.functions.lineage import cut

#: Centres at most, points a cell should have at least, and pivots of the bounds.
CELLS, POINTS, PIVOTS = 1024, 256, 128
#: Blocks next to a block that are met first, to learn how far neighbours are.
FIRST = 3
#: Points of a group of blocks, and groups where there are fewer points.
SIDE, LEAST_GROUPS = 16_384, 8


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between rows, summed feature by feature."""
    total = np.zeros((len(x), len(y)))
    for f in range(x.shape[1]):
        total += (x[:, f, None] - y[None, :, f]) ** 2
    return np.sqrt(total)


@dataclass
class Index:
    """``members`` is (pid, entity_id), ``blocks`` one row a block: its points with
    the lowest ids and the number of entities of each; the rest is one row a block
    in the order of block numbers."""

    members: DataFrame
    blocks: DataFrame
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray

    def apart(self, a: int) -> np.ndarray:
        """Lower bounds of the distances from points of ``a`` to those of each block."""
        return np.maximum(self.low[a] - self.high, self.low - self.high[a]).max(axis=1).clip(0)

    def pairs(self, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each block those whose bound is within its reach."""
        for a in range(len(self.sizes)):
            yield a, np.flatnonzero(self.apart(a) <= reach[a])

    def share(self, reach: np.ndarray) -> float:
        """The share of all pairs of points that lie in pairs of blocks kept."""
        return sum(float(self.sizes[a]) * self.sizes[b].sum() for a, b in self.pairs(reach)) / float(self.sizes.sum()) ** 2


def build(matrix: DataFrame, features: list[str], lowest: int, cells: int = CELLS, points: int = POINTS) -> Index | None:
    """The index over (entity_id, features); ``lowest`` ids of each point are kept.
    None without entities."""
    kind = matrix.schema["entity_id"].dataType.simpleString()
    x = F.array(*(F.col(c).cast("double") + 0.0 for c in features))
    members = cut(matrix.select("entity_id", x.alias("x")).withColumn("pid", F.md5(F.concat_ws(",", F.col("x").cast("array<string>")))))
    # The lowest ids of a point are picked before the shuffle, however many it has.
    nth = F.row_number().over(Window.partitionBy("pid").orderBy("entity_id"))
    ids = members.select("pid", "entity_id", nth.alias("nth")).where(F.col("nth") <= lowest).groupBy("pid").agg(F.array_sort(F.collect_list("entity_id")).alias("ids"))
    counts = members.groupBy("pid").agg(F.count("*").alias("n"), F.first("x").alias("x"))
    pts = cut(counts.join(ids, "pid"))
    total = pts.count()
    if not total:
        return None
    wanted = int(np.clip(total // points, 1, cells))
    centres = np.array([r["x"] for r in pts.orderBy(F.xxhash64("pid"), "pid").select("x").limit(wanted).collect()])
    pivots = centres[:PIVOTS]

    def nearest_centre(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 1024):
                f = whole.iloc[at : at + 1024]
                yield f.assign(cell=distances(np.stack(f["x"]), centres).argmin(axis=1).astype(np.int64))

    celled = cut(pts.mapInPandas(nearest_centre, f"pid string, n long, x array<double>, ids array<{kind}>, cell long"))
    crowd = celled.groupBy("cell").count().toPandas().sort_values("cell")  # at most ``cells`` rows
    parts = -(-crowd["count"] // (4 * max(points, total // cells)))
    table = pd.DataFrame({"cell": crowd["cell"], "first": parts.cumsum() - parts, "parts": parts})
    table = matrix.sparkSession.createDataFrame([tuple(map(int, r)) for r in table.itertuples(index=False)], "cell long, first long, parts long")
    placed = celled.join(F.broadcast(table), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("pid"), F.col("parts")))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pid")
        rows = np.stack(f["x"])
        d, mean = distances(rows, pivots), rows.mean(axis=0)
        one = {
            "block": f["block"].iloc[0], "pids": f["pid"].tolist(), "ids": [list(i) for i in f["ids"]], "n": f["n"].tolist(), "x": rows.ravel().tolist(),
            "low": d.min(axis=0).tolist(), "high": d.max(axis=0).tolist(), "mean": mean.tolist(), "radius": float(distances(rows, mean[None]).max()),
        }
        return pd.DataFrame([one])

    schema = f"block long, pids array<string>, ids array<array<{kind}>>, n array<long>, x array<double>, low array<double>, high array<double>, mean array<double>, radius double"
    blocks = cut(placed.groupBy("block").applyInPandas(pack, schema))
    seen = blocks.select("block", "low", "high", "mean", "radius", F.size("n").alias("size")).toPandas().sort_values("block")
    return Index(
        members.select("pid", "entity_id"), blocks.drop("low", "high"), *(np.array(seen[c].tolist()) for c in ("low", "high", "mean")),
        seen["radius"].to_numpy(), seen["size"].to_numpy(),
    )


def _each_pair(index: Index, chosen: Callable[[int], np.ndarray], states: DataFrame, visit: Callable, schema: str) -> DataFrame:
    """``visit(mine, others)`` for every block and those ``chosen`` for it; ``mine``
    is a row of the blocks with the columns of ``states`` (block, ...).

    Blocks are dealt into groups of about ``SIDE`` points. A task has two groups,
    so a block is sent once for each group that it meets, not for each block, and
    gives one result for all blocks of a group."""
    spark = states.sparkSession
    total = len(index.sizes)
    n = min(total, max(LEAST_GROUPS, -(-int(index.sizes.sum()) // SIDE)))
    group = np.arange(total) * n // total

    met = {(int(group[a]), int(g)) for a in range(total) for g in np.unique(group[np.asarray(chosen(a), np.int64)])}
    tasks = spark.createDataFrame([(i, *x) for i, x in enumerate(sorted(met))], "task long, ga long, gb long")  # at most n * n rows
    groups = spark.createDataFrame([(i, int(g)) for i, g in enumerate(group)], "block long, grp long")
    plain = index.blocks.join(F.broadcast(groups), "block")
    extra = [c for c in states.columns if c != "block"]
    columns = ["task", F.lit(0).alias("side"), *index.blocks.columns, *extra]
    left = plain.join(states, "block").join(F.broadcast(tasks), F.col("grp") == F.col("ga")).select(*columns)
    none = [F.lit(None).cast(states.schema[c].dataType).alias(c) for c in extra]
    right = plain.join(F.broadcast(tasks), F.col("grp") == F.col("gb")).select("task", F.lit(1).alias("side"), *index.blocks.columns, *none)

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        others = {r["block"]: r for r in rows if r["side"]}
        found = []
        for mine in (r for r in rows if not r["side"]):
            here = [others[b] for b in np.asarray(chosen(mine["block"])).tolist() if b in others]
            if here:
                found += visit(mine, here)
        return pa.Table.from_pylist(found, schema=arrow)

    # A number of its own, so that small tables are not laid together in one task.
    dealt = left.unionByName(right).repartition(max(1, len(met)), "task")
    return dealt.groupBy("task").applyInArrow(meet, schema)


def _rows(block: dict) -> np.ndarray:
    return np.array(block["x"]).reshape(len(block["n"]), -1)


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one product, and a bound of their error: rows are
    taken from the mean of ``y``, so that little cancels."""
    x, y = x - (mean := y.mean(axis=0)), y - mean
    a, b = (x * x).sum(axis=1), (y * y).sum(axis=1)
    got = x @ y.T
    got *= -2
    got += a[:, None]
    got += b[None]
    return np.maximum(got, 0, out=got), 1e-13 * (x.shape[1] + 4) * float(a.max(initial=0) + b.max(initial=0) + (mean * mean).sum())


def _within(x: np.ndarray, other: dict, reach: np.ndarray) -> np.ndarray:
    """Rows of ``x`` that may have a point of the other block within their reach."""
    far = distances(x, np.array(other["mean"])[None]).ravel() - other["radius"]
    return np.flatnonzero(far <= reach + 1e-9 * (1 + np.abs(far)))


def kernel_sums(index: Index, width: float, lost: float = 1e-12) -> DataFrame:
    """(pid, total): sum of exp(-d^2 / (2 width^2)) over all entities. Its own
    point alone gives a total of 1; points so far that all entities at their
    distance would add under ``lost`` are left out."""
    reach = float(width * np.sqrt(2 * np.log(max(index.members.count(), 2) / lost)))

    def visit(mine: dict, others: list[dict]) -> list[dict]:
        x, sums = _rows(mine), np.zeros(len(mine["n"]))
        for other in others:
            y, n = _rows(other), np.array(other["n"], float)
            near = _within(x, other, np.full(len(x), reach))
            for at in range(0, len(near), 256):
                rows = near[at : at + 256]
                d2 = _squares(x[rows], y)[0]
                d2 *= -1 / (2 * width**2)
                sums[rows] += np.exp(d2, out=d2) @ n
        return [{"pid": p, "part": t} for p, t in zip(mine["pids"], sums.tolist(), strict=True)]

    bare = _bare(index)
    parts = _each_pair(index, lambda a: np.flatnonzero(bare.apart(a) <= reach), index.blocks.select("block"), visit, "pid string, part double")
    return parts.groupBy("pid").agg(F.sum("part").alias("total"))


def _bare(index: Index) -> Index:
    """The ranges without the tables, as tasks take them."""
    return Index(None, None, index.low, index.high, index.mean, index.radius, index.sizes)


def nearest(index: Index, k: int) -> DataFrame:
    """(entity_id, ids, dists): the ``k`` nearest other entities, nearest first; of
    equal distances the lower id. The index holds at least k + 1 ids a point."""
    kind = index.members.schema["entity_id"].dataType.simpleString()
    cand = f"array<struct<d: double, id: {kind}>>"
    schema = f"block long, pid string, near {cand}"
    bare = _bare(index)

    def visit(mine: dict, others: list[dict]) -> list[dict]:
        x = _rows(mine)
        reach = np.array(mine["reach"], float) if mine.get("reach") is not None else np.full(len(x), np.inf)
        best: list[list] = [[] for _ in x]
        middle = x.mean(axis=0)
        for other in sorted(others, key=lambda o: float(((np.array(o["mean"]) - middle) ** 2).sum())):
            y = _rows(other)
            rows = _within(x, other, reach)
            for at in range(0, len(rows), 256):
                mine_rows = rows[at : at + 256]
                d2, slip = _squares(x[mine_rows], y)
                # A point has an id at least: k + 1 points are enough.
                last = np.partition(d2, k, axis=1)[:, k] if d2.shape[1] > k + 1 and np.isinf(reach[mine_rows]).any() else np.inf
                limit = np.minimum(last, reach[mine_rows] ** 2 * (1 + 1e-12)) + 2 * slip
                r, c = np.nonzero(d2 <= limit[:, None])
                exact = np.zeros(len(r))
                for f in range(x.shape[1]):
                    exact += (x[mine_rows[r], f] - y[c, f]) ** 2
                exact = np.sqrt(exact)
                keep = exact <= reach[mine_rows[r]]
                r, c, exact = r[keep], c[keep], exact[keep]
                cuts = np.flatnonzero(np.diff(r)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(r)], strict=True):
                    if lo == hi:
                        continue
                    i = int(mine_rows[r[lo]])
                    new = [(d, e) for d, j in zip(exact[lo:hi].tolist(), c[lo:hi].tolist(), strict=True) for e in other["ids"][j]]
                    best[i] = sorted(best[i] + new)[: k + 1]
                    if len(best[i]) > k:
                        reach[i] = min(reach[i], best[i][k][0])
        return [{"block": mine["block_no"], "pid": p, "near": [{"d": d, "id": e} for d, e in near]} for p, near in zip(mine["pids"], best, strict=True) if near]

    def merged(found: DataFrame) -> DataFrame:
        # Of each pair of blocks at most k + 1 within the reach known so far.
        near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1)
        return cut(found.groupBy("block", "pid").agg(near.alias("near")))

    def first(a: int) -> np.ndarray:
        order = np.argsort(((bare.mean - bare.mean[a]) ** 2).sum(axis=1), kind="stable")
        return np.unique(np.append(order[: FIRST + 1], a))

    numbered = index.blocks.select("block", F.col("block").alias("block_no"))
    some = merged(_each_pair(index, first, numbered, visit, schema))
    reach = F.when(F.size("near") > k, F.element_at("near", k + 1)["d"]).otherwise(F.lit(float("inf")))
    known = some.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pid", reach.alias("reach")))).alias("x"))
    known = cut(known.select("block", F.col("block").alias("block_no"), F.col("x.reach").alias("reach")))
    far = known.select("block", F.array_max("reach").alias("far")).toPandas().sort_values("block")["far"].to_numpy()

    def rest(a: int) -> np.ndarray:
        return np.setdiff1d(np.flatnonzero(bare.apart(a) <= far[a]), first(a))

    found = merged(some.unionByName(_each_pair(index, rest, known, visit, schema)))
    own = F.filter("near", lambda c: c["id"] != F.col("entity_id"))
    met = index.members.join(found.select("pid", "near"), "pid").select("entity_id", F.slice(own, 1, k).alias("x"))
    return met.select("entity_id", F.col("x.id").alias("ids"), F.col("x.d").alias("dists"))
