"""Communities of a directed graph by modularity, level by level.

In a level nodes move to the neighbouring community that adds most modularity.
Nodes are dealt into two sets that move in turns, so that those who move see
totals that only their own set is changing; if the moves of a set together lose
modularity, fewer and fewer of them are made, at last the best alone, which can't.
When a level gains no more, its communities become the nodes of a weighted graph,
which is the next level. Edges are stored once a level; labels and totals are a
row a node or community, and joins split a node with very many edges at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.lineage import cut

#: Times that the moves of a set are halved before the best alone is made.
HALVINGS = 6


def _modularity(edges: DataFrame, comm: DataFrame, m: float) -> float:
    """Links within communities less those expected from degrees, as shares."""
    of = lambda c: comm.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    inner = edges.join(of("a"), "a").join(of("b"), "b").where("label_a = label_b").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inner"))
    totals = comm.groupBy("label").agg(F.sum("kout").alias("kout"), F.sum("kin").alias("kin")).agg(F.sum(F.col("kout") * F.col("kin")).alias("expected"))
    row = inner.join(F.broadcast(totals)).first()
    return row["inner"] / m - row["expected"] / m**2


def _moves(links: DataFrame, comm: DataFrame, m: float, mine) -> DataFrame:
    """(node, to, gain): where nodes that satisfy ``mine`` gain most, if anywhere."""
    totals = comm.groupBy("label").agg(F.sum("kout").alias("all_out"), F.sum("kin").alias("all_in"))
    at = comm.select(F.col("node").alias("v"), F.col("label").alias("to"))
    met = links.where(mine).join(at, "v").groupBy("node", "to").agg(F.sum("w").alias("l"))
    stay = comm.where(mine).select("node", F.col("label").alias("to"), F.lit(0.0).alias("l"))
    options = met.unionByName(stay).groupBy("node", "to").agg(F.sum("l").alias("l"))
    rows = options.join(comm, "node").join(totals.withColumnRenamed("label", "to"), "to")
    own = F.col("to") == F.col("label")
    rest = lambda total, k: F.col(total) - F.when(own, F.col(k)).otherwise(0.0)
    gain = F.col("l") / m - (F.col("kout") * rest("all_in", "kin") + F.col("kin") * rest("all_out", "kout")) / m**2
    best = rows.withColumn("gain", gain).groupBy("node").agg(
        F.max_by(F.struct("to"), F.struct("gain", own, -F.col("to"))).alias("x"), F.max("gain").alias("gain"), F.max(F.when(own, F.col("gain"))).alias("own"),
    )
    return best.select("node", "x.to", (F.col("gain") - F.col("own")).alias("gain")).where("gain > 1e-12")


def _moved(edges: DataFrame, comm: DataFrame, moves: DataFrame, m: float, before: float) -> tuple[DataFrame, float]:
    """The labels after as many of the moves as add modularity, and that."""
    for halving in range(HALVINGS + 1):
        made = moves.where(F.pmod(F.xxhash64("node", F.lit(-1)), F.lit(1 << halving)) == 0)
        if halving == HALVINGS:
            made = moves.orderBy(F.desc("gain"), "node").limit(1)
        elif halving and made.isEmpty():
            continue
        new = comm.join(made.select("node", "to"), "node", "left").select("node", F.coalesce("to", "label").alias("label"), "kout", "kin")
        new = cut(new)
        after = _modularity(edges, new, m)
        if after > before:
            return new, after
    return comm, before


def _level(edges: DataFrame, m: float, tolerance: float, sweeps: int, turn: int) -> tuple[DataFrame, float]:
    """(node, label) of one level and its modularity; ``edges`` is (a, b, w)."""
    ends = edges.select(F.col("a").alias("node"), F.col("w").alias("kout"), F.lit(0.0).alias("kin"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0.0).alias("kout"), F.col("w").alias("kin")))
    comm = cut(ends.groupBy("node").agg(F.sum("kout").alias("kout"), F.sum("kin").alias("kin")).select("node", F.col("node").alias("label"), "kout", "kin"))
    apart = edges.where("a <> b")
    links = apart.select(F.col("a").alias("node"), F.col("b").alias("v"), "w").union(apart.select("b", "a", "w"))
    links = cut(links.groupBy("node", "v").agg(F.sum("w").alias("w")))
    value = _modularity(edges, comm, m)
    for sweep in range(sweeps):
        start = value
        for half in (0, 1):
            mine = F.pmod(F.xxhash64("node", F.lit(2 * sweeps * turn + sweep)), F.lit(2)) == half
            moves = cut(_moves(links, comm, m, mine))
            if not moves.isEmpty():
                comm, value = _moved(edges, comm, moves, m, value)
        if value - start <= tolerance:
            break
    return comm.select("node", "label"), value


def modularity_communities(e: DataFrame, tolerance: float = 1e-4, sweeps: int = 12, levels: int = 12) -> tuple[DataFrame, list[float]]:
    """(node, label) for each node of ``e(src, dst, w)``, and the modularity at the
    end of each level, which never falls. A community's label is its least node. A
    level ends when both sets together add no more than ``tolerance``, or after
    ``sweeps``; the last level is one that merges nothing. Nodes are integers."""
    edges = cut(e.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.sum("w").cast("double").alias("w")))
    m = edges.agg(F.sum("w")).first()[0]
    if not m:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label")), []
    label, values = None, []
    for turn in range(levels):
        step, value = _level(edges, m, tolerance, sweeps, turn)
        values.append(value)
        sizes = step.agg(F.count("*").alias("nodes"), F.count_distinct("label").alias("labels")).first()
        over = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        label = step if label is None else cut(label.join(over, "label").select("node", F.col("next").alias("label")))
        if sizes["labels"] == sizes["nodes"]:
            break
        of = lambda c, name: step.select(F.col("node").alias(c), F.col("label").alias(name))  # noqa: B023, E731
        merged = edges.join(of("a", "x"), "a").join(of("b", "y"), "b").groupBy(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = cut(merged.agg(F.sum("w").alias("w")))
    least = label.groupBy("label").agg(F.min("node").alias("least"))
    return label.join(least, "label").select("node", F.col("least").alias("label")), values
