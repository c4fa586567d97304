"""Operators on the graph of entities and counterparties."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.lineage import cut
from tidewatch.functions.scaling import EPS, over_max, scoremin, with_totals
from tidewatch.operators.communities import modularity_communities


def edges(events: DataFrame) -> DataFrame:
    """(src, dst, w): how often an entity meets each counterparty."""
    known = events.where("entity_id is not null and counterparty_id is not null")
    return known.groupBy(F.col("entity_id").alias("src"), F.col("counterparty_id").alias("dst")).agg(F.count("*").alias("w"))


def _residuals(events: DataFrame) -> DataFrame:
    """Distance of log volume from its fit on log degree; eight entities least."""
    per = edges(events).groupBy(F.col("src").alias("entity_id")).agg(F.count("*").alias("d"), F.sum("w").alias("w"))
    # A row an entity, read for the fit and for the residuals.
    xy = per.select("entity_id", F.log(F.col("d").cast("double")).alias("x"), F.log1p(F.col("w").cast("double")).alias("y"))
    xy = cut(xy)
    fit = xy.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("base"), F.count("*").alias("n")).where("n >= 8")
    return xy.join(F.broadcast(fit)).select("entity_id", (F.col("y") - (F.col("slope") * F.col("x") + F.col("base"))).alias("resid"))


def oddball(events: DataFrame) -> DataFrame:
    """Egonet density power-law deviation, either way."""
    rows = with_totals(_residuals(events), _std=F.stddev_pop("resid"))
    spread = F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    return scoremin(rows.withColumn("raw", F.abs(F.col("resid") / spread)), "raw")


def oddball_signed(events: DataFrame) -> DataFrame:
    """Only volumes above the fit stand out."""
    return scoremin(_residuals(events), "resid")


def degrees(events: DataFrame) -> DataFrame:
    known = events.where("entity_id is not null and counterparty_id is not null")
    return known.select("entity_id", "counterparty_id").distinct().groupBy("entity_id").agg(F.count("*").alias("d"))


def degree_deviation(events: DataFrame) -> DataFrame:
    """|z| of the degree; three different degrees at least."""
    rows = with_totals(degrees(events), _m=F.avg("d"), _s=F.stddev_samp("d"), _k=F.count_distinct("d")).where("_k >= 3")
    return scoremin(rows.withColumn("raw", F.abs((F.col("d") - F.col("_m")) / (F.col("_s") + EPS))), "raw")


def _in_out(events: DataFrame, out) -> DataFrame:
    """(entity_id, out, in, deg, sided), counted over pairs of parties."""
    known = events.where("entity_id is not null and counterparty_id is not null")
    pairs = known.groupBy("entity_id", "counterparty_id").agg(
        F.coalesce(F.bool_or(out), F.lit(False)).alias("out"), F.coalesce(F.bool_or(F.col("direction") == "credit"), F.lit(False)).alias("in"),
        F.count_if(F.col("direction").isin("credit", "debit")).alias("sided"),
    )
    return pairs.groupBy("entity_id").agg(
        F.count_if("out").alias("out"), F.count_if("in").alias("in"), F.count("*").alias("deg"), F.sum("sided").alias("sided")
    )


def reciprocity(events: DataFrame) -> DataFrame:
    """log(1 + outgoing * incoming parties), over its maximum."""
    per = _in_out(events, F.coalesce("direction", F.lit("out")) != "credit")
    return over_max(per.select("entity_id", F.log1p((F.col("out") * F.col("in")).cast("double")).alias("raw")), "raw")


def scatter_gather(events: DataFrame) -> DataFrame:
    """Parties paid times parties paying, over the degree."""
    per = _in_out(events, F.col("direction") == "debit").where("sided > 0")
    return over_max(per.select("entity_id", (F.col("out") * F.col("in") / (F.col("deg") + EPS)).alias("raw")), "raw")


def pagerank(e: DataFrame, tolerance: float = 1e-7, damping: float = 0.85, most: int = 200) -> DataFrame:
    """(node, rank) over weighted edges, within ``tolerance`` of the exact ranks
    (sum of differences) unless ``most`` rounds end first.

    Rank of nodes without outgoing edges is dealt evenly, as jumps are, so ranks
    are those of the system without dealing, scaled to one. From even ranks on, a
    round sends only how much ranks have changed, along edges that are stored and
    dealt by their source once; nodes that did not change send nothing.
    """
    spark = e.sparkSession
    total = e.groupBy("src").agg(F.sum("w").alias("all"))
    stored = cut(e.join(total, "src").select("src", "dst", (F.col("w") / F.col("all")).alias("p")))
    # On disk, so that a lost executor costs a read of the stored table.
    share = stored.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "src").persist(StorageLevel.DISK_ONLY)
    nodes = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    n = nodes.count()
    if not n:
        share.unpersist()
        return nodes.withColumn("rank", F.lit(0.0))
    even = (1 - damping) / n  # what a jump gives
    sent = share.groupBy(F.col("dst").alias("node")).agg((F.sum("p") * damping / n).alias("got"))
    change = cut(nodes.join(sent, "node", "left").select("node", (F.lit(even - 1 / n) + F.coalesce("got", F.lit(0.0))).alias("d")).where("d <> 0"))
    changes = [nodes.select("node", F.lit(1 / n).alias("d")), change]
    for _ in range(most):
        left = change.agg(F.sum(F.abs("d"))).first()[0] or 0.0
        # Of a change, at most damping / (1 - damping) is still to come; without
        # dealing ranks add up to (1 - damping) at least.
        if left * damping / (1 - damping) ** 2 <= tolerance:
            break
        passed = change.join(share, change.node == share.src).groupBy(F.col("dst").alias("node")).agg((F.sum(F.col("d") * F.col("p")) * damping).alias("d"))
        change = cut(passed.where("d <> 0"))
        changes.append(change)
        if len(changes) > 12:
            changes = [cut(reduce(DataFrame.union, changes).groupBy("node").agg(F.sum("d").alias("d")))]
    share.unpersist()
    rank = cut(reduce(DataFrame.union, changes).groupBy("node").agg(F.sum("d").alias("rank")))
    return rank.select("node", (F.col("rank") / F.lit(rank.agg(F.sum("rank")).first()[0])).alias("rank"))


def pagerank_deviation(events: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Rank above what the degree explains, (deg + 1) / (E + 1), for actors."""
    e = cut(edges(events))
    deg = e.select(F.col("src").alias("node")).union(e.select("dst")).groupBy("node").agg(F.count("*").alias("deg"))
    size = e.agg(F.count("*").alias("m"))
    actors = e.select(F.col("src").alias("node")).distinct()
    rows = pagerank(e, tolerance).join(deg, "node").join(actors, "node", "left_semi").join(F.broadcast(size))
    raw = F.greatest(F.lit(0.0), F.col("rank") - (F.col("deg") + 1) / (F.col("m") + 1))
    return scoremin(rows.select(F.col("node").alias("entity_id"), raw.alias("raw")), "raw")


def spread_labels(e: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label) by synchronous label propagation on the undirected graph:
    the most frequent label among neighbours, the lowest among equals."""
    both = cut(e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select("dst", "src")).where("a <> b").distinct())
    label = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(label, both.b == label.node).groupBy("a", "label").agg(F.count("*").alias("n"))
        label = votes.groupBy(F.col("a").alias("node")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
        label = cut(label)
    return label


def small_communities(label: DataFrame) -> DataFrame:
    """(entity_id, score): (median - size) / median for members of communities
    below the median size."""
    sizes = label.groupBy("label").agg(F.count("*").alias("size"))
    mid = sizes.agg(F.median("size").alias("mid"))
    rows = label.join(sizes, "label").join(F.broadcast(mid)).where("size < mid")
    return rows.select(F.col("node").alias("entity_id"), ((F.col("mid") - F.col("size")) / F.col("mid")).alias("score"))


def community_motif(events: DataFrame) -> DataFrame:
    """``small_communities`` of modularity clustering, for actors. Every pair of
    parties is one edge, however often they meet; under eight nodes no one is scored."""
    e = cut(edges(events).select("src", "dst", F.lit(1.0).alias("w")))
    label = modularity_communities(e)[0]
    enough = label.limit(8).count() == 8
    return small_communities(cut(label)).join(e.select(F.col("src").alias("entity_id")).distinct(), "entity_id", "left_semi").where(F.lit(enough))
