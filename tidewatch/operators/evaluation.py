"""Detection quality against a truth table (entity_id, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.fusion import score_mean, top_k


def recall_precision(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(k, hits, recall, precision, lift) of the first k entities."""
    spark = ranked.sparkSession
    head = top_k(ranked, max(ks)).select("entity_id", "score")
    # At most max(ks) rows: the numbering is over the report's own limit.
    rows = head.selectExpr("entity_id", "row_number() over (order by score desc, entity_id) as place")
    hit = rows.join(truth.select("entity_id").distinct().withColumn("hit", F.lit(1)), "entity_id", "left")
    sizes = truth.agg(F.count_distinct("entity_id").alias("p")).join(ranked.agg(F.count("*").alias("n")))
    cut = spark.createDataFrame([(k,) for k in ks], "k int")
    per = cut.join(F.broadcast(hit), F.col("place") <= F.col("k")).groupBy("k").agg(F.sum("hit").alias("hits"))
    hits = F.coalesce("hits", F.lit(0))
    return per.join(F.broadcast(sizes)).select(
        "k", hits.alias("hits"), F.round(hits / F.greatest("p", F.lit(1)), 4).alias("recall"), F.round(hits / F.col("k"), 4).alias("precision"),
        F.round(hits / (F.col("k") * F.col("p") / F.col("n")), 4).alias("lift"),
    )


def type_recall(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(kind, n, found, recall) of the first k entities by kind."""
    head = top_k(ranked, k).select("entity_id", F.lit(1).alias("in"))
    per = truth.join(F.broadcast(head), "entity_id", "left").groupBy("kind").agg(F.count("*").alias("n"), F.count("in").alias("found"))
    return per.select("kind", "n", "found", F.round(F.col("found") / F.col("n"), 4).alias("recall"))


def ablation(scores: DataFrame, truth: DataFrame, models: list[str], k: int = 10) -> DataFrame:
    """(left_out, hits): hits of the mean score without each model."""
    out = None
    t = truth.select("entity_id").distinct()
    for name in models:
        head = top_k(score_mean(scores.where(F.col("model") != name)).withColumn("score", F.round("score", 6)), k)
        one = head.join(t, "entity_id", "left_semi").agg(F.count("*").alias("hits")).select(F.lit(name).alias("left_out"), "hits")
        out = one if out is None else out.unionByName(one)
    return out


def by_part(ranked: DataFrame, truth: DataFrame, held: str = "surprise", ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """``recall_precision`` with ``part``: main for the kinds known beforehand, held
    for the kind ``held``, which counts as nothing in the main figures."""
    main = recall_precision(ranked, truth.where(F.col("kind") != held), ks)
    rest = recall_precision(ranked, truth.where(F.col("kind") == held), ks)
    return main.withColumn("part", F.lit("main")).unionByName(rest.withColumn("part", F.lit("held")))


def mode_means(results: DataFrame) -> DataFrame:
    """(mode, fusion, n_datasets, mean_recall) of (mode, dataset, fusion, recall); a
    dataset that failed has no recall and does not count."""
    rows = results.where("recall is not null").groupBy("mode", "fusion")
    return rows.agg(F.count_distinct("dataset").alias("n_datasets"), F.round(F.avg("recall"), 3).alias("mean_recall"))
