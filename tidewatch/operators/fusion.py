"""Rank fusion over long score sets (model, entity_id, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score cells in which a model's entities are numbered side by side.
CELLS = 4096


def stack(models: dict[str, DataFrame], digits: int = 6) -> DataFrame:
    """Models' scores as one long table, rounded so that ties are stable."""
    long = [df.select(F.lit(name).alias("model"), "entity_id", F.round("score", digits).alias("score")) for name, df in models.items()]
    return reduce(DataFrame.unionByName, long)


def ranks(scores: DataFrame) -> DataFrame:
    """``scores`` with ``points``: place by (score, entity_id) within the model
    over m - 1, 0 where a model has one entity. Rows are numbered within score
    cells and offset by the cells below, so no task ranks a whole model."""
    cell = F.greatest(F.lit(0), F.least(F.lit(CELLS), F.floor(F.col("score") * CELLS))).cast("int")
    dealt = scores.withColumn("cell", cell)
    counts = dealt.groupBy("model", "cell").agg(F.count("*").alias("k"))
    every = Window.partitionBy("model")
    below = every.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("model", "cell", F.coalesce(F.sum("k").over(below), F.lit(0)).alias("below"), F.sum("k").over(every).alias("m"))
    nth = F.row_number().over(Window.partitionBy("model", "cell").orderBy("score", "entity_id")) - 1
    met = dealt.withColumn("nth", nth).join(F.broadcast(offsets), ["model", "cell"])
    points = F.when(F.col("m") > 1, (F.col("below") + F.col("nth")) / (F.col("m") - 1)).otherwise(0.0)
    return met.select("model", "entity_id", "score", points.alias("points"))


def _models(scores: DataFrame) -> DataFrame:
    return F.broadcast(scores.agg(F.count_distinct("model").alias("n_models")))


def borda(scores: DataFrame, best: float = 0.25) -> DataFrame:
    """Rank points over all models plus a share of the best score, at most 1."""
    per = ranks(scores).groupBy("entity_id").agg(F.sum("points").alias("points"), F.max("score").alias("top"))
    return per.join(_models(scores)).select("entity_id", F.least(F.col("points") / F.col("n_models") + best * F.col("top"), F.lit(1.0)).alias("score"))


def top2(scores: DataFrame, first: float = 0.7, second: float = 0.3) -> DataFrame:
    """The two best scores, weighted; only one: its weighted share."""
    tops = scores.groupBy("entity_id").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("s"))
    return tops.select("entity_id", (first * F.col("s")[0] + second * F.coalesce(F.get("s", F.lit(1)), F.lit(0.0))).alias("score"))


def rank_average(scores: DataFrame) -> DataFrame:
    """Mean rank points over the models that scored an entity."""
    return ranks(scores).groupBy("entity_id").agg(F.avg("points").alias("score"))


def score_mean(scores: DataFrame) -> DataFrame:
    """Sum of scores over the number of all models."""
    per = scores.groupBy("entity_id").agg(F.sum("score").alias("s"))
    return per.join(_models(scores)).select("entity_id", (F.col("s") / F.col("n_models")).alias("score"))


def weighted_sum(scores: DataFrame, weights: dict[str, float], default: float = 1.0) -> DataFrame:
    """Weighted scores over the weights present, those not under 1."""
    w: Column = F.lit(default)
    for name, weight in weights.items():
        w = F.when(F.col("model") == name, F.lit(float(weight))).otherwise(w)
    per = scores.withColumn("w", w).groupBy("entity_id").agg(F.sum(F.col("w") * F.col("score")).alias("s"), F.sum("w").alias("w"))
    return per.select("entity_id", (F.col("s") / F.greatest(F.col("w"), F.lit(1.0))).alias("score"))


FUSIONS = {"borda": borda, "top2": top2, "rank_average": rank_average, "score_mean": score_mean}


def ranking(events: DataFrame, scores: DataFrame, fused: DataFrame) -> DataFrame:
    """(entity_id, score to 4 digits, n_events, models_fired, risk, explanation).

    A model has fired above 0.6; the explanation, for fused scores above 0.6,
    names those above 0.5."""
    n = events.where("entity_id is not null").groupBy("entity_id").agg(F.count("*").alias("n_events"))
    names = lambda cut: F.array_join(F.array_sort(F.collect_list(F.when(F.col("score") > cut, F.col("model")))), ",")
    fired = scores.groupBy("entity_id").agg(names(0.6).alias("models_fired"), names(0.5).alias("named"))
    rows = fused.select("entity_id", F.round("score", 4).alias("score")).join(n, "entity_id", "left").join(fired, "entity_id", "left")
    risk = F.when(F.col("score") >= 0.7, "HIGH").when(F.col("score") >= 0.45, "MEDIUM").otherwise("LOW")
    why = F.when(F.col("score") > 0.6, F.concat(F.lit("flagged by "), "named"))
    return rows.select("entity_id", "score", F.coalesce("n_events", F.lit(0)).alias("n_events"), "models_fired", risk.alias("risk"), why.alias("explanation"))


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.orderBy(F.desc("score"), "entity_id").limit(k)
