"""Comparisons of models, fusions, parameters and column detection."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import evaluation, fusion
from tidewatch.sources import detect

Model = Callable[..., DataFrame]


def model_matrix(scores: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(model, k, hits, recall, precision) of every model by itself.

    The numbering is limited to max(ks) rows a model before the shuffle."""
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("score"), "entity_id"))
    head = scores.withColumn("place", place).where(F.col("place") <= max(ks))
    known = truth.select("entity_id").distinct().withColumn("hit", F.lit(1))
    met = head.join(known, "entity_id", "left").withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("place <= k")
    per = met.groupBy("model", "k").agg(F.count("hit").alias("hits"))
    size = truth.agg(F.count_distinct("entity_id").alias("p"))
    return per.join(F.broadcast(size)).select("model", "k", "hits", F.round(F.col("hits") / F.greatest("p", F.lit(1)), 4).alias("recall"), F.round(F.col("hits") / F.col("k"), 4).alias("precision"))


def fusion_matrix(scores: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """``evaluation.recall_precision`` of every rank fusion, by name."""
    rows = [evaluation.recall_precision(fuse(scores).withColumn("score", F.round("score", 6)), truth, ks).withColumn("fusion", F.lit(name)) for name, fuse in fusion.FUSIONS.items()]
    return reduce(DataFrame.unionByName, rows)


def _hits(scores: DataFrame, truth: DataFrame, k: int, fuse: Model) -> DataFrame:
    head = fusion.top_k(fuse(scores).withColumn("score", F.round("score", 6)), k)
    return head.join(truth.select("entity_id").distinct(), "entity_id", "left_semi").agg(F.count("*").alias("hits"))


def substitution(scores: DataFrame, truth: DataFrame, base: list[str], member: str, candidates: list[str], k: int = 10, fuse: Model = fusion.borda) -> DataFrame:
    """(candidate, hits): the fused ranking with ``member`` of the ``base``
    models replaced by each candidate; ``member`` itself is the comparison."""
    rest = [m for m in base if m != member]
    rows = [_hits(scores.where(F.col("model").isin(*rest, c)), truth, k, fuse).select(F.lit(c).alias("candidate"), "hits") for c in [member, *candidates]]
    return reduce(DataFrame.unionByName, rows)


def sweep(events: DataFrame, model: Model, settings: dict, grid: dict[str, list], truth: DataFrame, k: int = 10) -> DataFrame:
    """(parameter, value, hits, recall): one parameter is changed at a time."""
    size = truth.agg(F.count_distinct("entity_id").alias("p"))
    rows = []
    for name, values in grid.items():
        for value in values:
            hits = _hits(model(events, **(settings | {name: value})), truth, k, lambda s: s)
            rows.append(hits.select(F.lit(name).alias("parameter"), F.lit(float(value)).alias("value"), "hits"))
    return reduce(DataFrame.unionByName, rows).join(F.broadcast(size)).select("parameter", "value", "hits", F.round(F.col("hits") / F.greatest("p", F.lit(1)), 4).alias("recall"))


def sample_accounts(rows: DataFrame, account: str, order: list[str], labelled: Column, cap: int) -> DataFrame:
    """All labelled rows, and of the others the first ``cap`` of each account.
    The cap is the feature: it makes a sample for evaluation."""
    marked = rows.withColumn("labelled_", F.coalesce(labelled, F.lit(False)))
    nth = F.row_number().over(Window.partitionBy(account).orderBy(*order))
    # Only unlabelled rows are numbered, and no more than cap of an account shuffle.
    rest = marked.where("not labelled_").withColumn("nth_", nth).where(F.col("nth_") <= cap).drop("nth_")
    return marked.where("labelled_").unionByName(rest).drop("labelled_")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(both, either, jaccard) of the key sets of two tables."""
    sides = a.select(key, F.lit(1).alias("side")).unionByName(b.select(key, F.lit(2).alias("side"))).where(F.col(key).isNotNull())
    per = sides.groupBy(key).agg(F.count_distinct("side").alias("n"))
    both, either = F.count_if(F.col("n") == 2), F.count("*")
    return per.agg(both.alias("both"), either.alias("either")).withColumn("jaccard", F.round(F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(0.0), 6))


def detection_modes(files: list[tuple[DataFrame, dict[str, str]]]) -> list[dict]:
    """Slot recall and wrong-slot rate of header, content and hybrid detection
    over (table, {column: slot}) pairs, and columns that hybrid finds though
    headers miss them. Columns are metadata, so the result is a small list."""
    found = {mode: [{r.column: r.slot for r in detect.detect_columns(df, mode)} for df, _ in files] for mode in ("header", "content", "hybrid")}
    rows = []
    for mode, each in found.items():
        right = sum(got.get(c) == slot for got, (_, want) in zip(each, files, strict=True) for c, slot in want.items())
        told = sum(len(got) for got in each)
        total = sum(len(want) for _, want in files)
        wrong = told - right
        rescued = sum(got.get(c) == slot != by_name.get(c) for got, by_name, (_, want) in zip(each, found["header"], files, strict=True) for c, slot in want.items())
        rows.append({"mode": mode, "recall": right / max(total, 1), "wrong": wrong / max(told, 1), "rescued": rescued})
    return rows
